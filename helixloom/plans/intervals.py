"""Queries over intervals, reads and genes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from .registry import query

V = "v AS (SELECT chrom_order, pos, ref, alt FROM fx_variants)"


def _regions(t, lo, hi):
    """Half of the intervals under other names, so that two sides can be joined."""
    return t.fx_intervals.filter(F.col("state") == lo).select("chrom_order", F.col("start_pos").alias("s1"), F.col("end_pos").alias("e1")), t.fx_intervals.filter(F.col("state") == hi).select("chrom_order", F.col("start_pos").alias("s2"), F.col("end_pos").alias("e2"))


@query("interval_containment", f"WITH {V} SELECT v.chrom_order, v.pos, v.ref, v.alt, i.start_pos, i.end_pos, i.state FROM v JOIN fx_intervals i ON v.chrom_order = i.chrom_order AND v.pos > i.start_pos AND v.pos <= i.end_pos")
def _(t):
    v = t.fx_variants.select("chrom_order", "pos", "ref", "alt")
    return I.points_in(v, t.fx_intervals, ["chrom_order"], "pos", "start_pos", "end_pos")


@query("callable_variants", f"WITH {V} SELECT * FROM v WHERE EXISTS (SELECT 1 FROM fx_intervals i WHERE i.state = 'CALLABLE' AND v.chrom_order = i.chrom_order AND v.pos > i.start_pos AND v.pos <= i.end_pos)")
def _(t):
    v = t.fx_variants.select("chrom_order", "pos", "ref", "alt")
    return I.points_in(v, t.fx_intervals.filter("state = 'CALLABLE'"), ["chrom_order"], "pos", "start_pos", "end_pos", "left_semi")


@query("interval_overlap_reasons", f"""WITH {V}, o AS (SELECT v.*, i.state FROM v LEFT JOIN fx_intervals i ON v.chrom_order = i.chrom_order AND i.start_pos < v.pos - 1 + length(v.ref) AND v.pos - 1 < i.end_pos)
 SELECT chrom_order, pos, ref, alt, coalesce(list_sort(list(DISTINCT state) FILTER (state IS NOT NULL)), []) AS reasons FROM o GROUP BY 1, 2, 3, 4""")
def _(t):
    v = t.fx_variants.select("chrom_order", "pos", "ref", "alt", (F.col("pos") - 1).alias("s1"), (F.col("pos") - 1 + F.length("ref")).alias("e1"))
    j = I.overlaps(v, t.fx_intervals, ["chrom_order"], ("s1", "e1"), ("start_pos", "end_pos"))
    found = j.groupBy("chrom_order", "pos", "ref", "alt").agg(F.array_sort(F.collect_set("state")).alias("reasons"))
    key = ["chrom_order", "pos", "ref", "alt"]
    return v.select(*key).join(found, key, "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


@query("interval_intersect", """SELECT a.chrom_order, greatest(a.start_pos, b.start_pos) AS start_pos, least(a.end_pos, b.end_pos) AS end_pos FROM fx_intervals a JOIN fx_intervals b
 ON a.chrom_order = b.chrom_order AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos WHERE a.state = 'CALLABLE' AND b.state = 'LOW_5_9'""")
def _(t):
    a, b = _regions(t, "CALLABLE", "LOW_5_9")
    j = I.overlaps(a, b, ["chrom_order"], ("s1", "e1"), ("s2", "e2"))
    return j.select("chrom_order", F.greatest("s1", "s2").alias("start_pos"), F.least("e1", "e2").alias("end_pos"))


@query("reciprocal_overlap_best", """WITH p AS (SELECT a.chrom_order, a.start_pos AS s1, a.end_pos AS e1, b.start_pos AS s2, b.end_pos AS e2, least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) AS shared
 FROM fx_intervals a JOIN fx_intervals b ON a.chrom_order = b.chrom_order AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos WHERE a.state = 'CALLABLE' AND b.state = 'LOW_5_9')
 SELECT chrom_order, s1, e1, s2, e2, shared FROM (SELECT *, row_number() OVER (PARTITION BY chrom_order, s1, e1 ORDER BY shared DESC, s2, e2) AS k FROM p WHERE 2 * shared >= e1 - s1 AND 2 * shared >= e2 - s2) WHERE k = 1""")
def _(t):
    a, b = _regions(t, "CALLABLE", "LOW_5_9")
    j = I.overlaps(a, b, ["chrom_order"], ("s1", "e1"), ("s2", "e2")).withColumn("shared", F.least("e1", "e2") - F.greatest("s1", "s2"))
    good = j.filter((2 * F.col("shared") >= F.col("e1") - F.col("s1")) & (2 * F.col("shared") >= F.col("e2") - F.col("s2")))
    best = good.groupBy("chrom_order", "s1", "e1").agg(F.min_by(F.struct("s2", "e2", "shared"), F.struct(-F.col("shared"), "s2", "e2")).alias("b"))
    return best.select("chrom_order", "s1", "e1", "b.s2", "b.e2", "b.shared")


@query("nearest_pass_variant", """WITH p AS (SELECT DISTINCT chrom_order, pos FROM fx_variants), q AS (SELECT DISTINCT chrom_order, pos FROM fx_variants WHERE filter = 'PASS')
 SELECT p.chrom_order, p.pos, min(abs(q.pos - p.pos)) FILTER (q.pos <> p.pos) AS nearest, coalesce(max((q.pos = p.pos)::INT), 0) AS at_point FROM p LEFT JOIN q ON p.chrom_order = q.chrom_order AND q.pos BETWEEN p.pos - 10 AND p.pos + 10 GROUP BY 1, 2""")
def _(t):
    return I.nearest_other(t.fx_variants, F.col("filter") == "PASS", ["chrom_order"], "pos", 10)


@query("gap_anti_join", """WITH c AS (SELECT chrom_order, start_pos, end_pos FROM fx_intervals WHERE state = 'CALLABLE') SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM fx_variants v WHERE v.chrom_order = c.chrom_order AND v.filter = 'PASS'
 AND v.pos - 1 < c.end_pos + 20 AND v.pos - 1 + length(v.ref) > c.start_pos - 20)""")
def _(t):
    c = t.fx_intervals.filter("state = 'CALLABLE'").select("chrom_order", "start_pos", "end_pos", F.greatest(F.lit(0), F.col("start_pos") - 20).alias("s1"), (F.col("end_pos") + 20).alias("e1"))
    v = t.fx_variants.filter("filter = 'PASS'").select("chrom_order", (F.col("pos") - 1).alias("s2"), (F.col("pos") - 1 + F.length("ref")).alias("e2"))
    c = c.withColumn("id", F.struct("chrom_order", "start_pos", "end_pos"))
    hit = I.overlaps(c, v, ["chrom_order"], ("s1", "e1"), ("s2", "e2")).select("id").distinct()
    return c.join(hit, "id", "left_anti").select("chrom_order", "start_pos", "end_pos")


@query("variants_over_span", """SELECT i.chrom_order, i.start_pos, i.end_pos, count(*) AS n FROM fx_intervals i JOIN fx_variants v ON i.chrom_order = v.chrom_order AND v.pos > i.start_pos - 60 AND v.pos <= i.end_pos AND v.pos - 1 + length(v.ref) > i.start_pos GROUP BY 1, 2, 3""")
def _(t):
    v = t.fx_variants.select("chrom_order", (F.col("pos") - 1).alias("s2"), (F.col("pos") - 1 + F.length("ref")).alias("e2"))
    j = I.overlaps(t.fx_intervals.select("chrom_order", "start_pos", "end_pos"), v, ["chrom_order"], ("start_pos", "end_pos"), ("s2", "e2"))
    return j.groupBy("chrom_order", "start_pos", "end_pos").agg(F.count("*").alias("n"))


@query("genes_at", """SELECT v.chrom_order, v.pos, string_agg(DISTINCT g.symbol, ',' ORDER BY g.symbol) AS genes FROM (SELECT DISTINCT chrom_order, pos FROM fx_variants) v JOIN fx_genes g
 ON v.chrom_order = g.chrom_order AND v.pos BETWEEN g.start_pos AND g.end_pos WHERE g.biotype = 'protein_coding' GROUP BY 1, 2""")
def _(t):
    g = t.fx_genes.filter("biotype = 'protein_coding'").select("chrom_order", "symbol", (F.col("start_pos") - 1).alias("s"), F.col("end_pos").alias("e"))
    j = I.points_in(t.fx_variants.select("chrom_order", "pos").distinct(), g, ["chrom_order"], "pos", "s", "e")
    return j.groupBy("chrom_order", "pos").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("genes"))


@query("merge_intervals", """WITH o AS (SELECT chrom_order, start_pos, end_pos, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY chrom_order ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM fx_intervals),
 k AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom_order ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT chrom_order, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM k GROUP BY chrom_order, island""")
def _(t):
    return I.merge(t.fx_intervals.select("chrom_order", "start_pos", "end_pos"), ["chrom_order"], "start_pos", "end_pos")


@query("coverage_windows", """WITH r AS (SELECT chrom_order, start_pos, start_pos + 100 AS end_pos FROM fx_reads WHERE flag < 1024), w AS (SELECT *, unnest(range(start_pos // 1000, (end_pos - 1) // 1000 + 1)) AS w FROM r)
 SELECT chrom_order, w * 1000 AS start_pos, sum(least(end_pos, (w + 1) * 1000) - greatest(start_pos, w * 1000))::BIGINT AS bases, sum(least(end_pos, (w + 1) * 1000) - greatest(start_pos, w * 1000))::DOUBLE / 1000 AS mean_depth FROM w GROUP BY 1, 2""")
def _(t):
    return I.window_depth(t.fx_reads.filter("flag < 1024").select("chrom_order", "start_pos", (F.col("start_pos") + 100).alias("end_pos")), ["chrom_order"], "start_pos", "end_pos")


@query("coverage_rebinned", """WITH r AS (SELECT chrom_order, start_pos, start_pos + 100 AS end_pos FROM fx_reads WHERE flag < 1024), w AS (SELECT *, unnest(range(start_pos // 1000, (end_pos - 1) // 1000 + 1)) AS w FROM r),
 k AS (SELECT chrom_order, w * 1000 AS s, sum(least(end_pos, (w + 1) * 1000) - greatest(start_pos, w * 1000))::BIGINT AS bases FROM w GROUP BY 1, 2)
 SELECT chrom_order, s // 100000 * 100000 AS start_pos, sum(bases)::BIGINT AS bases, count(*) AS windows, sum(bases)::DOUBLE / (count(*) * 1000) AS mean_depth FROM k GROUP BY 1, 2""")
def _(t):
    w = I.window_depth(t.fx_reads.filter("flag < 1024").select("chrom_order", "start_pos", (F.col("start_pos") + 100).alias("end_pos")), ["chrom_order"], "start_pos", "end_pos")
    r = w.groupBy("chrom_order", (F.floor(F.col("start_pos") / 100_000) * 100_000).alias("start_pos")).agg(F.sum("bases").alias("bases"), F.count("*").alias("windows"))
    return r.withColumn("mean_depth", F.col("bases").cast("double") / (F.col("windows") * 1000))


@query("depth_runs", """WITH e AS (SELECT chrom_order, start_pos AS p0, 1 AS d FROM fx_reads UNION ALL SELECT chrom_order, start_pos + 100, -1 FROM fx_reads), s AS (SELECT chrom_order, p0, sum(d) AS d FROM e GROUP BY 1, 2),
 p AS (SELECT chrom_order, p0, sum(d) OVER w AS depth, lead(p0) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY chrom_order ORDER BY p0)),
 c AS (SELECT *, CASE WHEN depth >= 10 THEN 3 WHEN depth >= 5 THEN 2 WHEN depth >= 1 THEN 1 ELSE 0 END AS cls FROM p WHERE nxt IS NOT NULL),
 g AS (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY chrom_order ORDER BY p0) = cls THEN 0 ELSE 1 END AS fresh FROM c), r AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom_order ORDER BY p0 ROWS UNBOUNDED PRECEDING) AS run FROM g)
 SELECT chrom_order, cls, min(p0) AS start_pos, max(nxt) AS end_pos FROM r GROUP BY chrom_order, run, cls""")
def _(t):
    return I.depth_runs(t.fx_reads.select("chrom_order", "start_pos", (F.col("start_pos") + 100).alias("end_pos")), ["chrom_order"], "start_pos", "end_pos", (1, 5, 10))


@query("coverage_summary", """SELECT state, sum(end_pos - start_pos)::BIGINT AS bp, (sum(end_pos - start_pos))::DOUBLE / (SELECT sum(end_pos - start_pos) FROM fx_intervals) AS share FROM fx_intervals GROUP BY 1""")
def _(t):
    bp = t.fx_intervals.groupBy("state").agg(F.sum(F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("bp"))
    return bp.withColumn("share", F.col("bp").cast("double") / F.sum("bp").over(Window.partitionBy()))  # five states


LONGEST = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY end_pos - start_pos DESC, gene_id) AS k FROM fx_genes) WHERE k = 1)"


def _longest(t):
    order = F.struct(-(F.col("end_pos") - F.col("start_pos")), "gene_id")
    return t.fx_genes.groupBy("symbol").agg(F.min_by(F.struct("gene_id", "chrom_order", "start_pos", "end_pos"), order).alias("m")).select("symbol", "m.*")


@query("longest_gene_model", f"WITH {LONGEST} SELECT symbol, gene_id, chrom_order, start_pos, end_pos FROM m")
def _(t):
    return _longest(t)


@query("gene_callable_fraction", f"""WITH {LONGEST}, o AS (SELECT m.symbol, m.gene_id, m.end_pos - m.start_pos + 1 AS span, coalesce(sum(least(m.end_pos, i.end_pos) - greatest(m.start_pos - 1, i.start_pos)) FILTER (i.state IS NOT NULL), 0)::BIGINT AS bp FROM m LEFT JOIN fx_intervals i
 ON i.state = 'CALLABLE' AND m.chrom_order = i.chrom_order AND i.start_pos < m.end_pos AND m.start_pos - 1 < i.end_pos GROUP BY 1, 2, 3) SELECT symbol, gene_id, bp, bp::DOUBLE / span AS fraction FROM o""")
def _(t):
    m = _longest(t).select("symbol", "gene_id", "chrom_order", (F.col("start_pos") - 1).alias("s1"), F.col("end_pos").alias("e1"))
    i = t.fx_intervals.filter("state = 'CALLABLE'").select("chrom_order", F.col("start_pos").alias("s2"), F.col("end_pos").alias("e2"))
    o = I.overlaps(m, i, ["chrom_order"], ("s1", "e1"), ("s2", "e2")).groupBy("symbol").agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("bp"))
    j = m.join(o, "symbol", "left").withColumn("bp", F.coalesce("bp", F.lit(0)).cast("bigint"))
    return j.select("symbol", "gene_id", "bp", (F.col("bp").cast("double") / (F.col("e1") - F.col("s1"))).alias("fraction"))


@query("exon_depths", """SELECT x.gene, x.exon, coalesce(sum(least(x.end_pos, r.start_pos + 100) - greatest(x.start_pos, r.start_pos)) FILTER (r.mapq >= 20), 0)::BIGINT AS bases_unique, coalesce(sum(least(x.end_pos, r.start_pos + 100) - greatest(x.start_pos, r.start_pos)) FILTER (r.read_id IS NOT NULL), 0)::BIGINT AS bases_all
 FROM fx_exons x LEFT JOIN fx_reads r ON r.chrom_order = x.exon % 25 AND r.flag < 1024 AND r.start_pos < x.end_pos AND x.start_pos < r.start_pos + 100 GROUP BY 1, 2""")
def _(t):
    x = t.fx_exons.select("gene", "exon", (F.col("exon") % 25).alias("chrom_order"), "start_pos", "end_pos")
    r = t.fx_reads.filter("flag < 1024").select("chrom_order", "mapq", F.col("start_pos").alias("s2"), (F.col("start_pos") + 100).alias("e2"))
    share = F.least("end_pos", "e2") - F.greatest("start_pos", "s2")
    o = I.overlaps(x, r, ["chrom_order"], ("start_pos", "end_pos"), ("s2", "e2")).groupBy("gene", "exon").agg(F.sum(F.when(F.col("mapq") >= 20, share)).alias("u"), F.sum(share).alias("a"))
    j = x.join(o, ["gene", "exon"], "left")
    return j.select("gene", "exon", F.coalesce("u", F.lit(0)).cast("bigint").alias("bases_unique"), F.coalesce("a", F.lit(0)).cast("bigint").alias("bases_all"))


@query("snv_counts", """WITH h AS (SELECT v.chrom_order, v.pos, v.ref, v.alt, r.mapq, r.flag, r.seq, r.qual, CASE r.cigar WHEN '100M' THEN o WHEN '50M4D46M4S' THEN CASE WHEN o < 50 THEN o WHEN o >= 54 THEN o - 4 END ELSE CASE WHEN o < 48 OR o >= 50 THEN o END END AS q
 FROM fx_variants v JOIN (SELECT *, unnest(range(0, 100)) AS o FROM fx_reads WHERE flag % 8 < 4 AND (flag // 256) % 16 = 0) r ON v.chrom_order = r.chrom_order AND v.pos = r.start_pos + 1 + r.o WHERE length(v.ref) = 1 AND length(v.alt) = 1),
 b AS (SELECT *, mapq < 20 AS low, CASE WHEN q IS NULL THEN 'gap' WHEN ascii(qual[q + 1]) - 33 < 20 THEN 'poor' ELSE seq[q + 1] END AS base FROM h)
 SELECT chrom_order, pos, ref, alt, count(*) FILTER (low) AS low_mapq, count(*) FILTER (NOT low AND base = 'poor') AS low_baseq, count(*) FILTER (NOT low AND base = ref) AS ref_reads, count(*) FILTER (NOT low AND base = alt) AS alt_reads,
 count(*) FILTER (NOT low AND base NOT IN ('poor', ref, alt)) AS other, count(*) FILTER (NOT low AND base = ref AND (flag & 16) = 0) AS ref_fwd, count(*) FILTER (NOT low AND base = alt AND (flag & 16) = 0) AS alt_fwd FROM b GROUP BY 1, 2, 3, 4""")
def _(t):
    v = t.fx_variants.filter("length(ref) = 1 AND length(alt) = 1").select("chrom_order", "pos", "ref", "alt")
    return I.snv_counts(v, t.fx_reads.withColumn("end_pos", F.col("start_pos") + 100))


@query("read_qc", """SELECT i::INT AS cycle, count(*) AS n, sum(ascii(qual[i]) - 33)::BIGINT AS q_sum, count(*) FILTER (ascii(qual[i]) - 33 >= 30) AS q30, count(*) FILTER (seq[i] IN ('G', 'C')) AS gc, count(*) FILTER (seq[i] = 'N') AS n_bases FROM fx_reads, range(1, 101) t(i) GROUP BY 1""")
def _(t):
    r = t.fx_reads.select(F.posexplode(F.arrays_zip(F.split("seq", "").alias("b"), F.split("qual", "").alias("q"))).alias("i", "x")).filter(F.col("x.b") != "")
    q = F.ascii("x.q") - 33
    return r.groupBy((F.col("i") + 1).alias("cycle")).agg(F.count("*").alias("n"), F.sum(q).alias("q_sum"), F.count(F.when(q >= 30, 1)).alias("q30"), F.count(F.when(F.col("x.b").isin("G", "C"), 1)).alias("gc"), F.count(F.when(F.col("x.b") == "N", 1)).alias("n_bases"))


@query("alignment_qc", """SELECT count(*) AS reads, count(*) FILTER ((flag & 1024) <> 0) AS duplicates, count(*) FILTER ((flag & 16) <> 0) AS reverse_strand, count(*) FILTER (mapq = 0) AS mapq0, count(*)::DOUBLE * 0 + count(*) FILTER (mapq >= 20)::DOUBLE / count(*) AS confident FROM fx_reads""")
def _(t):
    bit = lambda b: F.count(F.when(F.col("flag").bitwiseAND(b) != 0, 1))
    return t.fx_reads.agg(F.count("*").alias("reads"), bit(1024).alias("duplicates"), bit(16).alias("reverse_strand"), F.count(F.when(F.col("mapq") == 0, 1)).alias("mapq0"), (F.count(F.when(F.col("mapq") >= 20, 1)).cast("double") / F.count("*")).alias("confident"))


@query("exon_runs", """WITH k AS (SELECT *, CASE WHEN ratio_pct < 70 THEN 'low' WHEN ratio_pct > 130 THEN 'high' ELSE 'normal' END AS kind FROM fx_exons),
 i AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY exon) - row_number() OVER (PARTITION BY gene, kind ORDER BY exon) AS island FROM k)
 SELECT gene, kind, min(exon) AS first_exon, max(exon) AS last_exon, count(*) AS n, sum(ratio_pct)::DOUBLE / count(*) AS mean_ratio FROM i WHERE kind <> 'normal' GROUP BY gene, kind, island HAVING count(*) >= 2""")
def _(t):
    kind = F.when(F.col("ratio_pct") < 70, "low").when(F.col("ratio_pct") > 130, "high").otherwise("normal")
    k = t.fx_exons.withColumn("kind", kind)
    island = F.row_number().over(Window.partitionBy("gene").orderBy("exon")) - F.row_number().over(Window.partitionBy("gene", "kind").orderBy("exon"))
    runs = k.withColumn("island", island).filter("kind <> 'normal'").groupBy("gene", "kind", "island").agg(F.min("exon").alias("first_exon"), F.max("exon").alias("last_exon"), F.count("*").alias("n"), (F.sum("ratio_pct").cast("double") / F.count("*")).alias("mean_ratio"))
    return runs.filter("n >= 2").drop("island")


@query("cnv_gene_summary", """SELECT gene, count(*) AS exons, min(ratio_pct) AS low, max(ratio_pct) AS high, count(*) FILTER (ratio_pct < 70) AS low_exons, CASE WHEN count(*) FILTER (ratio_pct < 70) * 2 >= count(*) THEN 'loss' WHEN count(*) FILTER (ratio_pct < 70) > 0 THEN 'partial' ELSE 'typical' END AS status FROM fx_exons GROUP BY 1""")
def _(t):
    low = F.count(F.when(F.col("ratio_pct") < 70, 1))
    g = t.fx_exons.groupBy("gene").agg(F.count("*").alias("exons"), F.min("ratio_pct").alias("low"), F.max("ratio_pct").alias("high"), low.alias("low_exons"))
    return g.withColumn("status", F.when(F.col("low_exons") * 2 >= F.col("exons"), "loss").when(F.col("low_exons") > 0, "partial").otherwise("typical"))


@query("gc_correction", """WITH b AS (SELECT *, gc_pct // 5 AS bin FROM fx_exons), n AS (SELECT bin, count(*) AS n FROM b GROUP BY 1), r AS (SELECT a.bin, min(w.w) AS radius FROM n a, range(0, 25) w(w) WHERE (SELECT sum(n.n) FROM n WHERE abs(n.bin - a.bin) <= w.w) >= 30 GROUP BY 1),
 m AS (SELECT r.bin, median(b.ratio_pct) AS med FROM r JOIN b ON abs(b.bin - r.bin) <= r.radius GROUP BY 1) SELECT gene, exon, b.bin, ratio_pct / med AS corrected FROM b JOIN m USING (bin)""")
def _(t):
    b = t.fx_exons.withColumn("bin", F.floor(F.col("gc_pct") / 5))
    n = b.groupBy("bin").agg(F.count("*").alias("n"))  # twenty bins of GC share at most
    near = n.select(F.col("bin"), F.explode(F.sequence(F.lit(-24), F.lit(24))).alias("d")).withColumn("other", F.col("bin") + F.col("d"))
    reach = near.join(n.select(F.col("bin").alias("other"), "n"), "other").groupBy("bin", F.abs("d").alias("w")).agg(F.sum("n").alias("n"))
    upto = reach.withColumn("upto", F.sum("n").over(Window.partitionBy("bin").orderBy("w")))
    radius = upto.filter("upto >= 30").groupBy("bin").agg(F.min("w").alias("radius"))
    pool = radius.select(F.col("bin").alias("home"), F.explode(F.sequence(F.col("bin") - F.col("radius"), F.col("bin") + F.col("radius"))).alias("bin"))
    med = b.join(F.broadcast(pool), "bin").groupBy("home").agg(F.median("ratio_pct").alias("med"))
    return b.join(F.broadcast(med), b["bin"] == med["home"]).select("gene", "exon", "bin", (F.col("ratio_pct") / F.col("med")).alias("corrected"))
