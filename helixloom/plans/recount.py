"""Queries that re-count reads: whole reads against both versions of insertions and deletions, and verdicts on calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alleles as A
from ..operators import recount as P
from .matching import read
from .registry import query
from .scores import _LOGP

c = F.col
#: The sequence is ACGT over and over, in chunks of 100 letters, as long as there are parts.
CHUNKS = "SELECT k.k AS chrom_order, p_partkey - 1 AS chunk, repeat('ACGT', 25) AS seq FROM part CROSS JOIN (SELECT DISTINCT s_suppkey % 25 AS k FROM supplier) k"
TARGETS = "SELECT chrom_order, chrom, pos, ref, alt, gt FROM fx_variants WHERE length(ref) <> length(alt) AND (pos + chrom_order) % 3 = 0"
#: Reads of the table, and twelve reads over every insertion that fits the sequence: most show it, some show neither version.
SHOWN = """SELECT chrom_order, s + (j % 2) * 6 AS start_pos, s + 100 AS end_pos, (j % 2) * 16 + CASE WHEN (pos + j) % 13 = 0 THEN 1024 ELSE 0 END AS flag, (pos + j) % 40 + 10 AS mapq,
  CASE WHEN j % 2 = 1 THEN '6S94M' ELSE '100M' END AS cigar, CASE WHEN j % 6 = 5 THEN repeat('AC', 50) ELSE substr(repeat('ACGT', 80), 1 + s % 4, pos - s) || 'TG' || substr(repeat('ACGT', 80), 1 + pos % 4, 98 - (pos - s)) END AS seq,
  repeat(CASE WHEN (pos + j) % 9 = 0 THEN '!' ELSE 'I' END, 100) AS qual
 FROM (SELECT v.*, j.j, v.pos - 10 - 7 * j.j AS s FROM fx_variants v CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS j(j) WHERE length(v.alt) = 3 AND length(v.ref) = 1 AND v.ref = substr('ACGT', 1 + (v.pos - 1) % 4, 1) AND (v.pos + v.chrom_order) % 3 = 0) x"""
READS = f"SELECT chrom_order, start_pos, start_pos + 100 AS end_pos, flag, mapq, cigar, seq, qual FROM fx_reads UNION ALL {SHOWN}"


@query("indel_recounts", f"""WITH t AS (SELECT DISTINCT chrom_order, pos, ref, alt FROM ({TARGETS})), n AS (SELECT max(p_partkey) * 100 AS n FROM part), f AS (SELECT t.*, greatest(0, pos - 301) AS fs, least(pos - 1 + length(ref) + 300, n) AS fe, n FROM t, n),
 w AS (SELECT *, substr(repeat('ACGT', 200), 1 + fs % 4, fe - fs) AS hap, pos - 4 AS ws, pos - 1 + CASE WHEN ref = 'G' THEN 5 ELSE 4 END AS we, CASE WHEN fs >= n THEN 'no sequence' WHEN pos - 1 + length(ref) > n OR substr('ACGTACGT', 1 + (pos - 1) % 4, length(ref)) <> ref THEN 'other letters' WHEN pos - 1 + CASE WHEN ref = 'G' THEN 5 ELSE 4 END > fe THEN 'wide repeat' END AS note FROM f),
 r AS (SELECT *, row_number() OVER () AS id, CASE WHEN cigar LIKE '6S%' THEN 6 ELSE 0 END AS lead FROM ({READS}) WHERE (flag & 3844) = 0),
 p AS (SELECT w.chrom_order, w.pos, w.ref, w.alt, r.id, r.mapq < 20 AS low, r.flag, r.qual[1] = '!' AS poor, r.seq, w.hap, substr(w.hap, 1, w.pos - w.fs) || 'TG' || substr(w.hap, w.pos - w.fs + 1) AS alt_hap, r.start_pos - r.lead - w.fs AS est
  FROM w JOIN r ON w.note IS NULL AND r.chrom_order = w.chrom_order AND r.start_pos < w.we + 12 AND r.end_pos > w.ws - 12),
 m AS (SELECT p.*, (SELECT min(CASE WHEN poor THEN 0 ELSE hamming(seq, substr(hap, (est + s + 1)::INT, 100)) END) FROM range(-14, 15) g(s) WHERE est + s BETWEEN 0 AND length(hap) - 100) AS x, (SELECT min(CASE WHEN poor THEN 0 ELSE hamming(seq, substr(alt_hap, (est + s + 1)::INT, 100)) END) FROM range(-14, 15) g(s) WHERE est + s BETWEEN 0 AND length(alt_hap) - 100) AS y FROM p WHERE NOT low),
 q AS (SELECT *, CASE WHEN x IS NULL OR y IS NULL THEN 'none' WHEN least(x, y) > 8 THEN 'other' WHEN y <= x - 2 THEN 'alt' WHEN x <= y - 2 THEN 'ref' ELSE 'none' END AS fit FROM m),
 k AS (SELECT chrom_order, pos, ref, alt, count(*) FILTER (fit = 'ref') AS rr, count(*) FILTER (fit = 'alt') AS aa, count(*) FILTER (fit = 'other') AS oo, count(*) FILTER (fit = 'none') AS nn, count(*) FILTER (fit = 'ref' AND (flag & 16) = 0) AS rf, count(*) FILTER (fit = 'alt' AND (flag & 16) = 0) AS af FROM q GROUP BY 1, 2, 3, 4),
 l AS (SELECT chrom_order, pos, ref, alt, count(*) AS ll FROM p WHERE low GROUP BY 1, 2, 3, 4)
 SELECT chrom_order, pos, ref, alt, note, CASE WHEN note IS NULL THEN coalesce(ll, 0) END AS low_mapq, CASE WHEN note IS NULL THEN coalesce(rr, 0) END AS ref_reads, CASE WHEN note IS NULL THEN coalesce(aa, 0) END AS alt_reads, CASE WHEN note IS NULL THEN coalesce(oo, 0) END AS other,
  CASE WHEN note IS NULL THEN coalesce(nn, 0) END AS not_spanning, CASE WHEN note IS NULL THEN coalesce(rf, 0) END AS ref_fwd, CASE WHEN note IS NULL THEN coalesce(af, 0) END AS alt_fwd FROM w LEFT JOIN k USING (chrom_order, pos, ref, alt) LEFT JOIN l USING (chrom_order, pos, ref, alt)""")
def _(t):
    t = t.written("fx_variants")  # targets and reads are made of it
    return P.recount(read(t, TARGETS), read(t, READS), read(t, CHUNKS), 100).drop("low_baseq")


@query("indel_verdicts")
def _(t):
    t = t.written("fx_variants")  # targets and reads are made of it
    targets = read(t, TARGETS)
    known = targets.groupBy(*P.KEY).agg(F.max(F.when(c("gt") != "./.", F.regexp_count("gt", F.lit("1")))).alias("expected"), F.max("chrom").alias("chrom"))
    counts = P.recount(targets, read(t, READS), read(t, CHUNKS), 100).join(known, P.KEY)
    counts = counts.withColumns({"ploidy": A.ploidy(c("chrom"), c("pos"), F.lit("XY")), "others": F.lit(0)})
    counts = counts.withColumn("expected", F.least("expected", "ploidy"))
    return P.judged(counts).select(*P.KEY, "reads", "expected", "ploidy", "observed", "status", "flags", "note")


@query("site_verdicts", f"""WITH s AS (SELECT *, CASE chrom_order WHEN 22 THEN 1 WHEN 23 THEN 1 ELSE 2 END AS ploidy, least(ref_reads, ref_fwd_cap) AS a, ref_reads - least(ref_reads, ref_fwd_cap) AS b, least(alt_reads, alt_fwd_cap) AS cc, alt_reads - least(alt_reads, alt_fwd_cap) AS d FROM fx_sites),
 ll AS (SELECT *, ref_reads + alt_reads AS n, alt_reads * log10(0.02) + ref_reads * log10(0.98) AS l0, CASE WHEN ploidy = 2 THEN (alt_reads + ref_reads) * log10(0.5) END AS l1, alt_reads * log10(0.98) + ref_reads * log10(1 - 0.98::DOUBLE) AS l2 FROM s),
 be AS (SELECT *, CASE WHEN l0 >= coalesce(l1, l0) AND l0 >= l2 THEN 0 WHEN l1 IS NOT NULL AND l1 >= l2 THEN 1 ELSE ploidy END AS best, CASE WHEN l1 IS NULL THEN abs(l0 - l2) ELSE greatest(l0, l1, l2) - (l0 + l1 + l2 - greatest(l0, l1, l2) - least(l0, l1, l2)) END AS lod FROM ll),
 m AS (SELECT site_id, a, a + b + cc + d AS n, a + b AS r1, a + cc AS c1 FROM s WHERE alt_reads >= 6 AND ref_reads >= 6), e AS (SELECT *, unnest(range(greatest(0, c1 - (n - r1)), least(r1, c1) + 1)) AS x FROM m), lp AS (SELECT site_id, a, x, {_LOGP} AS lp FROM e),
 h AS (SELECT site_id, lp AS here FROM lp WHERE x = a), p AS (SELECT site_id, sum(exp(lp)) FILTER (lp <= here + 1e-9) AS p FROM lp JOIN h USING (site_id) GROUP BY 1)
 SELECT site_id, ploidy, n AS reads, CASE WHEN n > 0 THEN best END AS observed, CASE WHEN n = 0 THEN 'not_checkable' WHEN expected IS NULL THEN 'not_called' WHEN best = expected THEN CASE WHEN lod >= 2 AND n >= 8 THEN 'confirmed' ELSE 'weak' END ELSE CASE WHEN lod >= 2 AND n >= 8 THEN 'disagrees' ELSE 'unclear' END END AS status,
  list_filter([CASE WHEN low_mapq >= 3 AND low_mapq >= 0.3 * (n + low_mapq) THEN 'look_alike' END, CASE WHEN p.p < 0.001 THEN 'one_strand' END], lambda x: x IS NOT NULL) AS flags FROM be LEFT JOIN p USING (site_id)""")
def _(t):
    s = t.fx_sites.withColumns({"ref_fwd": F.least("ref_reads", "ref_fwd_cap"), "alt_fwd": F.least("alt_reads", "alt_fwd_cap"), "other": F.lit(0), "others": F.lit(0), "note": F.lit(None).cast("string")})
    chrom = F.when(c("chrom_order") == 22, "X").when(c("chrom_order") == 23, "Y").otherwise("1")
    s = s.withColumn("ploidy", A.ploidy(chrom, F.lit(50_000_000), F.lit("XY")))
    return P.judged(s).select("site_id", "ploidy", "reads", "observed", "status", "flags")
