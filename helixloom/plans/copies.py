"""Queries of copy numbers, reference checks, absolute risk, public tables and citations."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import risk as K
from ..operators import copies as P
from ..operators import release as L
from ..operators import text as X
from .matching import read
from .registry import query

c = F.col
EXONS = "SELECT 'G' || CAST(p_partkey % 60 AS STRING) AS gene, CAST(p_partkey AS INT) AS exon, CAST(p_partkey % 25 AS INT) AS chrom_order, CAST(20 + p_size AS INT) AS gc_pct, CAST(50 + p_partkey * 7 % 60 AS DOUBLE) AS depth FROM part"


@query("exon_ratios", f"WITH e AS ({EXONS}), m AS (SELECT median(depth) AS mid FROM e WHERE chrom_order < 22) SELECT gene, exon, depth * CASE WHEN chrom_order IN (22, 23) THEN 2 ELSE 1 END / mid AS ratio FROM e, m")
def _(t):
    return P.exon_ratios(read(t, EXONS), True)


@query("gc_corrected_ratios", f"""WITH e AS (SELECT *, gc_pct // 5 AS bin, depth / 80 AS ratio FROM ({EXONS})), b AS (SELECT bin, count(*) AS n FROM e GROUP BY 1), r AS (SELECT a.bin, abs(a.bin - o.bin) AS r FROM b a, b o),
 h AS (SELECT DISTINCT r.bin, r.r, (SELECT sum(o.n) FROM b o WHERE abs(o.bin - r.bin) <= r.r) AS held FROM r), d AS (SELECT bin, coalesce(min(r) FILTER (held >= 30), max(r)) AS radius FROM h GROUP BY 1),
 p AS (SELECT d.bin AS pool, e.ratio FROM d JOIN e ON abs(e.bin - d.bin) <= d.radius), m AS (SELECT pool, median(ratio) AS mid FROM p GROUP BY 1), s AS (SELECT pool, median(abs(ratio / mid - 1)) * 1.4826 AS mad FROM p JOIN m USING (pool) GROUP BY 1)
 SELECT gene, exon, ratio / mid AS gc_ratio, (ratio / mid - 1) / nullif(mad, 0) AS gc_z FROM e JOIN m ON m.pool = e.bin JOIN s ON s.pool = e.bin""")
def _(t):
    return P.gc_corrected(read(t, EXONS).withColumn("ratio", c("depth") / 80)).select("gene", "exon", "gc_ratio", "gc_z")


BREAKS = "SELECT 'G' || CAST(p_partkey % 60 AS STRING) AS gene, CAST(p_partkey * 100 - 300 AS INT) AS start_pos, CAST(p_partkey * 100 + p_size * 40 AS INT) AS end_pos, CASE WHEN p_partkey % 2 = 0 THEN 'DEL' ELSE 'DUP' END AS kind FROM part WHERE p_partkey % 5 = 0"
RUNS = "SELECT gene, CAST(min(start_pos) AS INT) AS start_pos, CAST(max(end_pos) AS INT) AS end_pos, 'DEL' AS kind, count(*) AS exons FROM fx_exons WHERE ratio_pct = 50 GROUP BY gene, floor(exon / 200)"
DEPTHS = "SELECT gene, start_pos, end_pos, CASE WHEN ratio_pct = 50 THEN 'DEL' WHEN ratio_pct > 105 THEN 'DUP' END AS kind FROM fx_exons"


@query("copy_events", f"""WITH b AS ({BREAKS}), r AS ({RUNS}), e AS ({DEPTHS}), h AS (SELECT b.*, (SELECT count(*) FROM e WHERE e.gene = b.gene AND e.start_pos < b.end_pos AND b.start_pos < e.end_pos) AS n, (SELECT count(*) FROM e WHERE e.gene = b.gene AND e.start_pos < b.end_pos AND b.start_pos < e.end_pos AND e.kind = b.kind) AS k FROM b)
 SELECT gene, start_pos, end_pos, kind, true AS breakpoint, n > 0 AND 2 * k >= n AS depth_support, n AS exons FROM h UNION ALL SELECT gene, start_pos, end_pos, kind, false, true, exons FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.gene = r.gene AND b.kind = r.kind AND r.start_pos < b.end_pos AND b.start_pos < r.end_pos)""")
def _(t):
    return P.copy_events(read(t, BREAKS), read(t, RUNS), read(t, DEPTHS))


CHUNKS = "SELECT k.k AS chrom_order, floor(c.p_partkey) AS chunk, repeat(substr('ACGTACGT', CAST(1 + c.p_partkey % 4 AS INT), 4), 26) AS seq FROM (SELECT DISTINCT p_partkey FROM part) c CROSS JOIN (VALUES (0), (3), (9)) AS k(k)"


@query("reference_mismatches", f"WITH h AS ({CHUNKS}) SELECT v.chrom_order, v.pos, v.ref, v.alt FROM fx_variants v JOIN h ON v.chrom_order = h.chrom_order AND (v.pos - 1) // 100 = h.chunk WHERE substr(h.seq, (v.pos - 1) % 100 + 1, length(v.ref)) <> v.ref")
def _(t):
    return P.reference_mismatches(t.fx_variants.select("chrom_order", "pos", "ref", "alt"), read(t, CHUNKS), 100)


@query("insertion_counts", """WITH p AS (SELECT DISTINCT chrom_order, pos FROM fx_variants WHERE pos % 3 = 0), j AS (SELECT p.*, r.cigar = '48M2I2D50M' AND p.pos - r.start_pos = 48 AS hit FROM p JOIN fx_reads r ON p.chrom_order = r.chrom_order AND p.pos > r.start_pos AND p.pos <= r.start_pos + 100 WHERE r.mapq >= 20 AND (r.flag & 3844) = 0)
 SELECT chrom_order, pos, count(*) FILTER (hit) AS insertions, count(*) FILTER (NOT hit) AS others FROM j GROUP BY 1, 2""")
def _(t):
    points = t.fx_variants.filter("pos % 3 = 0").select("chrom_order", "pos").distinct()
    return P.insertion_counts(t.fx_reads.withColumn("end_pos", c("start_pos") + 100), points)


WANTED = "SELECT gene FROM fx_claims_new UNION SELECT gene FROM fx_exons"
PLAIN = "SELECT 'G' || CAST(c_custkey % 60 AS STRING) AS gene, 'About ' || c_name AS text FROM customer WHERE c_custkey % 60 < 20"
CURATED = "SELECT 'G' || CAST(p_partkey % 60 AS STRING) AS gene, 'Summary ' || CAST(p_partkey AS STRING) AS summary FROM part WHERE p_partkey % 60 BETWEEN 10 AND 40"


@query("gene_about", f"WITH w AS ({WANTED}), p AS ({PLAIN}), s AS ({CURATED}) SELECT gene, coalesce((SELECT min(text) FROM p WHERE p.gene = w.gene), (SELECT min(summary) FROM s WHERE s.gene = w.gene)) AS text, CASE WHEN gene IN (SELECT gene FROM p) THEN 'plain' WHEN gene IN (SELECT gene FROM s) THEN 'curated' END AS source FROM w")
def _(t):
    return P.gene_about(read(t, WANTED), read(t, PLAIN), read(t, CURATED))


RISK = "SELECT pgs_id, z, CAST(1 + independent_n % 9 AS DOUBLE) / 4 + 0.8 AS effect, CAST(1 + independent_n % 19 AS DOUBLE) / 100 AS baseline, 0.55 + CAST(independent_n % 8 AS DOUBLE) / 20 AS auc FROM fx_scores WHERE z IS NOT NULL"


_D = ", ".join(f"({k}, {NormalDist().inv_cdf(0.55 + k / 20) * 2**0.5!r})" for k in range(8))


@query("risk_from_curve", f"""WITH r AS (SELECT *, CAST(round((auc - 0.55) * 20) AS INT) AS k FROM ({RISK})), d AS (SELECT k, d::DOUBLE AS d FROM (VALUES {_D}) AS v(k, d)), s AS (SELECT pgs_id, d, baseline, baseline * d + z * sqrt(1 + baseline * (1 - baseline) * d * d) AS s FROM r JOIN d USING (k))
 SELECT pgs_id, baseline * exp(-(s - d) * (s - d) / 2) / (baseline * exp(-(s - d) * (s - d) / 2) + (1 - baseline) * exp(-s * s / 2)) AS risk FROM s""")
def _(t):
    return read(t, RISK).select("pgs_id", K.from_auroc(c("z"), c("auc"), c("baseline")).alias("risk"))


_NODES = ", ".join(f"({x!r}::DOUBLE, {w!r}::DOUBLE)" for x, w in zip(*(v.tolist() for v in K._normal())))
_MEAN = {"odds": "sum(g.w / (1 + exp(-(m + ln(effect) * g.x))))", "hazard": "sum(g.w * (1 - exp(-m * exp(ln(effect) * g.x))))"}
_ENDS = {"odds": (-40, 40), "hazard": (0, 50)}


def bisected(kind: str, pairs: str) -> str:
    """Tables g_, b_ and i_kind: the intercept of each (effect, baseline) of `pairs` by a hundred bisections."""
    lo, hi = _ENDS[kind]
    return f"""g_{kind}(x, w) AS (VALUES {_NODES}), b_{kind}(n, effect, baseline, lo, hi) AS (SELECT 0, effect, baseline, {lo}::DOUBLE, {hi}::DOUBLE FROM (SELECT DISTINCT effect, baseline FROM {pairs}) UNION ALL
  SELECT n + 1, effect, baseline, CASE WHEN low THEN m ELSE lo END, CASE WHEN low THEN hi ELSE m END FROM (SELECT *, (SELECT {_MEAN[kind]} FROM g_{kind} g) < baseline AS low FROM (SELECT *, (lo + hi) / 2 AS m FROM b_{kind} WHERE n < 100))), i_{kind} AS (SELECT effect, baseline, (lo + hi) / 2 AS i FROM b_{kind} WHERE n = 100)"""


@query("risk_per_sd", f"""WITH RECURSIVE r AS ({RISK}), {bisected("odds", "r")}, {bisected("hazard", "r")} SELECT pgs_id, 'odds' AS kind, 1 / (1 + exp(-(i + ln(effect) * z))) AS risk FROM r JOIN i_odds USING (effect, baseline)
 UNION ALL SELECT pgs_id, 'hazard', 1 - exp(-i * exp(ln(effect) * z)) FROM r JOIN i_hazard USING (effect, baseline)""")
def _(t):
    r = read(t, RISK)
    return K.per_sd(r, False).select("pgs_id", F.lit("odds").alias("kind"), "risk").unionByName(K.per_sd(r, True).select("pgs_id", F.lit("hazard").alias("kind"), "risk"))


@query("public_variants", """WITH RECURSIVE v AS (SELECT k.chrom_order, k.pos, k.ref, k.alt, k.af_1kg::FLOAT AS af_1kg FROM fx_known k), n AS (SELECT chrom_order, count(*) AS n, row_number() OVER (ORDER BY chrom_order) AS k FROM v GROUP BY 1), w(k, chrom_order, part, used) AS (SELECT k, chrom_order, 0, n FROM n WHERE k = 1 UNION ALL
 SELECT n.k, n.chrom_order, CASE WHEN w.used + n.n > 500 THEN w.part + 1 ELSE w.part END, CASE WHEN w.used + n.n > 500 THEN n.n ELSE w.used + n.n END FROM w JOIN n ON n.k = w.k + 1) SELECT v.chrom_order, pos, ref, alt, af_1kg, part FROM v JOIN w USING (chrom_order)""")
def _(t):
    private = ("variation_id", "significance", "stars", "popmax_raw", "flag_raw", "gene", "conflicts")
    return L.export_public(t.fx_known, private, "chrom_order", 500)


@query("release_overview", "SELECT 'claims' AS table_name, count(*) AS n_rows FROM fx_claims_new UNION ALL SELECT 'scores', count(*) FROM fx_scores")
def _(t):
    return L.overview({"claims": t.fx_claims_new, "scores": t.fx_scores})


BLOCKS = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN coalesce(lang, '') ELSE 'As found [[claims:c' || CAST(doc_id % 200 AS STRING) || ']] and [[scores:PGS' || CAST(doc_id AS STRING) || ']]' || CASE WHEN doc_id % 5 = 0 THEN ' but [[secrets:x]]' ELSE '' END END AS block FROM documents"


@query("citation_check", f"""WITH b AS ({BLOCKS}), c AS (SELECT doc_id, unnest(CASE WHEN doc_id % 7 = 0 THEN [NULL] ELSE list_concat(['claims:c' || (doc_id % 200), 'scores:PGS' || doc_id], CASE WHEN doc_id % 5 = 0 THEN ['secrets:x'] ELSE [] END) END) AS ref FROM b),
 o AS (SELECT 'claims:' || claim_id AS ref, concat_ws('|', overall, statement) AS f FROM fx_claims_old UNION ALL SELECT 'scores:' || pgs_id, coalesce(percentile::VARCHAR, '') FROM fx_scores), n AS (SELECT 'claims:' || claim_id AS ref, concat_ws('|', overall, statement) AS f FROM fx_claims_new UNION ALL SELECT 'scores:' || pgs_id, coalesce(percentile::VARCHAR, '') FROM fx_scores)
 SELECT doc_id, c.ref, CASE WHEN c.ref IS NULL THEN 'uncited' WHEN c.ref LIKE 'secrets:%' THEN 'unknown table' WHEN n.ref IS NULL THEN 'missing' WHEN n.f IS DISTINCT FROM o.f THEN 'stale' ELSE 'ok' END AS status FROM c LEFT JOIN o USING (ref) LEFT JOIN n USING (ref)""")
def _(t):
    def rows(claims):
        a = claims.select(F.concat(F.lit("claims:"), "claim_id").alias("ref"), F.concat_ws("|", "overall", "statement").alias("fingerprint"))
        return a.unionByName(t.fx_scores.select(F.concat(F.lit("scores:"), "pgs_id").alias("ref"), F.coalesce(c("percentile").cast("string"), F.lit("")).alias("fingerprint")))

    return X.citation_check(read(t, BLOCKS), rows(t.fx_claims_old), rows(t.fx_claims_new), ("claims", "scores"))


@query("first_author_match", "SELECT c_custkey, c_custkey % 4 IN (0, 2) AS matches FROM customer")
def _(t):
    cited = F.when(c("c_custkey") % 4 == 0, "Van der Berg J, 2020").when(c("c_custkey") % 4 == 1, "Smith A, 2019").when(c("c_custkey") % 4 == 2, "MÜLLER et al.").otherwise(F.lit(None).cast("string"))
    live = F.when(c("c_custkey") % 4 == 0, "van der Berg").when(c("c_custkey") % 4 == 1, "Smithson").when(c("c_custkey") % 4 == 2, "Müller")
    return t.customer.select("c_custkey", X.first_author_match(cited, live).alias("matches"))


@query("sampled_links", "WITH u AS (SELECT url, min(page_id) AS p FROM pages WHERE url IS NOT NULL GROUP BY 1) SELECT url, false AS fixed FROM (SELECT url, row_number() OVER (ORDER BY md5('7:' || url)) AS k FROM u WHERE NOT regexp_matches(url, '^https?://[^/?#]+/?$')) WHERE k <= 40 UNION ALL SELECT url, true FROM u WHERE regexp_matches(url, '^https?://[^/?#]+/?$')")
def _(t):
    return X.sample_links(t.pages, "url", 40, 7)
