"""Queries of targets, wrong claims, whole-read fits, absolute risks and diffs by specification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk as K
from ..operators import changes as C
from ..operators import fitting as T
from .copies import _D, bisected
from .matching import read
from .registry import query

c = F.col
COPIES = "SELECT chrom_order, pos, ref, alt, CASE gt WHEN '1/1' THEN 2 WHEN '0/1' THEN 1 ELSE 0 END AS copies, CASE WHEN chrom_order = 23 THEN 1 ELSE 2 END AS ploidy FROM fx_variants"


@query("claim_targets", f"WITH s AS ({COPIES}), k AS (SELECT * FROM s WHERE (pos + chrom_order) % 3 = 0) SELECT chrom_order, pos, ref, alt, least(copies, ploidy)::INT AS expected, ploidy, (SELECT sum(copies) FROM s WHERE s.chrom_order = k.chrom_order AND s.pos = k.pos)::BIGINT - copies AS others FROM k")
def _(t):
    s = read(t, COPIES)
    return T.claim_targets(s.filter("(pos + chrom_order) % 3 = 0"), s)


@query("wrong_claims", "SELECT site_id, truth AS copies, w.w::INT AS claimed FROM fx_sites, (SELECT unnest([0, 1, 2]) AS w) w WHERE w.w <> truth")
def _(t):
    return T.wrong_claims(t.fx_sites.select("site_id", c("truth").alias("copies")))


# Reads of a repeat with a deleted or an unchanged unit: by its key a read shows the reference, the variant, neither, or nothing.
PAIRS = "SELECT event_id % 500 AS target_id, event_id % 4 AS shows, 'GATTACATTTGCGGACCTA' AS head, 'CCATGATCGTTAGCAAGTC' AS tail FROM events"


@query("whole_read_fits", "SELECT event_id % 500 AS target_id, count(*) FILTER (event_id % 4 = 0) AS ref_reads, count(*) FILTER (event_id % 4 = 1) AS alt_reads, count(*) FILTER (event_id % 4 = 2) AS other_reads, count(*) FILTER (event_id % 4 = 3) AS unclear_reads FROM events GROUP BY 1")
def _(t):
    ref, alt = F.concat("head", F.lit("CAGCAGCAGCAG"), "tail"), F.concat("head", F.lit("CAGCAGCAG"), "tail")
    seq = F.when(c("shows") == 0, ref).when(c("shows") == 1, alt).when(c("shows") == 2, F.lit("ACGT" * 12)).otherwise(F.substring(c("head"), 1, 19))
    pairs = read(t, PAIRS).select("target_id", seq.alias("seq"), F.repeat(F.lit("I"), F.length(seq)).alias("qual"), F.lit(0).alias("at"), ref.alias("ref_version"), alt.alias("alt_version"))
    return T.fit_counts(T.fit_reads(pairs))


EVALS = "SELECT pgs_id, CASE WHEN independent_n % 3 = 0 THEN NULL ELSE 0.55 + CAST(independent_n % 8 AS DOUBLE) / 20 END AS auc, CASE WHEN independent_n % 5 < 2 THEN 1.5 END AS odds, independent_n % 4 = 0 AS clinical, CASE WHEN independent_pubs % 2 = 0 THEN CAST(1 + independent_n % 19 AS DOUBLE) / 100 END AS baseline, CAST(independent_n % 40 AS DOUBLE) / 100 AS case_share, z FROM fx_scores"


ROUTES = "SELECT pgs_id, CASE WHEN z IS NULL THEN 'no score' WHEN auc IS NOT NULL AND NOT clinical AND baseline IS NOT NULL THEN 'curve' WHEN auc IS NOT NULL AND NOT clinical AND case_share > 0 AND case_share <= 0.2 THEN 'curve, cohort' WHEN odds IS NOT NULL AND baseline IS NOT NULL THEN 'ratio' WHEN baseline IS NULL THEN 'no baseline' ELSE 'no effect' END AS route, CASE WHEN z IS NOT NULL THEN CASE WHEN auc IS NOT NULL AND NOT clinical THEN coalesce(baseline, CASE WHEN case_share > 0 AND case_share <= 0.2 THEN case_share END, NULL) WHEN odds IS NOT NULL THEN baseline END END AS used FROM e"


@query("absolute_risk_routes", f"WITH e AS ({EVALS}) {ROUTES}")
def _(t):
    return K.routes(read(t, EVALS)).select("pgs_id", "route", "used")


@query("absolute_risk", f"""WITH RECURSIVE e AS ({EVALS}), u AS ({ROUTES}), j AS (SELECT e.pgs_id, z, auc, odds AS effect, route, used AS baseline FROM e JOIN u ON e.pgs_id = u.pgs_id), q AS (SELECT effect, baseline FROM j WHERE route = 'ratio'), {bisected("odds", "q")},
 d AS (SELECT k, d::DOUBLE AS d FROM (VALUES {_D}) AS v(k, d)), s AS (SELECT *, baseline * d + z * sqrt(1 + baseline * (1 - baseline) * d * d) AS s FROM j LEFT JOIN d ON d.k = round((auc - 0.55) * 20))
 SELECT pgs_id, route, CASE WHEN route LIKE 'curve%' THEN baseline * exp(-(s - d) * (s - d) / 2) / (baseline * exp(-(s - d) * (s - d) / 2) + (1 - baseline) * exp(-s * s / 2)) WHEN route = 'ratio' THEN 1 / (1 + exp(-(i + ln(effect) * z))) END AS risk FROM s LEFT JOIN i_odds USING (effect, baseline)""")
def _(t):
    return K.absolute_risk(read(t, EVALS)).select("pgs_id", "route", "risk")


SPEC = [("claims", "fx_claims_old", "fx_claims_new", "claim_id", ["overall", "stars"], {})]


@query("result_diff", """SELECT 'claims' AS table_name, coalesce(o.claim_id, n.claim_id) AS key, CASE WHEN o.claim_id IS NULL THEN 'added' WHEN n.claim_id IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM fx_claims_old o FULL JOIN fx_claims_new n ON o.claim_id = n.claim_id WHERE o.claim_id IS NULL OR n.claim_id IS NULL OR o.overall IS DISTINCT FROM n.overall OR o.stars IS DISTINCT FROM n.stars
 UNION ALL SELECT 'scores', pgs_id, 'changed' FROM fx_scores WHERE independent_pubs = 1 AND percentile IS NOT NULL UNION ALL SELECT 'scores', pgs_id, 'removed' FROM fx_scores WHERE independent_pubs = 4""")
def _(t):
    moved = t.fx_scores.filter("independent_pubs <> 4").withColumn("percentile", c("percentile") + F.when(c("independent_pubs") == 1, 2.0).when(c("independent_pubs") == 2, 0.25).otherwise(0.0))
    spec = {"claims": (t.fx_claims_old, t.fx_claims_new, "claim_id", ["overall", "stars"], {}), "scores": (t.fx_scores, moved, "pgs_id", ["percentile"], {"percentile": 0.5})}
    return C.result_diff(spec)


@query("genes_without_exons", "SELECT gene FROM fx_csq EXCEPT ALL SELECT gene FROM fx_exons")
def _(t):
    return t.fx_csq.select("gene").exceptAll(t.fx_exons.select("gene"))
