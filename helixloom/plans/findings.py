"""Queries over graded findings and what changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import findings as N
from .matching import read
from .registry import query
from .scores import LL, _sites

c = F.col
CLAIMS = "SELECT 'f' || CAST(o_orderkey AS STRING) AS claim_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 100000000 ELSE 0 END END AS key, CAST(o_custkey % 3 AS INT) AS evidence, CAST(o_orderkey % 4 AS INT) AS call FROM orders"


@query("apply_recount", f"""WITH {LL}, a AS ({CLAIMS}), j AS (SELECT a.*, ve.status, coalesce(low_mapq >= 3 AND low_mapq >= 0.3 * (n + low_mapq), false) AS look FROM a LEFT JOIN ve ON a.key = ve.site_id),
 b AS (SELECT *, CASE WHEN status IS NULL OR call = 0 THEN call WHEN status = 'disagrees' THEN least(call, 1) WHEN status IN ('weak', 'unclear') OR look THEN least(call, 2) ELSE call END AS after FROM j)
 SELECT claim_id, status, ['Not callable', 'Low', 'Medium', 'High'][after + 1] AS call_level, ['Not callable', 'Limited', 'Moderate', 'Strong'][least(evidence + 1, after) + 1] AS overall FROM b""")
def _(t):
    from ..functions.reads import look_alike

    s = _sites(t).select(c("site_id").alias("key"), "status", look_alike(c("ref_reads"), c("alt_reads"), c("low_mapq")).alias("look_alike"), F.lit(False).alias("one_strand"))
    return N.apply_recount(read(t, CLAIMS), s)


@query("claim_sources", """SELECT variation_id, pos, ref, alt, chrom_order, list_filter([CASE WHEN significance IS NOT NULL THEN 'clinvar|2026-06|' || variation_id || '|https://www.ncbi.nlm.nih.gov/clinvar/variation/' || variation_id || '/' END, CASE WHEN popmax_raw >= 0 THEN 'gnomad|4.1|' || chrom_order || '-' || pos || '|https://gnomad.broadinstitute.org/variant/' || chrom_order || '-' || pos || '-' || ref || '-' || alt END,
 CASE WHEN af_1kg IS NOT NULL THEN '1000g||' || pos || '|https://www.internationalgenome.org/' END], lambda x: x IS NOT NULL) AS sources FROM fx_known""")
def _(t):
    at = F.concat_ws("-", "chrom_order", "pos")
    parts = {
        "clinvar": (F.when(c("significance").isNotNull(), c("variation_id").cast("string")), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/clinvar/variation/"), c("variation_id").cast("string"), F.lit("/"))),
        "gnomad": (F.when(c("popmax_raw") >= 0, at), F.concat(F.lit("https://gnomad.broadinstitute.org/variant/"), F.concat_ws("-", "chrom_order", "pos", "ref", "alt"))),
        "1000g": (F.when(c("af_1kg").isNotNull(), c("pos").cast("string")), F.lit("https://www.internationalgenome.org/")),
    }
    s = N.sources_of(parts, {"clinvar": "2026-06", "gnomad": "4.1"})
    flat = F.transform(s, lambda x: F.concat(x["source"], F.lit("|"), F.coalesce(x["version"], F.lit("")), F.lit("|"), x["record"], F.lit("|"), x["url"]))
    return t.fx_known.select("variation_id", "pos", "ref", "alt", "chrom_order", flat.alias("sources"))


_BRANCH = {
    "monogenic": ("claims", "SELECT claim_id AS ref_key, gene AS title, overall, stars AS person FROM fx_claims_new WHERE section = 'BUILDING'"),
    "carrier": ("claims", "SELECT claim_id AS ref_key, gene AS title, overall, stars AS person FROM fx_claims_new WHERE section = 'MACHINERY'"),
    "risk": ("claims", "SELECT claim_id AS ref_key, gene AS title, overall, stars AS person FROM fx_claims_new WHERE section = 'FURNITURE' AND overall IN ('Strong', 'Moderate')"),
    "pgs": ("pgs_traits", "SELECT pgs_id AS ref_key, trait_group AS title, CASE WHEN independent_pubs >= 2 THEN 'Moderate' ELSE 'Limited' END AS overall, CAST(independent_n % 5 AS INT) AS person FROM fx_scores WHERE percentile <= 5 OR percentile >= 95"),
    "repeat": ("repeats", "SELECT CAST(case_id AS STRING) AS ref_key, 'R' || CAST(case_id % 9 AS STRING) AS title, CASE WHEN yes_2 THEN 'Not callable' ELSE 'Limited' END AS overall, CAST(case_id % 5 AS INT) AS person FROM fx_cases WHERE count_1 >= 36"),
}


@query("highlights", "WITH b AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{tab}' AS ref_table, * FROM ({sql})" for k, (tab, sql) in _BRANCH.items()) + """), h AS (SELECT *, md5(ref_table || ':' || ref_key) AS highlight_id, list_position(['monogenic', 'repeat', 'carrier', 'risk', 'pgs'], kind) AS ko, coalesce(list_position(['Strong', 'Moderate', 'Limited'], overall), 4) AS g FROM b)
 SELECT kind, ref_table, ref_key, title, overall, person, highlight_id, row_number() OVER (PARTITION BY person ORDER BY g, ko, title, highlight_id)::INT AS rank FROM h""")
def _(t):
    return N.highlights(*[read(t, sql).withColumns({"kind": F.lit(k), "ref_table": F.lit(tab)}) for k, (tab, sql) in _BRANCH.items()])


@query("union_claims", "SELECT claim_id, gene, overall, stars, NULL::DOUBLE AS percentile FROM fx_claims_new UNION ALL SELECT pgs_id, NULL, CASE WHEN independent_pubs >= 2 AND independent_n >= 20000 THEN 'Moderate' ELSE 'Limited' END, NULL, percentile FROM fx_scores WHERE passed")
def _(t):
    from ..functions import evidence as E

    pgs = t.fx_scores.filter("passed").select(c("pgs_id").alias("claim_id"), E.word(E.pgs_level(c("independent_pubs"), c("independent_n")), E.EVIDENCE).alias("overall"), "percentile")
    return N.union_claims(t.fx_claims_new.select("claim_id", "gene", "overall", "stars"), pgs)


DRUGS = "SELECT 'drug' || CAST(case_id % 60 AS STRING) AS drug, source, yes_2 AS matched, CASE case_id % 5 WHEN 0 THEN 'change' WHEN 1 THEN 'note' WHEN 2 THEN 'standard' WHEN 3 THEN 'none' ELSE 'note' END AS tier FROM fx_cases"


@query("drug_buckets", f"""WITH d AS ({DRUGS}), s AS (SELECT drug, source, max(CASE tier WHEN 'change' THEN 3 WHEN 'note' THEN 2 WHEN 'standard' THEN 1 ELSE 0 END) AS r FROM d WHERE matched AND source IN ('CPIC', 'DPWG') GROUP BY 1, 2), m AS (SELECT drug, max(r) AS r, min(r) AS lo FROM s GROUP BY 1)
 SELECT a.drug, coalesce(['none', 'standard', 'note', 'change'][m.r + 1], 'none') AS bucket, coalesce(m.lo <> m.r, false) AS differ FROM (SELECT DISTINCT drug FROM d) a LEFT JOIN m USING (drug)""")
def _(t):
    return N.drug_bucket(read(t, DRUGS))


EVALS = "SELECT case_id AS eval_id, 'PGS' || CAST(case_id % 50 AS STRING) AS pgs_id, CASE flagged WHEN 'true' THEN true WHEN 'false' THEN false END AS independent, CASE WHEN case_id % 4 = 0 THEN NULL ELSE size END AS odds_ratio, CASE WHEN case_id % 3 = 0 THEN 1.25 END AS hazard_ratio, CASE WHEN case_id % 5 < 2 THEN 0.75 END AS auroc, CASE WHEN case_id % 6 = 0 THEN NULL ELSE count_1 * 100 END AS n, CASE case_id % 4 WHEN 0 THEN 'per 1 SD' WHEN 1 THEN 'top 10% vs rest' WHEN 2 THEN 'Per standard deviation' END AS notes FROM fx_cases"
_UNIT = "CASE case_id % 4 WHEN 1 THEN 'between groups of people' WHEN 3 THEN 'of what is not told' ELSE 'for one standard deviation' END"


@query("best_evaluations", f"WITH e AS ({EVALS}) SELECT pgs_id, eval_id FROM (SELECT *, row_number() OVER (PARTITION BY pgs_id ORDER BY coalesce(independent, false) DESC, (coalesce(odds_ratio, 0) <> 0 OR coalesce(hazard_ratio, 0) <> 0 OR coalesce(auroc, 0) <> 0) DESC, coalesce(n, 0) DESC, eval_id DESC) AS k FROM e) WHERE k = 1")
def _(t):
    return N.best_evaluation(read(t, EVALS))


@query("effect_texts", f"""WITH e AS ({EVALS}), p AS (SELECT eval_id, eval_id AS case_id, list_filter([CASE WHEN coalesce(odds_ratio, 0) <> 0 THEN 'odds ratio ' || odds_ratio::VARCHAR || ' ' || {_UNIT} END, CASE WHEN hazard_ratio IS NOT NULL THEN 'hazard ratio 1.25 ' || {_UNIT} END, CASE WHEN auroc IS NOT NULL THEN 'area under the curve 0.75' END], lambda x: x IS NOT NULL) AS xs FROM e) SELECT eval_id, CASE WHEN len(xs) > 0 THEN array_to_string(xs, ', ') END AS text FROM p""")
def _(t):
    return N.effect_text(read(t, EVALS))


VERSIONS = "SELECT 'source' || CAST(n_nationkey AS STRING) AS source, CASE WHEN n_nationkey % 3 = 0 THEN '2026-02' ELSE '2026-01' END AS version FROM nation WHERE n_nationkey % 5 <> 1"
OLD_VERSIONS = "SELECT 'source' || CAST(n_nationkey AS STRING) AS source, '2026-01' AS version FROM nation WHERE n_nationkey % 5 <> 2"
_DELTA = f"o AS ({OLD_VERSIONS}), w AS ({VERSIONS}), de AS (SELECT coalesce(o.source, w.source) AS source, o.version AS was, w.version AS now, CASE WHEN o.source IS NULL THEN 'added' WHEN w.source IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM o FULL JOIN w ON o.source = w.source WHERE o.version IS DISTINCT FROM w.version)"


def _delta(t):
    return N.version_delta(read(t, OLD_VERSIONS), read(t, VERSIONS))


@query("version_delta", f"WITH {_DELTA} SELECT * FROM de")
def _(t):
    return _delta(t)


@query("why_changed", f"WITH {_DELTA}, f AS (SELECT c_custkey AS claim_id, unnest(['source' || (c_custkey % 25), 'source' || (c_custkey % 7)]) AS s FROM customer) SELECT claim_id, list_concat(coalesce(list_sort(list(DISTINCT s) FILTER (s IN (SELECT source FROM de))), []), ['evidence_model']) AS why FROM f GROUP BY 1")
def _(t):
    name = lambda n: F.concat(F.lit("source"), (c("c_custkey") % n).cast("string"))
    return N.why(t.customer.select(c("c_custkey").alias("claim_id"), F.array(name(25), name(7)).alias("sources")), _delta(t), True)


OLD_CLASS = "SELECT chrom_order, pos, ref, alt, CASE pos % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'pathogenic' END AS cls, stars, significance FROM fx_known WHERE pos % 7 <> 0"
NEW_CLASS = "SELECT chrom_order, pos, ref, alt, CASE WHEN pos % 5 = 0 THEN 'pathogenic' WHEN pos % 4 = 0 THEN 'benign' WHEN pos % 4 = 1 THEN 'uncertain' WHEN pos % 4 = 2 THEN 'pathogenic' END AS cls, CASE WHEN pos % 3 = 0 THEN stars + 1 ELSE stars END AS stars, CASE WHEN pos % 11 = 0 THEN 'reworded' ELSE significance END AS significance FROM fx_known WHERE pos % 8 <> 0"


@query("reclassified", f"""WITH o AS ({OLD_CLASS}), n AS ({NEW_CLASS}), j AS (SELECT coalesce(o.chrom_order, n.chrom_order) AS chrom_order, coalesce(o.pos, n.pos) AS pos, coalesce(o.ref, n.ref) AS ref, coalesce(o.alt, n.alt) AS alt, o.cls AS a, n.cls AS b, o.stars AS s, n.stars AS u, o.significance AS x, n.significance AS y FROM o FULL JOIN n ON o.chrom_order = n.chrom_order AND o.pos = n.pos AND o.ref = n.ref AND o.alt = n.alt)
 SELECT chrom_order, pos, ref, alt, CASE WHEN a IS DISTINCT FROM b THEN 'class' WHEN s IS DISTINCT FROM u THEN 'review' ELSE 'detail' END AS kind, coalesce(a, 'not listed') AS old_class, coalesce(b, 'not listed') AS new_class FROM j WHERE a IS DISTINCT FROM b OR (a = b AND (s IS DISTINCT FROM u OR x IS DISTINCT FROM y))""")
def _(t):
    return N.reclassified(read(t, OLD_CLASS), read(t, NEW_CLASS), ["chrom_order", "pos", "ref", "alt"])


@query("change_summary", f"""WITH {_DELTA}, k AS (SELECT count(*) FILTER (o.claim_id IS NULL) AS a, count(*) FILTER (n.claim_id IS NULL) AS r, count(*) FILTER (o.claim_id = n.claim_id AND (o.overall IS DISTINCT FROM n.overall OR o.stars IS DISTINCT FROM n.stars)) AS g,
 count(*) FILTER (o.claim_id = n.claim_id AND o.overall IS NOT DISTINCT FROM n.overall AND o.stars IS NOT DISTINCT FROM n.stars AND o.statement IS DISTINCT FROM n.statement) AS w FROM fx_claims_old o FULL JOIN fx_claims_new n ON o.claim_id = n.claim_id),
 d AS (SELECT array_to_string(list_sort(list(CASE kind WHEN 'added' THEN source || ' added (' || now || ')' WHEN 'removed' THEN source || ' removed' ELSE source || ' ' || was || ' to ' || now END)), ', ') AS d FROM de) SELECT d || '; findings +' || a || ' / -' || r || '; ' || g || ' regraded, ' || w || ' reworded' AS summary FROM k, d""")
def _(t):
    diff = C.graded_diff(C.snapshot_compare(t.fx_claims_old, t.fx_claims_new, ["claim_id"], ["section", "gene", "overall", "stars", "statement"]))
    return N.change_summary(diff.groupBy("what").agg(F.count("*").alias("n")), _delta(t))


@query("population_precision", """WITH k AS (SELECT site_id, label, CASE WHEN f.flagged = 'true' THEN 'flagged' WHEN greatest(f.popmax, f.af) IS NULL THEN 'not_seen' WHEN greatest(f.popmax, f.af) >= 0.01 THEN 'common' ELSE 'rare' END AS population FROM fx_sites s JOIN fx_cases f ON s.site_id % 200 = f.case_id)
 SELECT population, count(*) FILTER (label = 'tp') AS tp, count(*) FILTER (label = 'fp') AS fp, count(*) FILTER (label = 'tp') / nullif(count(*) FILTER (label IN ('tp', 'fp')), 0) AS precision_ FROM k GROUP BY 1""")
def _(t):
    from ..functions import evidence as E

    f = t.fx_cases.select("case_id", E.population_class(c("popmax"), c("af"), c("flagged") == "true").alias("population"))
    j = t.fx_sites.join(f, c("site_id") % 200 == c("case_id"))
    n = lambda x: F.count(F.when(c("label") == x, 1))
    return j.groupBy("population").agg(n("tp").alias("tp"), n("fp").alias("fp"), F.try_divide(n("tp"), n("tp") + n("fp")).alias("precision_"))
