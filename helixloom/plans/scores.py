"""Queries over polygenic scores, read counts and truth sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import reads as R
from ..functions.alleles import complement
from .registry import query

COMP = "translate({}, 'ACGT', 'TGCA')"
MATCH = """m AS (SELECT w.score_id, w.chrom_order, w.pos, w.effect_allele, w.other_allele, w.weight, w.af_pct, v.alt, v.gt, CASE WHEN w.effect_allele = v.alt AND w.other_allele = v.ref THEN 'direct' WHEN w.effect_allele = v.ref AND w.other_allele = v.alt THEN 'swapped'
 WHEN translate(w.effect_allele, 'ACGT', 'TGCA') = v.alt AND translate(w.other_allele, 'ACGT', 'TGCA') = v.ref THEN 'flipped' WHEN translate(w.effect_allele, 'ACGT', 'TGCA') = v.ref AND translate(w.other_allele, 'ACGT', 'TGCA') = v.alt THEN 'flipped_swapped' END AS kind
 FROM fx_weights w JOIN fx_variants v ON w.chrom_order = v.chrom_order AND w.pos = v.pos)"""


def match_weights(w, v):
    """Weights joined to alleles at their position, with how the letters agree; those that do not are left out."""
    j = w.join(v.select("chrom_order", "pos", "ref", "alt", "gt"), ["chrom_order", "pos"])
    e, o, a, r = F.col("effect_allele"), F.col("other_allele"), F.col("alt"), F.col("ref")
    kind = F.when((e == a) & (o == r), "direct").when((e == r) & (o == a), "swapped").when((complement(e) == a) & (complement(o) == r), "flipped").when((complement(e) == r) & (complement(o) == a), "flipped_swapped")
    return j.withColumn("kind", kind).filter("kind IS NOT NULL")


@query("pgs_match", f"WITH {MATCH} SELECT score_id, kind, count(*) AS n FROM m WHERE kind IS NOT NULL GROUP BY 1, 2")
def _(t):
    return match_weights(t.fx_weights, t.fx_variants).groupBy("score_id", "kind").agg(F.count("*").alias("n"))


DOSAGE = "CASE gt WHEN '1/1' THEN 2 WHEN '0/1' THEN 1 WHEN '0/0' THEN 0 END"


@query("score_samples", f"""WITH {MATCH}, d AS (SELECT *, CASE WHEN kind IN ('direct', 'flipped') THEN {DOSAGE} ELSE 2 - ({DOSAGE}) END AS dosage FROM m WHERE kind IS NOT NULL) SELECT score_id, sum(CASE WHEN dosage IS NULL THEN weight * 2 * af_pct ELSE weight * dosage * 100 END)::BIGINT / 100 AS score, count(*) AS n, count(*) FILTER (dosage IS NULL) AS missing FROM d GROUP BY 1""")
def _(t):
    m = match_weights(t.fx_weights, t.fx_variants)
    copies = F.when(F.col("gt") == "1/1", 2).when(F.col("gt") == "0/1", 1).when(F.col("gt") == "0/0", 0)
    m = m.withColumn("dosage", F.when(F.col("kind").isin("direct", "flipped"), copies).otherwise(2 - copies))
    return score_samples(m, ["score_id"], "af_pct")


def score_samples(matched, by, af_pct):
    """Sums of weight times copies; a missing genotype counts as twice the effect allele's frequency (in hundredths, so that
    sums are of whole numbers)."""
    share = F.coalesce(100 * F.col("dosage"), 2 * F.col(af_pct)).cast("bigint")
    return matched.groupBy(*by).agg((F.sum(F.col("weight") * share) / 100).alias("score"), F.count("*").alias("n"), F.count(F.when(F.col("dosage").isNull(), 1)).alias("missing"))


COHORT = "c AS (SELECT w.score_id, w.weight, w.af_pct, c.sample, c.dosage FROM fx_weights w JOIN (SELECT DISTINCT site_id * 100 AS at, sample, dosage FROM fx_cohort) c ON w.pos - (1 + (w.pos // 100) % 5) * 7 = c.at)"


@query("score_cohort", f"""WITH {COHORT} SELECT score_id, sample, sum(CASE WHEN dosage IS NULL THEN weight * 2 * af_pct ELSE weight * dosage * 100 END)::BIGINT / 100 AS score, count(*) AS n, count(*) FILTER (dosage IS NULL) AS missing FROM c GROUP BY 1, 2""")
def _(t):
    site = F.expr("pos div 100")
    w = t.fx_weights.withColumn("site_id", site.cast("bigint"))
    return score_samples(w.join(t.fx_cohort.select("site_id", "sample", "dosage"), "site_id"), ["score_id", "sample"], "af_pct")


@query("variant_filter", """WITH g AS (SELECT site_id, chrom_order, count(*) AS people, count(*) FILTER (dosage IS NULL) AS missing, count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1) AS n1, count(*) FILTER (dosage = 2) AS n2 FROM fx_cohort GROUP BY 1, 2),
 f AS (SELECT *, n0 + n1 + n2 AS n, (n1 + 2 * n2) / nullif(2.0 * (n0 + n1 + n2), 0) AS af FROM g),
 h AS (SELECT *, CASE WHEN af > 0 AND af < 1 THEN pow(n0 - n * (1 - af) * (1 - af), 2) / (n * (1 - af) * (1 - af)) + pow(n1 - 2 * n * af * (1 - af), 2) / (2 * n * af * (1 - af)) + pow(n2 - n * af * af, 2) / (n * af * af) END AS chi2 FROM f)
 SELECT site_id, n0, n1, n2, missing, af, chi2, chrom_order < 22 AND least(af, 1 - af) >= 0.05 AND missing <= 0.1 * people AND coalesce(chi2, 0) < 15.136705226623606 AS kept FROM h""")
def _(t):
    from ..operators.cohort import variant_filter

    return variant_filter(t.fx_cohort)


@query("sample_missingness", "SELECT sample, count(*) AS sites, count(*) FILTER (dosage IS NULL) AS missing, count(*) FILTER (dosage IS NULL) <= 0.1 * count(*) AS kept FROM fx_cohort GROUP BY 1")
def _(t):
    from ..operators.cohort import sample_missingness

    return sample_missingness(t.fx_cohort)


OK = "ok AS (SELECT * FROM fx_scores WHERE passed AND percentile IS NOT NULL AND z IS NOT NULL)"


@query("trait_summary", f"""WITH {OK}, st AS (SELECT trait_group, coalesce(pgp_id, pgs_id) AS study, median(percentile) AS p, median(z) AS z FROM ok GROUP BY 1, 2), h AS (SELECT trait_group, median(p) AS percentile, median(z) AS z, count(*) AS n_studies FROM st GROUP BY 1),
 g AS (SELECT trait_group, count(*) AS n_scored, min(percentile) AS low, max(percentile) AS high, min(z) AS zl, max(z) AS zh, arg_max(pgs_id, {{'a': independent_pubs, 'b': independent_n, 'c': pgs_id}}) AS best FROM ok GROUP BY 1), n AS (SELECT trait_group, count(*) AS n_scores, bool_or(featured) AS featured FROM fx_scores GROUP BY 1)
 SELECT n.trait_group, n_scores, featured, coalesce(n_scored, 0) AS n_scored, coalesce(n_studies, 0) AS n_studies, h.percentile, h.z, low, high, best AS best_pgs_id,
 CASE WHEN n_scored IS NULL THEN 'none' WHEN n_scored = 1 THEN 'single' WHEN zh - zl <= 1 THEN 'consistent' WHEN zl > 0 OR zh < 0 THEN 'same_direction' ELSE 'disagree' END AS agreement FROM n LEFT JOIN g USING (trait_group) LEFT JOIN h USING (trait_group)""")
def _(t):
    s = t.fx_scores
    ok = s.filter("passed AND percentile IS NOT NULL AND z IS NOT NULL")
    study = ok.groupBy("trait_group", F.coalesce("pgp_id", "pgs_id").alias("study")).agg(F.median("percentile").alias("p"), F.median("z").alias("z"))
    head = study.groupBy("trait_group").agg(F.median("p").alias("percentile"), F.median("z").alias("z"), F.count("*").alias("n_studies"))
    each = ok.groupBy("trait_group").agg(F.count("*").alias("n_scored"), F.min("percentile").alias("low"), F.max("percentile").alias("high"), F.min("z").alias("zl"), F.max("z").alias("zh"), F.max_by("pgs_id", F.struct("independent_pubs", "independent_n", "pgs_id")).alias("best_pgs_id"))
    every = s.groupBy("trait_group").agg(F.count("*").alias("n_scores"), F.bool_or("featured").alias("featured"))
    spread = F.col("zh") - F.col("zl")
    agree = F.when(F.col("n_scored").isNull(), "none").when(F.col("n_scored") == 1, "single").when(spread <= 1, "consistent").when((F.col("zl") > 0) | (F.col("zh") < 0), "same_direction").otherwise("disagree")
    j = every.join(each, "trait_group", "left").join(head, "trait_group", "left")
    return j.select("trait_group", "n_scores", "featured", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), F.coalesce("n_studies", F.lit(0)).alias("n_studies"), "percentile", "z", "low", "high", "best_pgs_id", agree.alias("agreement"))


@query("most_tested_score", f"WITH {OK} SELECT trait_group, pgs_id, independent_pubs, independent_n FROM (SELECT *, row_number() OVER (PARTITION BY trait_group ORDER BY independent_pubs DESC, independent_n DESC, featured DESC, pgs_id) AS k FROM ok) WHERE k = 1")
def _(t):
    from ..operators.windows import top_per

    ok = t.fx_scores.filter("passed AND percentile IS NOT NULL AND z IS NOT NULL")
    return top_per(ok, ["trait_group"], [F.desc("independent_pubs"), F.desc("independent_n"), F.desc("featured"), "pgs_id"], 1).select("trait_group", "pgs_id", "independent_pubs", "independent_n")


@query("select_scores", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY trait_group ORDER BY independent_pubs DESC, independent_n DESC, pgs_id) AS k FROM fx_scores WHERE featured OR independent_pubs >= 1) SELECT trait_group, pgs_id, CASE k WHEN 1 THEN 'main' ELSE 'alternate' END AS part FROM r WHERE k <= 3""")
def _(t):
    rank = F.row_number().over(Window.partitionBy("trait_group").orderBy(F.desc("independent_pubs"), F.desc("independent_n"), "pgs_id"))
    r = t.fx_scores.filter("featured OR independent_pubs >= 1").withColumn("k", rank).filter("k <= 3")
    return r.select("trait_group", "pgs_id", F.when(F.col("k") == 1, "main").otherwise("alternate").alias("part"))


@query("score_spread", "SELECT count(*) AS n, avg(z) AS mean_z, stddev_samp(z) AS sd_z, count(*) FILTER (abs(z) > 1.5) AS wide FROM fx_scores WHERE passed")
def _(t):
    return t.fx_scores.filter("passed").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"), F.count(F.when(F.abs("z") > 1.5, 1)).alias("wide"))


@query("percentile_words", """SELECT pgs_id, CASE WHEN percentile IS NULL THEN NULL WHEN percentile < 0.5 THEN 'below the 1st percentile' WHEN percentile > 99.5 THEN 'above the 99th percentile' ELSE floor(percentile + 0.5)::INT || CASE WHEN floor(percentile + 0.5)::INT % 100 IN (11, 12, 13) THEN 'th' WHEN floor(percentile + 0.5)::INT % 10 = 1 THEN 'st' WHEN floor(percentile + 0.5)::INT % 10 = 2 THEN 'nd' WHEN floor(percentile + 0.5)::INT % 10 = 3 THEN 'rd' ELSE 'th' END || ' percentile' END AS words FROM fx_scores""")
def _(t):
    p = F.col("percentile")
    n = F.floor(p + 0.5).cast("int")
    end = F.when((n % 100).isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return t.fx_scores.select("pgs_id", F.when(p < 0.5, "below the 1st percentile").when(p > 99.5, "above the 99th percentile").when(p.isNotNull(), F.concat(n.cast("string"), end, F.lit(" percentile"))).alias("words"))


@query("pgs_evidence", "SELECT pgs_id, CASE WHEN independent_pubs >= 2 AND independent_n >= 20000 THEN 'Moderate' ELSE 'Limited' END AS evidence_level FROM fx_scores")
def _(t):
    return t.fx_scores.select("pgs_id", E.word(E.pgs_level(F.col("independent_pubs"), F.col("independent_n")), E.EVIDENCE).alias("evidence_level"))


LL = """ll AS (SELECT *, ref_reads + alt_reads AS n, alt_reads * log10(0.02) + ref_reads * log10(0.98) AS l0, alt_reads * log10(0.5) + ref_reads * log10(0.5) AS l1, alt_reads * log10(0.98) + ref_reads * log10(0.02) AS l2 FROM fx_sites),
 be AS (SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS best, greatest(l0, l1, l2) - (l0 + l1 + l2 - greatest(l0, l1, l2) - least(l0, l1, l2)) AS lod FROM ll),
 ve AS (SELECT *, CASE WHEN n = 0 THEN 'not_checkable' WHEN expected IS NULL THEN 'not_called' WHEN best = expected THEN CASE WHEN lod >= 2 AND n >= 8 THEN 'confirmed' ELSE 'weak' END ELSE CASE WHEN lod >= 2 AND n >= 8 THEN 'disagrees' ELSE 'unclear' END END AS status FROM be)"""


def _sites(t):
    s, two = t.fx_sites, F.lit(2)
    c = F.col
    s = s.withColumn("best", R.best_copies(c("alt_reads"), c("ref_reads") + c("alt_reads"), two))
    return s.withColumn("status", R.verdict(c("ref_reads"), c("alt_reads"), c("expected"), two))


@query("genotype_likelihood", f"WITH {LL} SELECT site_id, best, lod FROM be")
def _(t):
    c, two = F.col, F.lit(2)
    return _sites(t).select("site_id", "best", R.lod(c("alt_reads"), c("ref_reads") + c("alt_reads"), two).alias("lod"))


@query("recount_verdict", f"WITH {LL} SELECT site_id, status, low_mapq >= 3 AND low_mapq >= 0.3 * (n + low_mapq) AS look_alike FROM ve")
def _(t):
    return _sites(t).select("site_id", "status", R.look_alike(F.col("ref_reads"), F.col("alt_reads"), F.col("low_mapq")).alias("look_alike"))


@query("recount_benchmark", f"""WITH {LL}, b AS (SELECT kind, reason IS NULL AS easy, expected = truth AS right_call, status FROM ve) SELECT coalesce(kind, 'all') AS kind, CASE WHEN grouping(easy) = 1 THEN 'all' WHEN easy THEN 'easy' ELSE 'hard' END AS region,
 count(*) AS n, count(*) FILTER (right_call AND status = 'confirmed') AS confirmed_right, count(*) FILTER (NOT right_call AND status = 'disagrees') AS caught_wrong, count(*) FILTER (NOT right_call AND status = 'confirmed') AS confirmed_wrong FROM b GROUP BY CUBE (kind, easy)""")
def _(t):
    b = _sites(t).select("kind", F.col("reason").isNull().alias("easy"), (F.col("expected") == F.col("truth")).alias("right_call"), "status")
    n = lambda c: F.count(F.when(c, 1))
    right, status = F.col("right_call"), F.col("status")
    g = b.cube("kind", "easy").agg(F.grouping("easy").alias("g"), F.count("*").alias("n"), n(right & (status == "confirmed")).alias("confirmed_right"), n(~right & (status == "disagrees")).alias("caught_wrong"), n(~right & (status == "confirmed")).alias("confirmed_wrong"))
    return g.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.when(F.col("g") == 1, "all").when(F.col("easy"), "easy").otherwise("hard").alias("region"), "n", "confirmed_right", "caught_wrong", "confirmed_wrong")


@query("caller_metrics", """WITH c AS (SELECT kind, count(*) FILTER (label = 'tp') AS tp, count(*) FILTER (label = 'fp') AS fp, count(*) FILTER (label = 'tp_base') AS tpb, count(*) FILTER (label = 'fn') AS fn FROM fx_sites GROUP BY 1), p AS (SELECT *, tp / nullif(tp + fp, 0) AS prec, tpb / nullif(tpb + fn, 0) AS rec FROM c)
 SELECT kind, tp, fp, tpb AS tp_base, fn, prec AS precision_, rec AS recall_, 2 * prec * rec / nullif(prec + rec, 0) AS f1 FROM p""")
def _(t):
    n = lambda x: F.count(F.when(F.col("label") == x, 1)).alias(x)
    c = t.fx_sites.groupBy("kind").agg(n("tp"), n("fp"), n("tp_base"), n("fn"))
    c = c.withColumns({"precision_": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall_": F.try_divide("tp_base", F.col("tp_base") + F.col("fn"))})
    return c.withColumn("f1", F.try_divide(2 * F.col("precision_") * F.col("recall_"), F.col("precision_") + F.col("recall_")))


@query("gene_verdicts", f"""WITH {LL}, r AS (SELECT *, 'G' || CAST(site_id // 200 AS VARCHAR) AS gene FROM ve), j AS (SELECT gene, count(*) AS positions, CASE WHEN bool_or(status = 'disagrees') THEN 'disagrees' WHEN bool_or(status = 'unclear') THEN 'unclear' WHEN bool_or(status = 'weak') THEN 'weak' ELSE 'confirmed' END AS status,
 list_sort(list(site_id || ' (' || status || ')') FILTER (status <> 'confirmed')) AS problems FROM r WHERE status IN ('disagrees', 'unclear', 'weak', 'confirmed') GROUP BY 1), u AS (SELECT gene, list_sort(list(site_id)) AS uncalled FROM r WHERE status = 'not_called' GROUP BY 1)
 SELECT gene, status, positions, coalesce(problems, []) AS problems, coalesce(uncalled, []) AS uncalled FROM j LEFT JOIN u USING (gene)""")
def _(t):
    return R.gene_verdicts(_sites(t).withColumn("gene", F.concat(F.lit("G"), F.expr("site_id div 200").cast("string"))))


@query("genotype_calibration", """WITH b AS (SELECT k.af_1kg, v.gt, CASE WHEN length(v.ref) = length(v.alt) THEN 'snp' ELSE 'indel' END AS kind, CASE WHEN k.af_1kg < 0.01 THEN 0 WHEN k.af_1kg < 0.05 THEN 1 WHEN k.af_1kg < 0.2 THEN 2 WHEN k.af_1kg < 0.5 THEN 3 WHEN k.af_1kg < 0.9 THEN 4 ELSE 5 END AS band FROM fx_known k JOIN fx_variants v USING (chrom_order, pos, ref, alt) WHERE k.af_1kg IS NOT NULL)
 SELECT kind, band, count(*) AS n, count(*) FILTER (gt = '0/0') / count(*) AS hom_ref, count(*) FILTER (gt = '0/1') / count(*) AS het, count(*) FILTER (gt = '1/1') / count(*) AS hom_alt, count(*) FILTER (gt = './.') / count(*) AS missing FROM b GROUP BY 1, 2""")
def _(t):
    af = F.col("af_1kg")
    band = F.when(af < 0.01, 0).when(af < 0.05, 1).when(af < 0.2, 2).when(af < 0.5, 3).when(af < 0.9, 4).otherwise(5)
    v = t.fx_variants.select("chrom_order", "pos", "ref", "alt", "gt")
    j = t.fx_known.filter("af_1kg IS NOT NULL").select("chrom_order", "pos", "ref", "alt", "af_1kg").join(v, ["chrom_order", "pos", "ref", "alt"])
    share = lambda g: (F.count(F.when(F.col("gt") == g, 1)) / F.count("*"))
    return j.groupBy(F.when(F.length("ref") == F.length("alt"), "snp").otherwise("indel").alias("kind"), band.alias("band")).agg(F.count("*").alias("n"), share("0/0").alias("hom_ref"), share("0/1").alias("het"), share("1/1").alias("hom_alt"), share("./.").alias("missing"))


def _lf(x):
    return f"lgamma(1.0 + ({x}))"


_LOGP = f"{_lf('r1')} - {_lf('x')} - {_lf('r1 - x')} + {_lf('n - r1')} - {_lf('c1 - x')} - {_lf('n - r1 - c1 + x')} - {_lf('n')} + {_lf('c1')} + {_lf('n - c1')}"


@query("strand_test", f"""WITH s AS (SELECT site_id, least(ref_reads, ref_fwd_cap) AS a, ref_reads - least(ref_reads, ref_fwd_cap) AS b, least(alt_reads, alt_fwd_cap) AS c, alt_reads - least(alt_reads, alt_fwd_cap) AS d FROM fx_sites WHERE alt_reads >= 6 AND ref_reads >= 6),
 m AS (SELECT *, a + b + c + d AS n, a + b AS r1, a + c AS c1 FROM s), e AS (SELECT *, unnest(range(greatest(0, c1 - (n - r1)), least(r1, c1) + 1)) AS x FROM m), l AS (SELECT site_id, a, x, {_LOGP} AS lp FROM e),
 h AS (SELECT site_id, lp AS here FROM l WHERE x = a) SELECT site_id, round(least(1.0, sum(exp(lp)) FILTER (lp <= here + 1e-9)), 6) AS p FROM l JOIN h USING (site_id) GROUP BY 1""")
def _(t):
    c = F.col
    s = t.fx_sites.filter("alt_reads >= 6 AND ref_reads >= 6").withColumns({"rf": F.least("ref_reads", "ref_fwd_cap"), "af": F.least("alt_reads", "alt_fwd_cap")})
    return s.select("site_id", R.fisher_exact(c("rf"), c("ref_reads") - c("rf"), c("af"), c("alt_reads") - c("af")).alias("p")).withColumn("p", F.round("p", 6))


@query("pgs_match_rates", f"WITH {MATCH}, w AS (SELECT score_id, count(DISTINCT (chrom_order, pos, effect_allele, other_allele)) AS n FROM fx_weights GROUP BY 1), g AS (SELECT score_id, count(DISTINCT (chrom_order, pos, effect_allele, other_allele)) AS matched FROM m WHERE kind IS NOT NULL GROUP BY 1) SELECT score_id, n, coalesce(matched, 0) AS matched, coalesce(matched, 0) / n AS rate, coalesce(matched, 0) / n >= 0.75 AS passed FROM w LEFT JOIN g USING (score_id)")
def _(t):
    key = ["chrom_order", "pos", "effect_allele", "other_allele"]
    n = t.fx_weights.groupBy("score_id").agg(F.count_distinct(*key).alias("n"))
    m = match_weights(t.fx_weights, t.fx_variants).groupBy("score_id").agg(F.count_distinct(*key).alias("matched"))
    j = n.join(m, "score_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return j.withColumns({"rate": F.col("matched") / F.col("n"), "passed": F.col("matched") / F.col("n") >= 0.75})
