"""Findings graded in full: assertions of disease with every reason, candidates that only predictors name, routing by what a genotype
means, and what a re-count of the reads leaves of a call.

Everything is known by gene in one small row (validity, modes, rule, whether a disease is linked to it), which is joined
once; grades and reasons are columns. Reasons are codes, in order.

Defined results: genes that nothing is known about count as without modes, rating or rule; null scores support nothing; null
flags are false for grades; a missing re-count changes nothing; repeated rows are graded one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import evidence as E
from ..functions.evidence import CALL, EVIDENCE, OVERALL, word
from .knowledge import CLAIM_CLASSES

#: Classes that settle a variant without a prediction, those that assert a disease or its risk, calls of a re-count
#: from the worst on, and statuses that lower a call to Medium.
SETTLED = (*CLAIM_CLASSES, "benign", "likely_benign")
DISEASE_LIKE = ("pathogenic", "likely_pathogenic", "conflicting", "predicted")
WORST_FIRST = ("disagrees", "unclear", "weak", "confirmed")
TO_MEDIUM = ("weak", "unclear")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def candidates(a: DataFrame) -> DataFrame:
    """Annotated alleles that predictors may name: passed, unsettled, and either broken or with a score that counts."""
    c = F.col
    scored = yes(c("am") > C.AM_LIKELY) | yes(c("revel") >= C.REVEL_SUPPORTING) | C.breaks_gene(c("consequence"))
    return a.filter(~F.coalesce(c("cls"), F.lit("")).isin(*SETTLED) & (c("filter") == "PASS") & scored)


def prediction_reasons(a: DataFrame) -> Column:
    """Codes of what speaks for a candidate."""
    c = F.col
    lost = C.breaks_gene(c("consequence"))
    am = yes(c("am") > C.AM_LIKELY)
    missense = F.when(c("revel") >= C.REVEL_STRONG, "revel_strong").when((c("revel") >= C.REVEL_SUPPORTING) & am, F.when(c("revel") >= C.REVEL_MODERATE, "revel_moderate_and_am").otherwise("revel_supporting_and_am")).otherwise("am_strong")
    af = E.highest_af(c("popmax"), c("af_1kg"), c("flagged"))
    return F.array_compact(F.array(
        F.when(lost, F.when(yes(c("loeuf") < C.LOEUF_CONSTRAINED), "breaks_constrained_gene").otherwise("breaks_recessive_gene")).otherwise(missense),
        F.when(af.isNull(), "not_seen").otherwise("rare"),
        F.when(yes(c("flagged")), "frequency_flagged"),
        F.when(c("significance").isNotNull(), "labs_unsettled").otherwise("prediction_only"),
    ))


def route(cls: Column, role: Column, low_penetrance: Column, blood_group: Column) -> Column:
    """struct(section, grp): where a finding is shown; the first that fits."""
    at = lambda s, g: F.struct(F.lit(s).alias("section"), F.lit(g).alias("grp"))
    return (
        F.when(cls == "drug_response", at("pgx", "drug_response"))
        .when((cls == "association") | blood_group, at("traits", "association"))
        .when(cls.isin(*DISEASE_LIKE) & (role == "carrier"), at("carrier", "carrier"))
        .when(cls.isin("risk_factor", "protective") | low_penetrance, at("health", "risk"))
        .when((cls == "conflicting") | (role == "common"), at("health", "uncertain"))
        .when(cls == "predicted", at("health", "predicted"))
        .otherwise(at("health", "monogenic"))
    )


def findings(a: DataFrame, genes: DataFrame, truth: bool = False) -> DataFrame:
    """Findings of annotated alleles (as `knowledge.annotate` gives them, with chrom, am, revel, loeuf, low_penetrance, blood_group: whether all
    conditions are blood groups) and what is known of genes (gene, validity, modes, rule, disease_gene)."""
    c = F.col
    told = c("cls").isin(*CLAIM_CLASSES) & ((c("cls") != "conflicting") | yes(F.lower("conflicts").contains("pathogenic")))
    known = genes.select("gene", "validity", "modes", "rule", "disease_gene")
    asserted = a.filter(told).join(known, "gene", "left")
    modes = F.coalesce("modes", F.array().cast("array<string>"))
    asserted = asserted.withColumns({
        "evidence": E.clinvar_level(c("stars"), c("cls"), c("popmax"), c("af_1kg"), c("flagged"), c("validity")),
        "evidence_reasons": F.concat(E.evidence_reasons(c("stars"), c("cls"), c("popmax"), c("af_1kg"), c("flagged")), E.further_reasons(c("cls"), c("popmax"), c("af_1kg"), c("flagged"), c("validity"), c("low_penetrance"))),
    })
    guessed = candidates(a).join(known.filter("disease_gene"), "gene")
    named = C.predicted(c("consequence"), c("am"), c("revel"), c("loeuf"), c("popmax"), c("af_1kg"), yes(F.array_contains("modes", "AR")), c("flagged"))
    guessed = guessed.filter(named.isNotNull()).withColumns({"evidence": F.lit(0), "evidence_reasons": prediction_reasons(guessed), "cls": F.lit("predicted")})
    x = asserted.unionByName(guessed)
    expected = F.when(c("zygosity") == "het", F.array_sort(F.array("ref", "alt"))).otherwise(F.array("alt", "alt"))
    letters = F.array_sort(F.filter(F.split("provider_genotype", ""), lambda y: y != ""))
    x = x.withColumn("provider", F.when(c("provider_genotype").isNotNull(), F.when(letters == expected, "agree").otherwise("disagree")))
    call = (c("filter"), c("gq"), c("dp"), c("vaf"), c("zygosity"), c("provider"), F.lit(truth))
    blood = yes(c("blood_group"))
    common = c("cls").isin(*DISEASE_LIKE) & E.too_common(c("popmax"), c("af_1kg"), c("flagged"), c("stars"))
    x = x.withColumns({"call": E.call_level(*call), "call_reasons": E.call_reasons(*call), "meaning": F.when(common, "common").otherwise(E.role(modes, c("zygosity"), c("chrom")))})
    x = x.withColumn("at", route(c("cls"), c("meaning"), yes(c("low_penetrance")), blood))
    copies = F.when(c("zygosity") == "hom", 2).otherwise(1)
    report = c("rule").isNotNull() & c("cls").isin("pathogenic", "likely_pathogenic") & C.reportable(c("rule"), copies, c("zygosity"), c("consequence"), c("aa_change"), F.lit(False))
    disease = c("cls").isin(*DISEASE_LIKE) & ~((c("cls") == "association") | blood)
    return x.select(
        F.concat_ws("-", F.lit("v"), "chrom_order", "pos", "ref", "alt").alias("claim_id"), "chrom_order", "pos", "ref", "alt", "gene", "cls", "zygosity", "consequence", "aa_change", "rule", "at.section", "at.grp", F.when(disease, c("meaning")).alias("role"),
        "evidence", "call", "evidence_reasons", "call_reasons", word(c("evidence"), EVIDENCE).alias("evidence_level"), word(c("call"), CALL).alias("call_level"), word(E.overall(c("evidence"), c("call")), OVERALL).alias("overall"), yes(report).alias("reportable"),
    )


def claims(a: DataFrame, genes: DataFrame) -> DataFrame:
    """Graded claims of annotated alleles: what labs assert, and rare alleles that only predictors name, with the gene's standing in the
    grade and the section that the role gives. An allele outside of consequences takes the gene of its record; a provider's genotype
    is compared where both alleles and both of its letters are single ones."""
    c = F.col
    comparable = (F.length("ref") == 1) & (F.length("alt") == 1) & c("provider_genotype").rlike("^[ACGT]{2}$")
    a = a.withColumns({"gene": F.coalesce("gene", "known_gene"), "provider_genotype": F.when(comparable, c("provider_genotype"))})
    return findings(a, genes).select("claim_id", "section", "cls", "gene", "zygosity", "evidence_level", c("call_level").alias("call_confidence"), "overall", c("evidence_reasons").alias("reasons"))


def compounds(found: DataFrame) -> DataFrame:
    """Carrier findings of a gene that has another: with a pathogenic or likely pathogenic one among them they move to health as possible
    compounds, and their report is judged again; else they get a note."""
    c = F.col
    carriers = found.filter("section = 'carrier' AND gene IS NOT NULL").groupBy("gene").agg(F.count("*").alias("_n"), F.bool_or(c("cls").isin("pathogenic", "likely_pathogenic")).alias("_severe"))
    j = found.join(carriers.filter("_n >= 2"), "gene", "left")
    here = (c("section") == "carrier") & c("_n").isNotNull()
    moved = here & c("_severe")
    again = c("rule").isNotNull() & c("cls").isin("pathogenic", "likely_pathogenic") & C.reportable(c("rule"), F.lit(1), F.lit("het"), c("consequence"), c("aa_change"), F.lit(True))
    return j.withColumns({"reportable": F.when(moved, yes(again)).otherwise(c("reportable")), "compound": F.when(moved, "compound").when(here, "note"), "role": F.when(moved, "possible").otherwise(c("role")), "grp": F.when(moved, "compound").otherwise(c("grp")), "section": F.when(moved, "health").otherwise(c("section"))}).drop("_n", "_severe")


def recount_reasons(status: Column, flags: Column, note: Column, difficult: Column) -> Column:
    has = lambda f: yes(F.array_contains(flags, f))
    return F.array_compact(F.array(
        F.when(status.isin(*WORST_FIRST), F.concat(F.lit("recount_"), status)).when((status == "not_checkable") & note.isNotNull(), "recount_not_possible"),
        F.when(has("look_alike"), "look_alike"), F.when(has("one_strand"), "one_strand"), F.when(yes(F.size(difficult) > 0), "difficult_region"),
    ))


def after_recount(found: DataFrame, sites: DataFrame, genes: DataFrame) -> DataFrame:
    """Findings (claim_id, gene, site_key, section, grp, evidence, call, call_reasons) with call, reasons and overall after the re-count of their
    site (site_key, status, flags, note, difficult). Results of medicines have no site of their own: the worst of their genes'
    verdicts (gene, status) counts; their gene may be a list with commas. A call is lowered, never raised."""
    c = F.col
    s = sites.select("site_key", c("status").alias("s_status"), c("flags").alias("s_flags"), c("note").alias("s_note"), c("difficult").alias("s_difficult"))
    order = F.array_position(F.array(*[F.lit(x) for x in WORST_FIRST]), c("g_status"))
    by_gene = found.filter((c("section") == "pgx") & c("grp").isin("pgx_gene", "pgx_drug") & c("site_key").isNull())
    each = by_gene.select("claim_id", F.explode(F.transform(F.split("gene", ","), lambda g: F.trim(g))).alias("one")).join(genes.select(c("gene").alias("one"), c("status").alias("g_status")), "one")
    worst = each.groupBy("claim_id").agg(F.min_by("g_status", order).alias("g_status"))
    j = found.join(s, "site_key", "left").join(worst, "claim_id", "left")
    status = F.coalesce("s_status", "g_status")
    has = lambda f: yes(F.array_contains("s_flags", f))
    call = F.when(status.isNull(), c("call")).otherwise(C.recount_cap(c("call"), status, has("look_alike"), has("one_strand")))
    j = j.withColumns({"status": status, "after": call, "call_reasons": F.concat("call_reasons", recount_reasons(status, c("s_flags"), c("s_note"), c("s_difficult")))})
    return j.select("claim_id", "status", word(c("after"), CALL).alias("call_level"), "call_reasons", word(E.overall(c("evidence"), c("after")), OVERALL).alias("overall"))
