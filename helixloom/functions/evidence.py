"""Grading rules as columns: evidence, call confidence and what follows from both. Levels are small integers inside and
words at the edge: evidence 0 Limited, 1 Moderate, 2 Strong; calls 0 Not callable, 1 Low, 2 Medium, 3 High."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reads import let

#: Level names in rising order.
EVIDENCE = ("Limited", "Moderate", "Strong")
CALL = ("Not callable", "Low", "Medium", "High")
OVERALL = ("Not callable", "Limited", "Moderate", "Strong")
#: Evidence by review stars, thresholds of frequency rules, rank of gene validity.
STARS_LEVEL = {4: 2, 3: 2, 2: 1, 1: 0, 0: 0}
BA1_AF, BS1_AF, RARE_AF = 0.05, 0.01, 0.001
VALIDITY_RANK = {"Definitive": 5, "Strong": 4, "Moderate": 3, "Limited": 2, "Disputed": 1, "Refuted": 0, "No Known Disease Relationship": 0}
#: Modes of inheritance by kind.
RECESSIVE, DOMINANT, X_LINKED = ("AR",), ("AD", "SD", "XLD"), ("XL", "XLR", "XLD")
#: First matching prefix or word decides the class of a significance text.
SIG_PREFIXES = [("conflicting", "conflicting"), ("pathogenic", "pathogenic"), ("likely_pathogenic", "likely_pathogenic"), ("uncertain", "uncertain"), ("vus", "uncertain"), ("benign", "benign"), ("likely_benign", "likely_benign")]
SIG_WORDS = {"drug_response": "drug_response", "risk_factor": "risk_factor", "likely_risk_allele": "risk_factor", "established_risk_allele": "risk_factor", "protective": "protective", "association": "association", "affects": "association", "confers_sensitivity": "association"}
#: Severity of consequence terms; terms that are not listed have rank 0.
CSQ_RANK = {
    "frameshift": 9, "stop_gained": 9, "splice_acceptor": 9, "splice_donor": 9, "start_lost": 8, "stop_lost": 8,
    "missense": 6, "inframe_deletion": 6, "inframe_insertion": 6, "inframe_altering": 6,
    "splice_region": 4, "synonymous": 3, "stop_retained": 3, "start_retained": 3, "coding_sequence": 3, "feature_elongation": 3,
    "5_prime_utr": 2, "3_prime_utr": 2, "non_coding": 1, "intron": 1,
}


def word(level: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), level)


def sig_class(significance: Column) -> Column:
    """The class of a significance text; a value bound once, as filters on classes would copy all these cases into one method,
    too large to be compiled."""

    def told(s: Column) -> Column:
        out = F.when(s.isNull(), "other")
        for prefix, name in SIG_PREFIXES:
            out = out.when(s.startswith(prefix), name)
        for text, name in SIG_WORDS.items():
            out = out.when(s == text, name)
        return out.otherwise("other")

    return let(F.lower(significance), told)


def popmax_af(raw: Column) -> Column:
    """A negative frequency stands for unknown."""
    return F.when(raw >= 0, raw)


def flag(raw: Column) -> Column:
    """'1' is flagged; a missing flag column (null) is an unknown status."""
    return raw == "1"


def highest_af(popmax: Column, af_1kg: Column, flagged: Column) -> Column:
    """Largest frequency that a grade may rest on; null if none is known."""
    return F.greatest(F.when(~F.coalesce(flagged, F.lit(False)), popmax), af_1kg)


def is_rare(popmax: Column, af_1kg: Column, flagged: Column) -> Column:
    af = highest_af(popmax, af_1kg, flagged)
    return F.when(af.isNotNull(), af < RARE_AF).otherwise(~F.coalesce(flagged, F.lit(False)))


def too_common(popmax: Column, af_1kg: Column, flagged: Column, stars: Column) -> Column:
    return (F.coalesce(stars, F.lit(0)) < 3) & F.coalesce(highest_af(popmax, af_1kg, flagged) >= BA1_AF, F.lit(False))


def population_class(popmax: Column, af_1kg: Column, flagged: Column) -> Column:
    af = F.greatest(popmax, af_1kg)
    return F.when(F.coalesce(flagged, F.lit(False)), "flagged").when(af.isNull(), "not_seen").when(af >= BS1_AF, "common").otherwise("rare")


def clinvar_level(stars: Column, cls: Column, popmax: Column, af_1kg: Column, flagged: Column, validity: Column) -> Column:
    base = F.lit(0)
    for n, level in STARS_LEVEL.items():
        base = F.when(F.coalesce(stars, F.lit(0)) == n, level).otherwise(base)
    capped = F.when(cls == "conflicting", 0).when(cls == "drug_response", F.least(base, F.lit(1))).otherwise(base)
    af = highest_af(popmax, af_1kg, flagged)
    down = lambda x: F.greatest(x - 1, F.lit(0))
    by_af = F.when(af >= BA1_AF, 0).when(af >= BS1_AF, down(capped)).otherwise(capped)
    rank = validity_rank(validity)
    by_gene = F.when(rank <= 1, 0).when(rank == 2, down(by_af)).otherwise(by_af)
    return F.when(cls.isin("pathogenic", "likely_pathogenic"), by_gene).otherwise(capped).cast("int")


def evidence_reasons(stars: Column, cls: Column, popmax: Column, af_1kg: Column, flagged: Column) -> Column:
    """Codes of the reasons behind clinvar_level, in order."""
    disease = cls.isin("pathogenic", "likely_pathogenic")
    af = highest_af(popmax, af_1kg, flagged)
    codes = [
        F.concat(F.lit("stars_"), F.coalesce(stars, F.lit(0)).cast("string")),
        F.when((cls == "drug_response") & (stars >= 3), F.lit("drug_response_capped")),
        F.when(cls == "conflicting", F.lit("labs_disagree")),
        F.when(disease & (af >= BA1_AF), F.lit("ba1_common")),
        F.when(disease & (af >= BS1_AF) & (af < BA1_AF), F.lit("bs1_common")),
        F.when(disease & F.coalesce(flagged, F.lit(False)), F.lit("frequency_flagged")),
    ]
    return F.array_compact(F.array(*codes))


def further_reasons(cls: Column, popmax: Column, af_1kg: Column, flagged: Column, validity: Column, low_penetrance: Column) -> Column:
    """Codes of what else bears on an assertion of disease: rarity, the standing of the gene's link, low penetrance."""
    disease = cls.isin("pathogenic", "likely_pathogenic")
    af, odd = highest_af(popmax, af_1kg, flagged), F.coalesce(flagged, F.lit(False))
    uncommon = F.coalesce(af < BS1_AF, F.lit(True)) & ~odd
    rank = validity_rank(validity)
    gene = F.when(rank <= 1, "gene_disputed").when(rank == 2, "gene_limited").when(rank.isNotNull(), "gene_supported")
    codes = [
        F.when(disease & uncommon, F.when(popmax.isNotNull(), "rare").when(af_1kg.isNull(), "not_seen")),
        F.when(disease, gene),
        F.when(disease & F.coalesce(low_penetrance, F.lit(False)), "low_penetrance"),
    ]
    return F.array_compact(F.array(*codes))


def validity_rank(validity: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, n in VALIDITY_RANK.items():
        rank = F.when(validity == name, n).otherwise(rank)
    return rank


def call_level(filter_: Column, gq: Column, dp: Column, vaf: Column, zyg: Column, provider: Column, truth: Column | None = None) -> Column:
    """How sure the genotype is; with `truth` (whether the calls are a benchmark's own) every call that passed is."""
    gq, dp = F.coalesce(gq, F.lit(0)), F.coalesce(dp, F.lit(0))
    base = F.when((gq >= 30) & (dp >= 15), 3).when((gq >= 20) & (dp >= 10), 2).otherwise(1)
    level = F.when(F.coalesce(unbalanced(vaf, zyg), F.lit(False)), F.greatest(base - 1, F.lit(1))).otherwise(base)
    level = F.when(F.coalesce(provider == "disagree", F.lit(False)), 1).otherwise(level)
    level = F.when(truth, 3).otherwise(level) if truth is not None else level
    return F.when(filter_.isNotNull() & ~filter_.isin("PASS", "."), 1).otherwise(level).cast("int")


def unbalanced(vaf: Column, zyg: Column) -> Column:
    return ((zyg == "het") & ~vaf.between(0.2, 0.8)) | ((zyg == "hom") & (vaf < 0.8))


def call_reasons(filter_: Column, gq: Column, dp: Column, vaf: Column, zyg: Column, provider: Column, truth: Column | None = None) -> Column:
    """Codes of the reasons behind call_level, in order; a call that did not pass, or a benchmark's own, has one."""
    gq, dp = F.coalesce(gq, F.lit(0)), F.coalesce(dp, F.lit(0))
    reads = F.when((gq >= 30) & (dp >= 15), "strong_reads").when((gq >= 20) & (dp >= 10), "moderate_reads").otherwise("thin_reads")
    told = F.array_compact(F.array(reads, F.when(F.coalesce(unbalanced(vaf, zyg), F.lit(False)), "unbalanced_reads"), F.when(provider == "agree", "provider_agrees"), F.when(provider == "disagree", "provider_disagrees")))
    told = F.when(truth, F.array(F.lit("benchmark"))).otherwise(told) if truth is not None else told
    return F.when(filter_.isNotNull() & ~filter_.isin("PASS", "."), F.array(F.lit("not_passed"))).otherwise(told)


def overall(evidence: Column, call: Column) -> Column:
    """The weaker of both, on the scale of OVERALL."""
    return F.least(evidence + 1, call).cast("int")


def consequence_rank(csq: Column) -> Column:
    """The highest rank of the terms, which `&` joins; found by comparing texts only, which stays inside compiled code."""
    terms = F.concat(F.lit("&"), csq, F.lit("&"))
    out = F
    for term, rank in sorted(CSQ_RANK.items(), key=lambda x: -x[1]):
        out = out.when(F.contains(terms, F.lit(f"&{term}&")), rank)
    return out.when(csq.isNotNull(), 0)


def impact(rank: Column) -> Column:
    return F.when(rank >= 8, "HIGH").when(rank >= 6, "MODERATE").when(rank >= 3, "LOW").otherwise("MODIFIER")


def role(modes: Column, zyg: Column, chrom: Column) -> Column:
    """What carrying a genotype means: affected, carrier, possible or unknown, from the modes of inheritance once DG, MF and SP are
    left out. Two copies affect where the gene is recessive or X-linked, one on a single X where it is X-linked; one copy of a
    purely recessive gene, or of a recessive one on two X, makes a carrier; else one dominant mode leaves it possible."""
    core = F.array_except(modes, _words("DG", "MF", "SP"))
    any_ = lambda sets: F.arrays_overlap(core, _words(*sets))
    only = lambda sets: F.size(F.array_except(core, _words(*sets))) == 0
    on_x = F.coalesce(chrom == "X", F.lit(False))
    het, hom, hemi = (F.coalesce(zyg == z, F.lit(False)) for z in ("het", "hom", "hemi"))
    return (
        F.when(F.coalesce(F.size(core), F.lit(0)) < 1, "unknown")
        .when((hom & any_((*RECESSIVE, *X_LINKED))) | (hemi & on_x & any_(X_LINKED)), "affected")
        .when(het & (only(RECESSIVE) | (on_x & only(("XLR", "XL")))), "carrier")
        .when(any_(DOMINANT), "possible")
        .otherwise("unknown")
    )


def _words(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def gwas_level(publications: Column, log10p: Column, direction_known: Column) -> Column:
    base = F.when(publications >= 3, 2).when(publications >= 2, 1).otherwise(0)
    return F.when((log10p < 7.3) | ~direction_known, 0).otherwise(base).cast("int")


def pgs_level(publications: Column, people: Column) -> Column:
    return F.when((publications >= 2) & (people >= 20000), 1).otherwise(0).cast("int")


def match_call(rate: Column) -> Column:
    return F.when(rate >= 0.9, 3).when(rate >= 0.75, 2).otherwise(0).cast("int")
