"""Column rules for reporting, inheritance, medicines, associations, blood groups, repeats and copy numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import is_rare

#: Patterns of inheritance texts and their codes, first match wins.
INHERITANCE = [("semi-?dominant", "SD"), ("autosomal dominant|^ad$", "AD"), ("autosomal recessive|^ar$", "AR"), ("x-linked recessive|^xlr$", "XLR"), ("x-linked dominant|^xld$", "XLD"), ("x-linked|^xl$", "XL"), ("y-linked", "YL"), ("mitochondrial", "MT"), ("multigenic|multifactorial|polygenic", "MF"), ("digenic|oligogenic", "DG"), ("sporadic|somatic", "SP")]
#: Bands of penetrance by digit, words of the evidence by letter.
PENETRANCE = {"3": (40, 100), "2": (5, 39), "1": (1, 4), "0": (0, 1)}
PENETRANCE_EVIDENCE = {"A": "substantial evidence", "B": "moderate evidence", "C": "minimal evidence", "D": "poor evidence", "N": "evidence assessed as not applicable"}
#: Consequences that break a gene; thresholds of predictors and of gene constraint.
LOF = ("stop_gained", "frameshift", "splice_acceptor", "splice_donor", "start_lost")
REVEL_SUPPORTING, REVEL_MODERATE, REVEL_STRONG, AM_LIKELY, AM_STRONG, LOEUF_CONSTRAINED = 0.644, 0.773, 0.932, 0.564, 0.9, 0.6
#: Words of phenotypes and their class, first match wins.
PHENOTYPES = ("poor", "intermediate", "ultrarapid", "rapid", "normal", "decreased", "increased", "positive", "negative", "possible", "deficien", "indeterminate", "risk")
#: Condition names that say nothing.
FILLER = ("not provided", "not specified", "see cases", "other", "none provided")
#: Words for frequencies from the largest down.
RARITY = [(0.5, "the majority version"), (0.05, "common"), (0.01, "uncommon"), (0.001, "rare")]
#: Depth ratios of lost and gained copies, robust z-value, range of GC share, share that is common, exons of a long run.
DEPTH_DEL, DEPTH_DUP, DEPTH_Z, GC_RANGE, SV_COMMON, LONG_RUN = 0.65, 1.40, 3.0, (0.25, 0.75), 0.01, 5
ADULT = 18


def _none() -> Column:
    return F.lit(None).cast("string")


def inheritance_code(text: Column) -> Column:
    t = F.trim(F.lower(text))
    out = F.when(t.isNull(), _none())
    for pattern, code in INHERITANCE:
        out = out.when(t.rlike(pattern), code)
    return out


def inheritance_cues(names: Column) -> Column:
    """Sorted codes that condition names spell out; X-linked alone only where no kind of it is named."""
    t = F.coalesce(F.lower(names), F.lit(""))
    has = lambda p: F.contains(t, F.lit(p))
    codes = [F.when(has("autosomal dominant"), "AD"), F.when(has("autosomal recessive"), "AR"), F.when(has("x-linked recessive"), "XLR"), F.when(has("x-linked dominant"), "XLD"), F.when(has("x-linked") & ~has("x-linked recessive") & ~has("x-linked dominant"), "XL")]
    return F.array_sort(F.array_compact(F.array(*codes)))


def penetrance(code: Column) -> Column:
    """struct(low, high, evidence) of a code like 3A; null without a digit of 0 to 3."""
    digit, letter = F.regexp_extract(code, r"^\s*([0-3])\s*([A-DN])?", 1), F.regexp_extract(code, r"^\s*([0-3])\s*([A-DN])?", 2)
    pick = lambda key, table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    band = F.struct(
        pick(digit, {k: v[0] for k, v in PENETRANCE.items()}).alias("low"),
        pick(digit, {k: v[1] for k, v in PENETRANCE.items()}).alias("high"),
        F.coalesce(pick(letter, PENETRANCE_EVIDENCE), F.lit("evidence level not stated")).alias("evidence"),
    )
    return F.when(digit != "", band)


def breaks_gene(consequence: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(consequence, "&"), F.array(*[F.lit(x) for x in LOF])), F.lit(False))


def reportable(rule: Column, copies: Column, zygosity: Column, consequence: Column, change: Column, compound: Column) -> Column:
    """Whether a secondary finding is to be reported under its gene's rule: one named change in two copies, two changed copies,
    broken genes only, or all."""
    r = F.lower(rule)
    named = F.coalesce(change, F.lit("")).rlike("C282Y|282C>282Y|Cys282Tyr")
    return (
        F.when(F.coalesce(r, F.lit("")) == "", False)
        .when(F.contains(r, F.lit("c282y")), (zygosity == "hom") & named)
        .when(F.contains(r, F.lit("biallelic")), (copies == 2) | compound)
        .when(F.contains(r, F.lit("truncating")), breaks_gene(consequence))
        .otherwise(True)
    )


def predicted(consequence: Column, am: Column, revel: Column, loeuf: Column, popmax: Column, af_1kg: Column, recessive: Column, flagged: Column) -> Column:
    """Limited where predictors agree about a rare variant, else null."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    lost = breaks_gene(consequence) & (yes(loeuf < LOEUF_CONSTRAINED) | recessive)
    both = yes(revel >= REVEL_SUPPORTING) & yes(am > AM_LIKELY)
    missense = ~breaks_gene(consequence) & yes(F.contains(consequence, F.lit("missense"))) & (yes(revel >= REVEL_STRONG) | both | (revel.isNull() & yes(am >= AM_STRONG)))
    return F.when(is_rare(popmax, af_1kg, flagged) & (lost | missense), "Limited")


def association_effect(size: Column, note: Column) -> Column:
    """struct(kind, direction): a note of increase or decrease marks a beta and its sign, else the number is an odds ratio."""
    n = F.coalesce(F.lower(note), F.lit(""))
    up, down = F.contains(n, F.lit("increase")), F.contains(n, F.lit("decrease"))
    beta = F.struct(F.lit("beta").alias("kind"), F.when(up, 1).otherwise(-1).alias("direction"))
    odds = F.struct(F.lit("or").alias("kind"), F.when(size == 1, 0).when(size > 1, 1).otherwise(-1).alias("direction"))
    return F.when(size.isNotNull() & ~F.isnan(size), F.when(up | down, beta).otherwise(odds))


def rarity(af: Column) -> Column:
    out = F.when(af.isNull(), "not seen in the reference panel")
    for least, word in RARITY:
        out = out.when(af >= least, word)
    return out.otherwise("very rare")


def conflict_counts(text: Column) -> Column:
    """'Pathogenic(2)|Benign_(4)' as 'Pathogenic 2, Benign 4'."""

    def one(part: Column) -> Column:
        p = F.replace(part, F.lit("_"), F.lit(" "))
        name, n = F.regexp_extract(p, r"^\s*(.+?)\s*\(([0-9]+)\)\s*$", 1), F.regexp_extract(p, r"^\s*(.+?)\s*\(([0-9]+)\)\s*$", 2)
        capital = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)))
        return F.when(n != "", F.concat(capital, F.lit(" "), n)).otherwise(F.trim(p))

    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), one), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("details not given")


def condition_text(names: Column) -> Column:
    """Condition names without fillers and repeats, shouting toned down, sorted without regard to case."""
    tame = lambda c: F.when((c == F.upper(c)) & (c != F.lower(c)), F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))).otherwise(c)
    parts = F.transform(F.split(F.coalesce(names, F.lit("")), r"\|"), lambda c: F.trim(c))
    parts = F.array_distinct(F.transform(F.filter(parts, lambda c: (c != "") & ~F.lower(c).isin(*FILLER)), tame))
    ordered = F.transform(F.array_sort(F.transform(parts, lambda c: F.struct(F.lower(c).alias("k"), c.alias("c")))), lambda s: s["c"])
    return F.when(F.size(parts) > 0, F.array_join(ordered, "; ")).otherwise("an unspecified condition")


def guideline_tier(recommendation: Column, classification: Column, dosing: Column, alternative: Column, other: Column) -> Column:
    """change, note or standard, from curated flags only, never from the wording."""
    plain = (F.coalesce(recommendation, F.lit("")) == "") | F.coalesce(F.lower(classification) == "no recommendation", F.lit(False))
    return F.when(plain, "standard").when(dosing | alternative, "change").when(other, "note").otherwise("standard")


def phenotype_class(phenotype: Column) -> Column:
    p = F.lower(phenotype)
    has = lambda x: F.contains(p, F.lit(x))
    out = F.when(F.coalesce(p, F.lit("")).isin("", "no result"), "no_result").when(has("increased risk") | (has("positive") & ~has("negative")), "risk")
    for word in PHENOTYPES:
        out = out.when(has(word), word)
    return out.otherwise("other")


def guideline_evidence(source: Column, classification: Column) -> Column:
    c = F.trim(classification)
    return F.when(source == "CPIC", F.when(c.isin("Strong", "Moderate"), c).otherwise("Limited")).when(source.isin("DPWG", "FDA label"), "Moderate").otherwise("Limited")


def diplotype_level(total: Column, missing: Column, ambiguous: Column, uncalled: Column) -> Column:
    return (
        F.when((total == 0) | (missing == total), "Not callable")
        .when((missing / total > 0.2) | ambiguous, "Low")
        .when((missing > 0) | uncalled, "Medium")
        .otherwise("High")
    )


def second_call(reads: Column, lod: Column, observed: Column, flagged: Column) -> Column:
    clear = (F.coalesce(reads, F.lit(0)) >= 8) & (F.coalesce(lod, F.lit(0.0)) >= 2)
    return F.when(clear & (observed >= 1), F.when(flagged, "reads_flagged").otherwise("reads_support")).when(clear & (observed == 0), "reads_disagree").otherwise("unclear")


def blood_group(non_o: Column, b: Column) -> Column:
    """ABO group from copies that are not O and copies with the B markers; null if a position is unread or they disagree."""
    a = non_o - b
    return F.when(non_o.isNull() | b.isNull() | (b > non_o), _none()).when((a > 0) & (b > 0), "AB").when(a > 0, "A").when(b > 0, "B").otherwise("O")


def rh_copies(ratio: Column) -> Column:
    return F.when(ratio < 0.15, 0).when(ratio.between(0.3, 0.7), 1).when(ratio > 0.8, 2)


def provider_copies(genotype: Column, ref: Column, alt: Column) -> Column:
    """Copies of a marker's alternative letter in a provider's two letters; insertions and deletions are written I and D."""
    count = lambda x: F.length(genotype) - F.length(F.replace(genotype, x, F.lit("")))
    readable = (F.length(genotype) == 2) & ~F.contains(genotype, F.lit("-"))
    gap = genotype.rlike("^[DI]{2}$")
    return F.when(readable & gap, count(F.when(ref == "-", "I").otherwise("D"))).when(readable & (F.length(alt) == 1) & (alt != "-"), count(alt))


def longest_run(seq: Column, motif: str) -> Column:
    """Longest uninterrupted run of a literal motif, in any frame: run by run, as a regular expression that repeats it."""
    runs = F.regexp_extract_all(F.upper(seq), F.lit(f"(?=((?:{motif})+))"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))) / len(motif), F.lit(0)).cast("int")


def clinical_count(count: Column, ref_count: Column, pure: Column, benign_max: Column) -> Column:
    """A repeat count on the clinical scale: what the reference counts, plus the difference from it."""
    return F.when(pure == 0, count).otherwise(F.least(pure, benign_max) + count - ref_count)


def repeat_status(alleles: Column, upper: Column, ref_count: Column, pure: Column, benign_max: Column, intermediate_min: Column, pathogenic_min: Column) -> Column:
    """struct(status, call) of a repeat's alleles and the upper ends of their intervals."""
    conv = lambda xs: F.transform(xs, lambda x: clinical_count(x, ref_count, pure, benign_max))
    any_at = lambda xs, least: F.coalesce(F.exists(xs, lambda x: x >= least), F.lit(False))
    like = (pure > 0) & F.forall(alleles, lambda x: F.abs(x - ref_count) <= 1)
    status = F.when(~like & any_at(conv(alleles), pathogenic_min), "disease_range").when(~like & any_at(conv(alleles), intermediate_min), "intermediate").otherwise("typical")
    call = F.when(status != "typical", "Medium").when(any_at(conv(upper), pathogenic_min), "Low").when(any_at(conv(upper), intermediate_min), "Medium").otherwise("High")
    unread = (F.coalesce(F.size(alleles), F.lit(0)) == 0) | (F.forall(alleles, lambda x: x == 0) & F.coalesce(F.array_max(upper) > 100, F.lit(False)))
    row = lambda s, c: F.struct(s.alias("status"), c.alias("call"))
    return (
        F.when(unread, row(F.lit("not_readable"), F.lit("Not callable")))
        .when(pathogenic_min.isNull() | F.coalesce(pathogenic_min <= benign_max, F.lit(False)), row(F.lit("no_thresholds"), F.lit("Low")))
        .otherwise(row(status, call))
    )


def adult_onset(typical: Column, earliest: Column) -> Column:
    return F.coalesce(F.coalesce(typical, earliest) >= ADULT, F.lit(False))


def depth_kind(gc: Column, ratio: Column, ratio_all: Column, z: Column) -> Column:
    """DEL or DUP where both depths of an exon are unusual for its GC share, else null."""
    far = lambda c: z.isNull() | c
    usable = gc.isNull() | gc.between(*GC_RANGE)
    return F.when(usable & (ratio < DEPTH_DEL) & (ratio_all < DEPTH_DEL) & far(z <= -DEPTH_Z), "DEL").when(usable & (ratio > DEPTH_DUP) & (ratio_all > DEPTH_DUP) & far(z >= DEPTH_Z), "DUP")


def copy_number_class(kind: Column, breakpoint: Column, depth: Column, exons: Column, af: Column, popmax: Column) -> Column:
    """struct(status, evidence, call) of a deletion or duplication."""
    both = breakpoint & depth
    row = lambda s, e, c: F.struct(F.lit(s).alias("status"), F.lit(e).alias("evidence"), c.alias("call"))
    mid = F.when(both, "Medium").otherwise("Low")
    freq = F.greatest(F.coalesce(popmax, F.lit(0.0)), F.coalesce(af, F.lit(0.0)))
    return (
        F.when(freq >= SV_COMMON, row("common", "Limited", F.when(both, "High").otherwise("Medium")))
        .when(exons == 0, row("no_exon", "Limited", mid))
        .when(~both & (exons >= LONG_RUN), row("long_depth_signal", "Limited", F.lit("Low")))
        .when(~both, row("unconfirmed_signal", "Limited", F.lit("Low")))
        .when(kind == "DEL", row("possible_exon_deletion", "Moderate", F.lit("Medium")))
        .otherwise(row("possible_exon_duplication", "Limited", F.lit("Medium")))
    )


def recount_cap(level: Column, status: Column, look_alike: Column, one_strand: Column) -> Column:
    """Call level (0 to 3) after a re-count: it lowers, never raises. A call that cannot be judged stays."""
    cap = F.when(status == "disagrees", 1).when(status.isin("weak", "unclear") | look_alike | one_strand, 2).otherwise(3)
    return F.when(level == 0, 0).otherwise(F.least(level, cap)).cast("int")


def estimate(text: Column) -> Column:
    """struct(value, low, high) of texts like '0.63 [0.62,0.64]'; without three numbers there is no interval."""
    xs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]*\.[0-9]+|[0-9]+)"), F.lit(1)), lambda x: x.cast("double"))
    at = lambda k: F.when(F.size(xs) >= 3, F.get(xs, F.lit(k)))
    return F.struct(F.get(xs, F.lit(0)).alias("value"), at(1).alias("low"), at(2).alias("high"))


def risk_stated(value: Column, quote: Column) -> Column:
    """Whether a quote states the risk itself: in hundreds, thousands, hundred thousands, or as one in so many."""
    found = F.regexp_extract_all(F.coalesce(quote, F.lit("")), F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    ns = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    near = lambda x, y, tol: F.abs(x - y) <= tol * F.greatest(F.abs(x), F.abs(y))
    return F.exists(ns, lambda n: near(n, value * 100, 1e-6) | near(n, value * 1000, 1e-6) | near(n, value * 100_000, 1e-6) | ((n > 1) & near(1 / n, value, 0.02)))


#: Covariates that only control for ancestry or the laboratory.
TECHNICAL = set("pc pcs principal component components ancestry genetic genotyping genotype array arrays chip platform batch study studies centre center site assessment cohort of and the first top to for pca ancestral population structure one two three four five six seven eight nine ten twenty".split())
#: Words that do not change which disease is meant.
OUTCOME_FILLER = set("incident prevalent primary personal history risk total any overall the of onset diagnosed diagnosis all and".split())


def technical_only(covariates: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(F.lower(covariates), F.lit("")), F.lit("([a-z]+)"), F.lit(1))
    return F.size(F.array_except(words, F.array(*[F.lit(w) for w in sorted(TECHNICAL)]))) == 0


def same_outcome(evaluated: Column, traits: Column) -> Column:
    """Whether all words of the evaluated trait stand in one of the score's traits (array)."""
    words = lambda t: F.array_except(F.regexp_extract_all(F.replace(F.coalesce(F.lower(t), F.lit("")), F.lit("coeliac"), F.lit("celiac")), F.lit("([a-z0-9]+)"), F.lit(1)), F.array(*[F.lit(w) for w in sorted(OUTCOME_FILLER)]))
    w = words(evaluated)
    return (F.size(w) > 0) & F.exists(F.array_compact(traits), lambda t: F.size(F.array_except(w, words(t))) == 0)


def survival_gene_status(copies: Column, silent: Column) -> Column:
    """Status of a gene of which a lost copy shows in read depth only: undetermined is never typical."""
    return F.when(copies.isNull(), "not_determined").when(copies == 0, "affected").when(copies == 1, "carrier").when((copies == 2) & silent, "possible_silent_carrier").otherwise("typical")


def statement(cls: Column, gene: Column, copies: Column, role: Column) -> Column:
    """One sentence about a finding."""
    has = F.when(copies == 2, "two copies").otherwise("one copy")
    head = F.concat(F.lit("You carry "), has, F.lit(" of a variant in "), F.coalesce(gene, F.lit("no known gene")))
    tail = (
        F.when(cls == "drug_response", " that changes how a medicine works")
        .when(cls.isin("risk_factor", "association"), " that is linked to a trait")
        .when(cls == "protective", " that is linked to protection")
        .when(cls == "conflicting", " about which labs disagree")
        .otherwise(F.concat(F.lit(" listed as "), F.replace(cls, F.lit("_"), F.lit(" "))))
    )
    more = F.when(role == "carrier", "; on its own it is not expected to cause disease").when(role == "affected", "; it can cause disease").otherwise("")
    return F.concat(head, tail, more, F.lit("."))
