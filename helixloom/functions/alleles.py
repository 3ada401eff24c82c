"""Column rules for chromosomes, alleles and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chromosome order; anything else sorts at 99.
CHROMS = [str(i) for i in range(1, 23)] + ["X", "Y", "MT"]
#: Pseudoautosomal ranges of chromosome X (build 37), 1-based closed.
PAR_X = [(60001, 2699520), (154931044, 155260560)]


def canon_chrom(c: Column) -> Column:
    """Chromosome name without prefix; M is MT."""
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def chrom_order(c: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in CHROMS]), canon_chrom(c))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(99))


def vtype(ref: Column, alt: Column) -> Column:
    a, b = F.length(ref), F.length(alt)
    return F.when((a == 1) & (b == 1), "SNV").when(a == b, "MNV").when(a < b, "INS").otherwise("DEL")


def variant_kind(ref: Column, alt: Column) -> Column:
    a, b = F.length(ref), F.length(alt)
    return F.when(a != b, "indel").when(a == 1, "snv").otherwise("mnv")


def zygosity(gt: Column) -> Column:
    """nocall, ref, hemi, hom or het; phased or not; half calls are no calls."""
    plain = F.translate(gt, "|", "/")  # string functions only: they stay inside compiled code
    a, b, two = F.split_part(plain, F.lit("/"), F.lit(1)), F.split_part(plain, F.lit("/"), F.lit(2)), F.contains(plain, F.lit("/"))
    return (
        F.when(gt.isNull() | F.contains(gt, F.lit(".")) | (a == "") | (two & (b == "")), "nocall")
        .when(~two, F.when(a == "0", "ref").otherwise("hemi"))
        .when((a == "0") & (b == "0"), "ref")
        .when(a == b, "hom")
        .otherwise("het")
    )


def in_par_x(pos: Column) -> Column:
    out = F.lit(False)
    for a, b in PAR_X:
        out = out | pos.between(a, b)
    return out


def ploidy(chrom: Column, pos: Column, sex: Column) -> Column:
    return F.when(chrom == "Y", 1).when((chrom == "X") & F.coalesce(sex.startswith("XY"), F.lit(False)), F.when(in_par_x(pos), 2).otherwise(1)).otherwise(2)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def trim_alleles(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt): shared suffix cut while both keep a base, then shared prefix cut."""

    def without_suffix(n: Column) -> Column:
        return F.struct(F.substring(ref, F.lit(1), F.length(ref) - n).alias("ref"), F.substring(alt, F.lit(1), F.length(alt) - n).alias("alt"))

    def without_prefix(p: Column) -> Column:
        r, a = p["ref"], p["alt"]
        left = F.sequence(F.lit(0), F.least(F.length(r), F.length(a)))
        shared = F.array_max(F.filter(left, lambda k: F.substring(r, F.lit(1), k) == F.substring(a, F.lit(1), k)))
        return _let(shared, lambda n: F.struct((pos + n).cast("int").alias("pos"), F.substring(r, n + 1, F.length(r)).alias("ref"), F.substring(a, n + 1, F.length(a)).alias("alt")))

    shorter = F.least(F.length(ref), F.length(alt))
    same_end = lambda k: F.substring(ref, F.length(ref) - k + 1, k) == F.substring(alt, F.length(alt) - k + 1, k)
    suffix = F.array_max(F.filter(F.sequence(F.lit(0), shorter), lambda k: (k < shorter) & same_end(k)))
    return _let(suffix, lambda n: _let(without_suffix(n), without_prefix))


def complement(allele: Column) -> Column:
    return F.translate(allele, "ACGT", "TGCA")


def effect_copies(genotype: Column, effect: Column, other: Column) -> Column:
    """Copies of the effect allele in a two-letter genotype, on the forward strand or else on the other; null if neither
    strand explains the letters."""
    letters = F.split(genotype, "")
    letters = F.filter(letters, lambda x: x != "")
    fits = lambda e, o: F.forall(letters, lambda x: (x == e) | (x == o))
    count = lambda e: F.size(F.filter(letters, lambda x: x == e))
    return F.when(fits(effect, other), count(effect)).when(fits(complement(effect), complement(other)), count(complement(effect)))


def genotype_share(af: Column, copies: Column) -> Column:
    """Share of people with so many copies under Hardy-Weinberg proportions."""
    return F.when(copies == 2, af * af).when(copies == 1, 2 * af * (1 - af)).when(copies == 0, (1 - af) * (1 - af))


def alt_is_major(af_1kg: Column, popmax: Column, flagged: Column) -> Column:
    """The first known frequency decides; a flagged one is not known."""
    known = F.coalesce(af_1kg, F.when(~F.coalesce(flagged, F.lit(False)), popmax))
    return F.coalesce(known >= 0.5, F.lit(False))
