"""Filters over a cohort's genotypes: rows of (site_id, chrom_order, sample, dosage), dosage null where it is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least allele frequency, most missing genotypes, and the chi-squared value (one degree) of p = 1e-4.
MIN_MAF, MAX_MISSING, HWE_CHI2 = 0.05, 0.1, 15.136705226623606


def site_counts(cohort: DataFrame) -> DataFrame:
    n = lambda d: F.count(F.when(F.col("dosage") == d, 1)).alias(f"n{d}")
    return cohort.groupBy("site_id", "chrom_order").agg(F.count("*").alias("people"), F.count(F.when(F.col("dosage").isNull(), 1)).alias("missing"), n(0), n(1), n(2))


def variant_filter(cohort: DataFrame) -> DataFrame:
    """(site_id, n0, n1, n2, missing, af, chi2, kept): autosomal sites that are common enough, rarely missing, and near the
    genotype shares that follow from the allele frequency (Hardy-Weinberg)."""
    g = site_counts(cohort)
    n = F.col("n0") + F.col("n1") + F.col("n2")
    g = g.withColumns({"n": n, "af": F.try_divide(F.col("n1") + 2 * F.col("n2"), 2 * n)})
    af = F.col("af")
    gap = lambda seen, want: (seen - want) * (seen - want) / want
    chi2 = gap(F.col("n0"), F.col("n") * (1 - af) * (1 - af)) + gap(F.col("n1"), 2 * F.col("n") * af * (1 - af)) + gap(F.col("n2"), F.col("n") * af * af)
    g = g.withColumn("chi2", F.when((af > 0) & (af < 1), chi2))
    kept = (F.col("chrom_order") < 22) & (F.least(af, 1 - af) >= MIN_MAF) & (F.col("missing") <= MAX_MISSING * F.col("people")) & (F.coalesce("chi2", F.lit(0.0)) < HWE_CHI2)
    return g.select("site_id", "n0", "n1", "n2", "missing", "af", "chi2", kept.alias("kept"))


def sample_missingness(cohort: DataFrame) -> DataFrame:
    lost = F.count(F.when(F.col("dosage").isNull(), 1))
    return cohort.groupBy("sample").agg(F.count("*").alias("sites"), lost.alias("missing"), (lost <= MAX_MISSING * F.count("*")).alias("kept"))
