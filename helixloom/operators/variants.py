"""The variant store and what is counted over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A

CALLED = ("het", "hom", "hemi")


def store(raw: DataFrame) -> DataFrame:
    """Alleles with type, zygosity and fraction of variant reads."""
    return raw.withColumns(
        {
            "vtype": A.vtype(F.col("ref"), F.col("alt")),
            "zygosity": A.zygosity(F.col("gt")),
            "vaf": F.when(F.col("dp") > 0, F.col("ad_alt").cast("double") / F.col("dp")),
        }
    )


def range_sorted(df: DataFrame, partitions: int) -> DataFrame:
    """Stored order: by position, so that files and row groups can be skipped."""
    return df.repartitionByRange(partitions, "chrom_order", "pos").sortWithinPartitions("chrom_order", "pos", "ref", "alt")


def _n(condition) -> F.Column:
    return F.count(F.when(condition, 1))


def qc(v: DataFrame) -> DataFrame:
    """One row of metrics over passing, called alleles."""
    called = v.filter((F.col("filter") == "PASS") & F.col("zygosity").isin(*CALLED))
    snv, zyg = F.col("vtype") == "SNV", F.col("zygosity")
    on_x = snv & (F.col("chrom") == "X") & ~A.in_par_x(F.col("pos"))
    kinds = {k.lower(): F.col("vtype") == k for k in ("SNV", "INS", "DEL", "MNV")}
    counted = kinds | {
        "snv_het": snv & (zyg == "het"),
        "snv_hom": snv & (zyg == "hom"),
        "ts": snv & F.concat("ref", "alt").isin("AG", "GA", "CT", "TC"),
        "x_het": on_x & (zyg == "het"),
        "x_hom": on_x & (zyg != "het"),
        "y_snv": snv & (F.col("chrom") == "Y"),
    }
    share = F.when(snv & (zyg == "het") & ~F.col("chrom").isin("X", "Y", "MT"), F.col("vaf"))
    levels = {"vaf_median": (share, 0.5), "vaf_q1": (share, 0.25), "vaf_q3": (share, 0.75), "dp_median": (F.col("dp"), 0.5), "gq_median": (F.col("gq"), 0.5)}
    m = called.agg(*[_n(c).alias(k) for k, c in counted.items()], *[F.percentile(c, F.lit(q)).alias(k) for k, (c, q) in levels.items()])
    m = m.withColumns({"snv_count": F.col("snv"), "indel_count": F.col("ins") + F.col("del")})
    return m.withColumns(
        {
            "titv": F.col("ts").cast("double") / F.greatest(F.col("snv") - F.col("ts"), F.lit(1)),
            "het_hom": F.col("snv_het").cast("double") / F.greatest("snv_hom", F.lit(1)),
            "x_het_share": F.when(F.col("x_het") + F.col("x_hom") > 0, F.col("x_het").cast("double") / (F.col("x_het") + F.col("x_hom"))),
        }
    )


def infer_sex(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.when(F.col("x_het_share") < 0.1, "XY").when(F.col("x_het_share") >= 0.1, "XX").alias("sex"), "x_het_share", "y_snv")


def assess(metrics: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(metric, value, low, high, status) for the metrics that have a value."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in ranges.items()])
    out = metrics.select(F.inline(rows)).filter("value IS NOT NULL")
    return out.withColumn("status", F.when(F.col("value").between(F.col("low"), F.col("high")), "pass").otherwise("warn"))


def per_chrom(v: DataFrame) -> DataFrame:
    called = v.filter((F.col("filter") == "PASS") & F.col("zygosity").isin(*CALLED))
    return called.groupBy("chrom", "chrom_order").agg(
        _n(F.col("vtype") == "SNV").alias("snv"), _n(F.col("vtype").isin("INS", "DEL")).alias("indel"), _n(F.col("zygosity") == "het").alias("het"), _n(F.col("zygosity").isin("hom", "hemi")).alias("hom")
    )


def histograms(v: DataFrame) -> DataFrame:
    """(metric, bin, n) in one pass: every allele gives its bin to each histogram that it belongs to."""
    snv, het, auto = F.col("vtype") == "SNV", F.col("zygosity") == "het", ~F.col("chrom").isin("X", "Y", "MT")
    indel = F.col("vtype").isin("INS", "DEL")
    bins = {
        "het_vaf": (snv & het & auto & F.col("vaf").isNotNull(), F.floor(F.col("vaf") * 50)),
        "depth": (F.col("dp").isNotNull(), F.least("dp", F.lit(100))),
        "gq": (F.col("gq").isNotNull(), F.col("gq")),
        "indel_length": (indel & (F.col("zygosity") != "ref"), F.greatest(F.least(F.length("alt") - F.length("ref"), F.lit(20)), F.lit(-20))),
        "substitution": (snv & (F.col("zygosity") != "ref"), F.concat("ref", F.lit(">"), "alt")),
    }
    cells = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("metric"), x.cast("string").alias("bin"))) for k, (c, x) in bins.items()]))
    return v.filter("filter = 'PASS'").select(F.inline(cells)).groupBy("metric", "bin").agg(F.count("*").alias("n"))


def provider_positions(g: DataFrame) -> DataFrame:
    """One row for each position of several genotype files: name and genotype of the best file, whether the first file
    has it, and whether files disagree."""
    order = F.struct("file_rank", "rsid", "genotype")
    return g.groupBy("chrom_order", "pos").agg(
        F.min_by("rsid", order).alias("rsid"),
        F.min_by("genotype", order).alias("genotype"),
        F.bool_or(F.col("file_rank") == 0).alias("in_panel"),
        (F.count_distinct("genotype") > 1).alias("conflicting"),
    )


def concordance(v: DataFrame, g: DataFrame) -> DataFrame:
    """(in_panel, status, n): provider genotypes against the genotypes that the variants imply."""
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    expected = F.when(F.col("zygosity") == "het", F.concat("ref", "alt")).when(F.col("zygosity").isin("hom", "hemi"), F.concat("alt", "alt")).when(F.col("zygosity") == "ref", F.concat("ref", "ref"))
    one = v.filter((F.length("ref") == 1) & (F.length("alt") == 1)).groupBy("chrom_order", "pos").agg(
        F.count("*").alias("alleles"), F.max(expected).alias("expected"), F.bool_or(F.col("zygosity") == "nocall").alias("nocall"), F.max("zygosity").alias("zyg")
    )
    j = provider_positions(g).join(one, ["chrom_order", "pos"], "left")
    status = (
        F.when(F.col("alleles").isNull(), "unverifiable")
        .when(F.col("nocall"), "nocall")
        .when(F.col("alleles") > 1, "unverifiable")
        .when(letters(F.col("genotype")) == letters(F.col("expected")), F.when(F.col("zyg") == "ref", "concordant_reference").otherwise("concordant_variant"))
        .otherwise("discordant")
    )
    return j.groupBy("in_panel", status.alias("status")).agg(F.count("*").alias("n"))
