"""Readers of text formats into tables. Fields that are '.' or empty are null; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import canon_chrom, chrom_order


def _field(c: Column) -> Column:
    return F.when((c != ".") & (c != ""), c)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of a one-sample call file, with the sample's GT, GQ, DP, AD and VAF."""
    cols = F.split("value", "\t")
    at = lambda i: F.get(cols, F.lit(i))
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    sample = F.map_from_arrays(F.split(at(8), ":"), F.slice(F.concat(F.split(at(9), ":"), F.array_repeat(F.lit("."), F.size(F.split(at(8), ":")))), 1, F.size(F.split(at(8), ":"))))
    tag = lambda k: _field(F.try_element_at(F.col("sample"), F.lit(k)))
    rows = lines.select(at(0).alias("raw"), at(1).cast("int").alias("pos"), _field(at(2)).alias("id"), at(3).alias("ref"), at(4).alias("alts"), _field(at(5)).try_cast("double").alias("qual"), _field(at(6)).alias("filter"), sample.alias("sample"))
    return rows.select(
        canon_chrom(F.col("raw")).alias("chrom"), chrom_order(F.col("raw")).alias("chrom_order"), "pos", "id", "ref", "alts", "qual", "filter",
        F.coalesce(tag("GT"), F.lit("./.")).alias("gt"), tag("GQ").try_cast("int").alias("gq"), tag("DP").try_cast("int").alias("dp"), tag("AD").alias("ad"), tag("VAF").alias("vafs"),
    )


def split_multiallelic(records: DataFrame) -> DataFrame:
    """One row for each alternative allele. Genotypes are written anew: the row's allele is 1, all others 0. Passing rows
    that become 0/0 by the split are artefacts and go; reference calls and no-calls stay."""
    n = F.size(F.split("alts", ","))
    rows = records.withColumn("multiallelic", n > 1).select("*", F.posexplode(F.split("alts", ",")).alias("k", "alt"))
    own = (F.col("k") + 1).cast("string")
    parts = F.transform(F.split("gt", r"[/|]"), lambda x: F.when(x == ".", ".").when(x == own, "1").otherwise("0"))
    mark = F.when(F.contains("gt", F.lit("|")), "|").otherwise("/")
    rows = rows.withColumn("gt", F.when(F.col("multiallelic"), F.concat_ws("", F.get(parts, F.lit(0)), F.when(F.size(parts) > 1, mark), F.get(parts, F.lit(1)))).otherwise(F.col("gt")))
    rows = rows.filter(~(F.col("multiallelic") & (F.col("filter") == "PASS") & F.col("gt").isin("0/0", "0|0")) | F.col("filter").isNull())
    ad = F.split("ad", ",")
    return rows.withColumns({"ad_ref": F.get(ad, F.lit(0)).try_cast("int"), "ad_alt": F.get(ad, F.col("k") + 1).try_cast("int"), "vaf": F.get(F.split("vafs", ","), F.col("k")).try_cast("double")}).drop("k", "alts", "ad", "vafs")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a BED file, 0-based half-open; header lines are skipped, prefixes of names go."""
    cols = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0))
    return lines.select(canon_chrom(F.get(cols, F.lit(0))).alias("chrom"), F.get(cols, F.lit(1)).cast("int").alias("start_pos"), F.get(cols, F.lit(2)).cast("int").alias("end_pos"))


def read_gene_models(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a GFF3 file: 1-based closed, name and description out of the attributes."""
    cols = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#")).filter(F.get(cols, F.lit(2)).isin("gene", "ncRNA_gene"))
    attr = F.str_to_map(F.get(cols, F.lit(8)), F.lit(";"), F.lit("="))
    a = lambda k: F.try_element_at(attr, F.lit(k))
    text = F.regexp_replace(F.try_url_decode(a("description")), r" *\[Source:.*\]$", "")
    return lines.select(a("Name").alias("symbol"), a("biotype").alias("biotype"), canon_chrom(F.get(cols, F.lit(0))).alias("chrom"), F.get(cols, F.lit(3)).cast("int").alias("start_pos"), F.get(cols, F.lit(4)).cast("int").alias("end_pos"), text.alias("description"))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of schema, in its order: missing ones are null, so that optional inputs need no second path."""
    wanted = df.sparkSession.createDataFrame([], schema)
    have = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema.fields]
    return df.select(*have)
