"""From raw documents to packed sequences: each stage takes all that its predecessor kept.

Documents that the quality rules reject go; repeated lines go, and with them documents of which they leave less than half, or too
few words for the quality rules: what a near copy of several lines has left is a remnant, not a document; one document of each
group of near copies stays (five-word shingles, Jaccard similarity of 0.8 or more); sources are mixed to their target weights, whole documents or the first
words of one; what is left is tokenised and packed. Nulls, empty tables, repeated rows and very long texts have the
results that the operators' docstrings give. SQL cannot express shingle joins and packing, so ORACLE_SQL is None; the
stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from helixloom.llm.common import written

#: Words below which the quality rules reject a document, and a column that holds their number before lines go.
LEAST_WORDS, BEFORE = 20, "words before lines went"


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(docs.withColumn(BEFORE, mixing.size_of(F.col("text"))), short_repeats=True)
    words = mixing.size_of(F.col("text"))
    whole = (2 * words >= F.col(BEFORE)) & (words >= F.least(F.col(BEFORE), F.lit(LEAST_WORDS)))
    return _sized(left.filter(whole).drop(BEFORE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, width=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(mixing.take(mixing.mix(docs, F.array("source"), out="_mix"), out="_mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, with_ids=True))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
