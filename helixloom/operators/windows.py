"""Ordered picks: deterministic samples, tops, pages and consecutive parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, cls: list[str], key: list[str], n: int) -> DataFrame:
    """n rows of each class, by the order of a hash of the key. Classes hold any number of rows: each task keeps its own
    n first, so a class never meets in one task as a whole."""
    order = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    return top_per(df.withColumn("_o", order), cls, ["_o"], n).drop("_o")


def top_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group. A rank filter lets Spark limit groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")


def page(df: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def parts_by_size(counts: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """Consecutive keys share a part while their sizes fit `most`. counts has one row for each chromosome."""
    rows = F.array_sort(F.collect_list(F.struct(order, size)))
    start = F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("parts"))

    def step(acc, x):
        full = (acc["used"] > 0) & (acc["used"] + x[size] > most)
        part = F.when(full, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(part.alias("part"), F.when(full, x[size]).otherwise(acc["used"] + x[size]).alias("used"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    folded = counts.agg(rows.alias("rows")).withColumn("parts", F.aggregate("rows", start, step, lambda a: a["parts"]))
    return folded.select(F.inline(F.arrays_zip("rows", "parts"))).select(f"rows.{order}", f"rows.{size}", F.col("parts").alias("part"))
