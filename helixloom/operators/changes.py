"""Comparisons of two versions of a table, checks over a release, and its content digest."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_compare(old: DataFrame, new: DataFrame, key: list[str], fields: list[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """(key, kind, changed): rows that were added, removed or changed, with the names of the fields that differ. Nulls are
    equal to each other; a field with a tolerance differs only beyond it."""
    tolerance = tolerance or {}
    a = old.select(*[F.col(k) for k in key], F.struct(*fields).alias("was"))
    b = new.select(*[F.col(k) for k in key], F.struct(*fields).alias("now"))
    j = a.join(b, key, "full_outer")

    def differs(f: str) -> Column:
        x, y = F.col(f"was.{f}"), F.col(f"now.{f}")
        plain = ~x.eqNullSafe(y)
        return plain & F.coalesce(F.abs(x - y) > tolerance[f], F.lit(True)) if f in tolerance else plain

    changed = F.array_compact(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return j.withColumn("kind", kind).withColumn("changed", F.when(F.col("kind") == "changed", changed)).filter("kind IS NOT NULL").select(*key, "kind", "changed")


def graded_diff(diff: DataFrame) -> DataFrame:
    """Changed findings are regraded if a grade differs, else reworded."""
    grades = F.array(F.lit("overall"), F.lit("stars"))
    return diff.withColumn("what", F.when(F.col("kind") == "changed", F.when(F.arrays_overlap("changed", grades), "regraded").otherwise("reworded")).otherwise(F.col("kind")))


def digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest): the same for the same rows in any order. A row is the texts of its columns in the order of their names,
    nulls told from texts by a mark; forty bits of its md5 are summed, so that rows may repeat. Sums stay exact for any number
    of rows: they are taken in decimals, and told modulo 2^63, which changes none that a long holds."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.chr(F.lit(30))) for c in sorted(df.columns)]
    row = F.conv(F.substring(F.md5(F.concat_ws(chr(31), *texts)), 1, 10), 16, 10).cast("bigint")
    total = F.coalesce(F.sum(row.cast("decimal(13,0)")), F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), (total % F.lit(Decimal(1 << 63))).cast("bigint").alias("digest"))


def run_checks(tables: dict[str, DataFrame], rules: dict[str, tuple[tuple[str, ...], str]], spark) -> DataFrame:
    """(rule, status, violations, examples) for rules name -> (tables, SQL with {table} names that returns violating rows
    with a text column `key`). Rules over missing tables are skipped; ten examples at most are told."""
    out = None
    for name, (needs, sql) in rules.items():
        if all(t in tables for t in needs):
            bad = spark.sql(sql, **{t: tables[t] for t in needs})
            row = _told(bad).select(F.lit(name).alias("rule"), F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("status"), "violations", "examples")
        else:
            row = spark.range(1).select(F.lit(name).alias("rule"), F.lit("skipped").alias("status"), F.lit(0).cast("bigint").alias("violations"), F.array().cast("array<string>").alias("examples"))
        out = row if out is None else out.unionByName(row)
    return out


def _told(bad: DataFrame) -> DataFrame:
    """Count of violations and the first ten keys; the keys come from a sorted limit, so no list grows with the table."""
    first = bad.select("key").orderBy("key").limit(10).agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return bad.agg(F.count("*").alias("violations")).join(first)


def contains_any(df: DataFrame, words: list[str]) -> Column:
    """Whether any column of a row holds one of the strings."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    hit = F.lit(False)
    for w in words:
        for t in texts:
            hit = hit | F.contains(t, F.lit(w))
    return hit


def result_diff(spec: dict[str, tuple[DataFrame, DataFrame, str, list[str], dict[str, float]]]) -> DataFrame:
    """(table_name, key, kind) of all tables of a specification: name -> (old, new, key, fields, tolerance by field)."""
    out = None
    for name, (old, new, key, fields, tolerance) in spec.items():
        d = snapshot_compare(old, new, [key], fields, tolerance).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), "kind")
        out = d if out is None else out.unionByName(d)
    return out
