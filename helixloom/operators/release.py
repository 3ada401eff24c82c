"""Releases: tables written once under a content key, read again as views, and a public copy of them."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import contains_any, digest
from .windows import parts_by_size

#: Endings of frequency columns, which are published as floats.
FREQUENCY = ("af_", "_af")
INDEX = "releases"


def _append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.coalesce(1).write.mode("append").json(f"{path}/{INDEX}")


def releases(spark: SparkSession, path: str) -> DataFrame:
    """(number, id, previous, tables json), oldest first; empty where nothing is published yet."""
    schema = "number long, id string, previous string, tables string"
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{INDEX}").getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{INDEX}")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/{INDEX}").orderBy("number")


def publish_release(tables: dict[str, DataFrame], path: str, sort: dict[str, list[str]] | None = None) -> dict | None:
    """Write tables (name -> DataFrame) and append a release to the index: id, number of rows and digest of each table, and the
    release before. Unchanged content makes no new release (None); tables that did not change are not written again. A table
    is written sorted by range where `sort` names its columns, so that readers can skip files."""
    spark = next(iter(tables.values())).sparkSession
    done = releases(spark, path).collect()  # one row for each release
    last = json.loads(done[-1]["tables"]) if done else {}
    told, written = {}, {name: t for name, t in last.items()}
    for name, df in tables.items():
        row = digest(df).first()
        key = f"{name}-{row['n_rows']}-{row['digest']:x}"
        told[name] = {"key": key, "rows": row["n_rows"]}
        if written.get(name, {}).get("key") != key:
            by = (sort or {}).get(name)
            out = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
            out.write.mode("overwrite").parquet(f"{path}/objects/{key}")
    if told == last:
        return None
    number = len(done) + 1
    release = {"number": number, "id": f"r{number:04d}", "previous": done[-1]["id"] if done else None, "tables": json.dumps(told, sort_keys=True)}
    _append(spark, path, spark.createDataFrame([release], "number long, id string, previous string, tables string"))
    return release


def open_release(spark: SparkSession, path: str, release: str | None = None) -> dict[str, DataFrame]:
    """Tables of a release (the newest if none is named), each also a temporary view of its name."""
    rows = [r for r in releases(spark, path).collect() if release in (None, r["id"])]
    if not rows:
        raise ValueError(f"no release {release or ''} in {path}")
    out = {name: spark.read.parquet(f"{path}/objects/{t['key']}") for name, t in json.loads(rows[-1]["tables"]).items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def query(spark: SparkSession, sql: str, limit: int = 1000) -> DataFrame:
    """Rows of one SELECT over the open release, `limit` at most (the cap is the feature: answers are read by people)."""
    if not re.match(r"(?is)^\s*(select|with)\b[^;]*;?\s*$", sql):
        raise ValueError("one SELECT only")
    return spark.sql(sql.rstrip().rstrip(";")).limit(limit)


def release_row(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def public_columns(df: DataFrame, private: tuple[str, ...]) -> DataFrame:
    """df without its private columns, frequencies as floats."""
    kept = [c for c in df.columns if c not in private]
    narrow = lambda c, kind: kind == "double" and (c.startswith(FREQUENCY[0]) or c.endswith(FREQUENCY[1]))
    return df.select(*[F.col(f"`{c}`").cast("float").alias(c) if narrow(c, k) else F.col(f"`{c}`") for c, k in df.dtypes if c in kept])


def export_public(df: DataFrame, private: tuple[str, ...], order: str, most: int) -> DataFrame:
    """The public form of a table with the number of its part: consecutive values of `order` (chromosomes) share a part while
    their rows fit `most`. The table of parts has one row for each chromosome."""
    counts = df.groupBy(order).agg(F.count("*").alias("n"))
    parts = parts_by_size(counts, order, "n", most).select(order, "part")
    return public_columns(df, private).join(F.broadcast(parts), order)


def write_public(tables: dict[str, DataFrame], path: str, truth_set: bool, forbidden: list[str], private: tuple[str, ...] = ()) -> None:
    """Write public copies, by part where a table has one. Refused unless the release is of a truth set, and if any column of any
    table holds one of the forbidden strings; nothing is written then."""
    if not truth_set:
        raise ValueError("only releases of a truth set are public")
    for name, df in tables.items():
        if df.filter(contains_any(df, forbidden)).limit(1).count():
            raise ValueError(f"{name} holds a private string")
    for name, df in tables.items():
        out = public_columns(df, private)
        (out.write.partitionBy("part") if "part" in out.columns else out.write).parquet(f"{path}/{name}")
