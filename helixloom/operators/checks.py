"""Self-checks of a release: rules of four kinds, and one way to run them.

A row rule is a condition that no row may meet; a pair rule compares rows of two tables that should agree; an orphan rule names
rows that must have a partner in another table; a group rule is a condition on a table's totals. Rules are values, so
they can be told in SQL as well; `run` makes DataFrames of them: each table is read once for all its row rules (a row hands on the
names of those that it breaks) and once for its totals, the others are joins.

Defined results: a condition that is null is not met; rules over missing tables are skipped; an empty table passes its row rules; at
most ten keys of each rule are told, the first in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXAMPLES = 10


def lacks(*columns: str) -> str:
    return " OR ".join(f"{c} IS NULL" for c in columns)


def one_of(column: str, *values: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def outside(column: str, low: float, high: float) -> str:
    return f"({column} < {low} OR {column} > {high})"


def all_of(*conditions: str) -> str:
    return " AND ".join(f"({c})" for c in conditions)


def any_of(*conditions: str) -> str:
    return " OR ".join(f"({c})" for c in conditions)


def but_not(condition: str, allowed: str) -> str:
    """The condition holds, and what would allow it does not (or is unknown)."""
    return f"({condition}) AND NOT coalesce({allowed}, FALSE)"


def either_alone(a: str, b: str) -> str:
    """Two conditions that should hold together, or not at all."""
    return f"({a}) <> ({b})"


@dataclass(frozen=True)
class Row:
    table: str
    key: str
    broken: str

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.table,)


@dataclass(frozen=True)
class Orphan:
    """Rows of `table` that meet `where` have a row in `other` with the same key."""

    table: str
    key: str
    other: str
    other_key: str
    where: str = "TRUE"

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.table, self.other)


@dataclass(frozen=True)
class Pair:
    """Rows of both tables with the same key do not differ as `broken` says, where a. and b. are the two."""

    table: str
    key: str
    other: str
    other_key: str
    broken: str

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.table, self.other)


@dataclass(frozen=True)
class Group:
    """Totals of the rows that meet `where`, for each value of `by` (of all, if it is empty), are not as `broken` says."""

    table: str
    key: str
    broken: str
    where: str = "TRUE"
    by: str = ""

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.table,)


Rule = Row | Orphan | Pair | Group


def violations(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    """(key) of what breaks a rule that is not a row rule."""
    a = tables[rule.table]
    if isinstance(rule, Group):
        picked = a.filter(rule.where)
        names = [c.strip() for c in rule.by.split(",") if c.strip()]
        parts = picked.groupBy(*names).agg(F.expr(rule.broken).alias("_broken"))
        return parts.filter("_broken").select(F.expr(rule.key).cast("string").alias("key"))
    b = tables[rule.other]
    if isinstance(rule, Orphan):
        keyed = a.filter(rule.where).select(F.expr(rule.key).alias("_k"))
        return keyed.join(b.select(F.expr(rule.other_key).alias("_k")), "_k", "left_anti").select(F.col("_k").cast("string").alias("key"))
    x, y = a.alias("a"), b.alias("b")
    met = x.join(y, F.expr(f"a.{rule.key} = b.{rule.other_key}"))
    return met.filter(rule.broken).select(F.col(f"a.{rule.key}").cast("string").alias("key"))


def run(spark: SparkSession, tables: dict[str, DataFrame], rules: dict[str, Rule]) -> DataFrame:
    """(rule, status: pass, fail or skipped, violations, examples)."""
    able = {n: r for n, r in rules.items() if all(t in tables for t in r.needs)}
    found = []
    for table in sorted({r.table for r in able.values() if isinstance(r, Row)}):
        own = {n: r for n, r in able.items() if isinstance(r, Row) and r.table == table}
        told = F.array_compact(F.array(*[F.when(F.expr(r.broken), F.struct(F.lit(n).alias("rule"), F.expr(r.key).cast("string").alias("key"))) for n, r in own.items()]))
        found.append(tables[table].select(F.inline(told)))
    found += [violations(r, tables).select(F.lit(n).alias("rule"), "key") for n, r in able.items() if not isinstance(r, Row)]
    state = spark.createDataFrame([(n, n in able) for n in rules], "rule string, able boolean")
    if found:
        bad = found[0]
        for more in found[1:]:
            bad = bad.unionByName(more)
        first = F.row_number().over(Window.partitionBy("rule").orderBy(F.asc_nulls_last("key")))
        shown = bad.withColumn("_n", first).filter(F.col("_n") <= EXAMPLES).groupBy("rule").agg(F.array_sort(F.collect_list("key")).alias("examples"))
        state = state.join(bad.groupBy("rule").agg(F.count("*").alias("violations")), "rule", "left").join(shown, "rule", "left")
    else:
        state = state.withColumns({"violations": F.lit(0).cast("bigint"), "examples": F.array().cast("array<string>")})
    n = F.coalesce("violations", F.lit(0)).cast("bigint")
    status = F.when(~F.col("able"), "skipped").when(n > 0, "fail").otherwise("pass")
    return state.select("rule", status.alias("status"), n.alias("violations"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
