"""Scores set right for ancestry: the most similar population by a forest, and scores less what components explain.

A score's mean, and the variance about it, are each a straight-line function of the first components, fitted on the reference
people. The fits need only sums of products, which Spark aggregates for each score; a system of (axes + 1) equations is then
solved for each score, and both fits are applied to all rows as columns. z_norm1 is the distance from the fitted mean in
standard deviations of the reference's distances, z_norm2 the distance over the root of the fitted variance.

The forest is fitted on a bounded sample of labelled people: the PER_CLASS of each population whose hashed id is smallest, the same
ones in every run, in one partition and in order, with a fixed seed; all rows are then judged.

Defined results: people without components or scores without a value take no part in the fits and have null results; a
score whose reference does not vary has null results; a variance that is fitted as zero or less gives a null z_norm2; equal
components are fitted by the least coefficients; repeated rows count as often as they stand; an empty reference gives null results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import hash_sample

#: Components of the forest and of the fits.
FOREST_AXES, FIT_AXES = 5, 4
PER_CLASS, TREES, DEPTH, SEED = 2_000, 60, 8, 11
#: A spread that is nothing but rounding, as a share of the scores themselves.
FLAT = 1e-10


def _line(k: int) -> list[Column]:
    """1 and the first k components."""
    return [F.lit(1.0), *[F.get("pc", F.lit(i)) for i in range(k)]]


def _fitted(rows: DataFrame, by: str, y: Column, k: int, name: str) -> DataFrame:
    """(by, name array<double>): coefficients of y on 1 and k components, for each value of `by`."""
    x = _line(k)
    products = F.array(*[F.sum(x[i] * x[j]) for i in range(k + 1) for j in range(k + 1)])
    sums = rows.groupBy(by).agg(products.alias("xx"), F.array(*[F.sum(v * y) for v in x]).alias("xy"))
    kind = dict(rows.dtypes)[by]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [np.linalg.pinv(np.array(xx, dtype=float).reshape(k + 1, k + 1), rcond=1e-12, hermitian=True) @ np.array(xy, dtype=float) for xx, xy in zip(b["xx"], b["xy"])]
            yield pd.DataFrame({by: b[by], name: out})

    return sums.mapInPandas(solve, f"{by} {kind}, {name} array<double>")


def _value(coefficients: str, k: int) -> Column:
    return sum((F.get(coefficients, F.lit(i)) * v for i, v in enumerate(_line(k))), F.lit(0.0))


def adjusted(scores: DataFrame, k: int = FIT_AXES, by: str = "score_id") -> DataFrame:
    """scores (by, score, pc, reference, ...) with z_norm1 and z_norm2."""
    usable = F.col("score").isNotNull() & F.col("pc").isNotNull() & (F.size("pc") >= k)
    ref = F.col("reference") & usable
    mean = _fitted(scores.filter(ref), by, F.col("score"), k, "_mean")
    rows = scores.join(mean, by, "left").withColumn("_off", F.when(usable, F.col("score") - _value("_mean", k)))
    square = F.col("_off") * F.col("_off")
    about = rows.filter(ref)
    spread = _fitted(about, by, square, k, "_spread").join(about.groupBy(by).agg(F.sqrt(F.avg(square)).alias("_sd"), F.max(F.abs("score")).alias("_size")), by)
    rows = rows.join(spread, by, "left").withColumn("_var", _value("_spread", k))
    vary = F.col("_sd") > FLAT * F.col("_size")
    return rows.withColumns({"z_norm1": F.when(vary, F.col("_off") / F.col("_sd")), "z_norm2": F.when(vary & (F.col("_var") > 0), F.col("_off") / F.sqrt("_var"))}).drop("_mean", "_off", "_spread", "_sd", "_size", "_var")


def population_similarity(people: DataFrame, k: int = FOREST_AXES, per_class: int = PER_CLASS, seed: int = SEED) -> DataFrame:
    """people (vec_id, population, pc, reference) with `called`, the population that the forest finds most similar, and its
    `probability`; the populations of people that are not of the reference are not looked at."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = people.filter(F.col("reference") & F.col("population").isNotNull() & (F.size("pc") >= k)).select("vec_id", "population", "pc")
    sample = hash_sample(known, ["population"], ["vec_id"], per_class)
    names = [r["population"] for r in sample.select("population").distinct().orderBy("population").collect()]  # populations of a panel
    kind = dict(people.dtypes)["population"]
    if not names:
        return people.withColumns({"called": F.lit(None).cast(kind), "probability": F.lit(None).cast("double")})
    axes = array_to_vector(F.slice("pc", 1, k))
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("population")).cast("double") - 1
    train = sample.select("vec_id", number.alias("label"), axes.alias("features")).coalesce(1).sortWithinPartitions("vec_id")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(train)
    able = people.filter(F.size("pc") >= k).withColumn("features", axes)
    chance = vector_to_array("probability")
    told = forest.transform(able).withColumns({"called": F.get(F.array(*[F.lit(n) for n in names]).cast(f"array<{kind}>"), F.col("prediction").cast("int")), "probability": F.array_max(chance)})
    told = told.select(*people.columns, "called", "probability")
    unable = people.filter(~F.coalesce(F.size("pc") >= k, F.lit(False))).withColumns({"called": F.lit(None).cast(kind), "probability": F.lit(None).cast("double")})
    return told.unionByName(unable)
