"""Absolute risk from a score's z-value: an effect of the score (area under the curve, or a ratio per standard deviation) and a
baseline risk of the population. The intercepts that keep the population's mean risk are solved once for each distinct pair of
effect and baseline, in vectors; the rest are columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES, STEPS = 40, 100


def _normal() -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of an expectation over the standard normal distribution."""
    x, w = np.polynomial.hermite_e.hermegauss(NODES)
    return x, w / w.sum()


def solved(effect: np.ndarray, baseline: np.ndarray, hazard: bool) -> np.ndarray:
    """Intercept (odds) or cumulative hazard with which the mean risk over the population is the baseline, by bisection."""
    x, w = _normal()
    slope = np.log(effect)[:, None] * x[None, :]
    lo, hi = (np.zeros(len(effect)), np.full(len(effect), 50.0)) if hazard else (np.full(len(effect), -40.0), np.full(len(effect), 40.0))
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        risk = 1 - np.exp(-mid[:, None] * np.exp(slope)) if hazard else 1 / (1 + np.exp(-np.clip(mid[:, None] + slope, -700, 700)))
        low = (risk * w).sum(axis=1) < baseline
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def per_sd(scores: DataFrame, hazard: bool) -> DataFrame:
    """scores (z, effect, baseline, ...) with `risk` from an odds ratio, or a hazard ratio, per standard deviation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(intercept=solved(b["effect"].to_numpy(), b["baseline"].to_numpy(), hazard))

    scores = scores.withColumns({k: F.col(k).cast("double") for k in ("effect", "baseline")})
    pairs = scores.select("effect", "baseline").distinct().filter("effect > 0 AND baseline > 0 AND baseline < 1")
    known = pairs.mapInPandas(run, "effect double, baseline double, intercept double")
    line = F.ln("effect") * F.col("z")
    risk = 1 - F.exp(-F.col("intercept") * F.exp(line)) if hazard else 1 / (1 + F.exp(-(F.col("intercept") + line)))
    return scores.join(known, ["effect", "baseline"], "left").withColumn("risk", risk).drop("intercept")


#: Terms of the series for the normal distribution: enough for full precision up to five standard deviations.
TERMS = 80


def normal_distribution(x: Column) -> Column:
    """Share of the standard normal distribution below x: the density times x + x^3/3 + x^5/15 + ..."""
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["total"])
    return 0.5 + total * F.exp(-x * x / 2) * F.lit(0.3989422804014327)


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution: a rational start (Abramowitz and Stegun 26.2.23, good to 5e-4), then Halley
    steps on the distribution itself; the last one changes nothing that a double can hold."""
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    # The coefficients of the start.
    start = tail - (2.515517 + tail * (0.802853 + tail * 0.010328)) / (1 + tail * (1.432788 + tail * (0.189269 + tail * 0.001308)))
    x = F.when(p < 0.5, -start).otherwise(start)

    def halley(x: Column) -> Column:
        u = (normal_distribution(x) - p) * F.exp(x * x / 2) * F.lit(2.5066282746310002)
        return x - u / (1 + x * u / 2)

    return F.aggregate(F.sequence(F.lit(1), F.lit(2)), x, lambda x, _: halley(x))


def from_auroc(z: Column, auc: Column, baseline: Column) -> Column:
    """Risk under two normal distributions of equal spread; z is measured over the whole population."""

    def risk(d: Column) -> Column:
        s = baseline * d + z * F.sqrt(1 + baseline * (1 - baseline) * d * d)
        odds = baseline / (1 - baseline) * F.exp(s * d - d * d / 2)
        return odds / (1 + odds)

    apart = F.sqrt(F.lit(2.0)) * inverse_normal(auc)
    return F.get(F.transform(F.array(apart), risk), F.lit(0))  # bound, so that it is worked out once


#: Fixed value: a cohort with a larger share of cases was enriched for them, so the share is no population's risk.
MOST_CASES = 0.2


def routes(evals: DataFrame) -> DataFrame:
    """evals (auc, odds, clinical, baseline, case_share, z, ...) with `route` and the baseline `used`: a curve that owes nothing to
    clinical covariates with a cited baseline, else with its cohort's share of cases, else a ratio with a cited baseline, else why
    there is no number."""
    c = F.col
    curve = c("auc").isNotNull() & ~c("clinical")
    cohort = F.when((c("case_share") > 0) & (c("case_share") <= MOST_CASES), c("case_share"))
    route = (
        F.when(c("z").isNull(), "no score")
        .when(curve & c("baseline").isNotNull(), "curve")
        .when(curve & cohort.isNotNull(), "curve, cohort")
        .when(c("odds").isNotNull() & c("baseline").isNotNull(), "ratio")
        .when(c("baseline").isNull(), "no baseline")
        .otherwise("no effect")
    )
    used = F.when(c("z").isNotNull(), F.when(curve, F.coalesce("baseline", cohort)).when(c("odds").isNotNull(), c("baseline")))
    return evals.withColumn("route", route).withColumn("used", used)


def absolute_risk(evals: DataFrame) -> DataFrame:
    """evals with `route` and `risk`, null where no route leads to one."""
    r = routes(evals)
    by_curve = r.filter("route LIKE 'curve%'").withColumn("risk", from_auroc(F.col("z"), F.col("auc"), F.col("used")))
    ratio = r.filter("route = 'ratio'").drop("baseline").withColumnsRenamed({"odds": "effect", "used": "baseline"})
    by_ratio = per_sd(ratio, False).select("pgs_id", "route", "risk")
    none = r.filter("route LIKE 'no %'").select("pgs_id", "route", F.lit(None).cast("double").alias("risk"))
    return by_curve.select("pgs_id", "route", "risk").unionByName(by_ratio).unionByName(none)
