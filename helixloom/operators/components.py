"""Principal components of genotypes, and projection of new people, over rows of (site_id, sample, dosage).

Sites are filtered and standardised in Spark: those missing in MOST_LOST of the people or more, or with a minor allele at
LEAST_MAF or below, are left out; a missing dosage counts as the site's mean; a dosage's distance from the mean is divided by its
standard deviation under Hardy-Weinberg. Each site becomes one row of people's values.

A panel of up to MOST_GRAM people goes through the people x people matrix of products: tasks add up the products of all
their sites (one matrix in memory, however many sites), hand on strips of it, and strips are added in order of the tasks.
Larger panels go through randomised subspace iteration: the same sums over a block of PROBES directions, so that tasks
and driver hold people x directions numbers. Both are the same components; signs are fixed, the largest entry of each is
positive.

Defined results: people and sites with nulls as ids take no part; repeated rows of a site and person count once (the largest
dosage); fewer than k components with a positive variance give those; an empty panel gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stored

#: Most people without a call at a site, and least share of the rarer allele.
MOST_LOST, LEAST_MAF = 0.05, 0.01
MOST_GRAM, STRIP_NUMBERS = 2_000, 1 << 20
PROBES, ROUNDS = 20, 12
#: Sums are taken in parts of at least PART_SITES sites, in TASKS parts at most.
TASKS, PART_SITES = 64, 4_096
#: Rows of the cohort in a part that is made ready in one task.
PART_ROWS = 500_000


@dataclass
class Components:
    people: DataFrame  # (sample, axis, pc)
    loadings: DataFrame  # (site_id, mean, sd, loading array<double>)
    variances: list[float]  # of each axis, largest first
    sites: int


def site_statistics(cohort: DataFrame, most_lost: float = MOST_LOST, least_maf: float = LEAST_MAF) -> DataFrame:
    """(site_id, mean, sd) of the sites that are kept."""
    g = cohort.groupBy("site_id").agg(F.count("*").alias("people"), F.count("dosage").alias("called"), F.sum("dosage").alias("copies"))
    mean = F.col("copies") / F.col("called")
    kept = (F.col("people") - F.col("called") < most_lost * F.col("people")) & (F.least(mean / 2, 1 - mean / 2) > least_maf)
    return g.filter(F.col("called") > 0).filter(kept).select("site_id", mean.alias("mean"), F.sqrt(mean * (1 - mean / 2)).alias("sd"))


def numbered(cohort: DataFrame) -> DataFrame:
    """(sample, at): people in order, from 0. A panel's people are one small table."""
    people = cohort.select("sample").distinct()
    return people.select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("at"))


def standardised(cohort: DataFrame, sites: DataFrame, people: DataFrame, n: int) -> DataFrame:
    """(site_id, mean, sd, z array<double>): a row of all people's values for each site."""
    z = F.coalesce((F.col("dosage") - F.col("mean")) / F.col("sd"), F.lit(0.0))
    rows = cohort.join(sites, "site_id").join(F.broadcast(people) if n <= 500_000 else people, "sample")
    held = rows.groupBy("site_id", "mean", "sd").agg(F.map_from_entries(F.collect_list(F.struct("at", z.alias("z")))).alias("m"))
    return held.select("site_id", "mean", "sd", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("z"))


def _values(b: pd.DataFrame) -> np.ndarray:
    return np.stack(b["z"].to_numpy())


def _summed(rows: DataFrame, tasks: int, n: int, width: int, product) -> np.ndarray:
    """The n x width matrix that `product` of batches of rows adds up to, in a number of parts that follows from the data alone."""
    strip = max(1, STRIP_NUMBERS // max(1, width * tasks))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = None, None

        def told() -> Iterator[pd.DataFrame]:
            for s in range(0, n, strip):
                yield pd.DataFrame({"strip": [s], "part": [part], "m": [total[s : s + strip].tobytes()]})

        for b in batches:
            for own, rows in b.groupby("part", sort=False):
                if own != part and total is not None:
                    yield from told()
                    total = None
                part = int(own)
                for k in range(0, len(rows), 512):
                    more = product(_values(rows.iloc[k : k + 512]))
                    total = more if total is None else total + more
        if total is not None:
            yield from told()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m, dtype=float) for m in pdf.sort_values("part")["m"])
        return pd.DataFrame({"strip": [int(pdf["strip"].iloc[0])], "m": [total.tobytes()]})

    parts = rows.withColumn("part", F.pmod(F.xxhash64("site_id"), F.lit(tasks)).cast("int")).repartition(tasks, "part").sortWithinPartitions("part", "site_id")
    strips = parts.mapInPandas(add, "strip int, part int, m binary").groupBy("strip").applyInPandas(merge, "strip int, m binary").collect()
    if not strips:
        return np.zeros((n, width))
    return np.frombuffer(b"".join(r["m"] for r in sorted(strips)), dtype=float).reshape(n, width)


def gram(rows: DataFrame, tasks: int, n: int) -> np.ndarray:
    """Products of all pairs of people, summed over sites; n is at most MOST_GRAM."""
    return _summed(rows, tasks, n, n, lambda z: z.T @ z)


def _signed(u: np.ndarray) -> np.ndarray:
    top = u[np.argmax(np.abs(np.round(u, 9)), axis=0), np.arange(u.shape[1])]
    return u * np.where(top < 0, -1.0, 1.0)


def _by_gram(rows: DataFrame, tasks: int, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(gram(rows, tasks, n))
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def _by_subspace(rows: DataFrame, tasks: int, n: int, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors from products with a block of directions, orthonormalised between rounds."""
    width = min(n, k + PROBES)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))
    for _ in range(ROUNDS):
        held = q
        y = _summed(rows, tasks, n, width, lambda z: z.T @ (z @ held))
        q, _ = np.linalg.qr(y)
    small = held.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1][:k], (held @ vectors)[:, ::-1][:, :k]


def _once(cohort: DataFrame) -> DataFrame:
    """One row of each site and person, dealt by site first: tasks that read the cohort hold no table of its rows, what follows by
    site needs no other shuffle, and the number of parts follows from the rows, so that none grows with them."""
    parts = max(1, -(-cohort.count() // PART_ROWS))
    return cohort.select("site_id", "sample", "dosage").repartition(parts, "site_id").groupBy("site_id", "sample").agg(F.max("dosage").alias("dosage"))


def principal_components(cohort: DataFrame, k: int = 10, must_have: str | int | None = None, most_gram: int = MOST_GRAM) -> Components:
    """Components of a cohort (site_id, sample, dosage). must_have: a person at whose missing sites all are left out, so that the
    person stands among the others unshrunk."""
    spark = cohort.sparkSession
    rows = _once(cohort.filter("site_id IS NOT NULL AND sample IS NOT NULL"))
    sites = site_statistics(rows)
    if must_have is not None:
        theirs = rows.filter((F.col("sample") == must_have) & F.col("dosage").isNotNull()).select("site_id")
        sites = sites.join(theirs, "site_id", "left_semi")
    people = stored(numbered(rows), "people")
    n = people.count()
    z = stored(standardised(rows, sites, people, max(n, 1)), "standardised")
    n_sites = z.count()
    if not n or not n_sites:
        return Components(spark.createDataFrame([], "sample long, axis int, pc double"), spark.createDataFrame([], "site_id long, mean double, sd double, loading array<double>"), [], 0)
    values, vectors = (_by_gram if n <= most_gram else _by_subspace)(z, min(TASKS, -(-n_sites // PART_SITES)), n, k)
    some = values > 1e-9 * max(values[0], 1e-300)
    values, vectors = values[some], _signed(vectors[:, some])
    return Components(_people(spark, people, vectors * np.sqrt(values)), _loadings(z, vectors / np.sqrt(values)), values.tolist(), n_sites)


def _people(spark: SparkSession, people: DataFrame, pcs: np.ndarray) -> DataFrame:
    table = spark.createDataFrame(pd.DataFrame({"at": np.arange(len(pcs)), "pcs": [r.tolist() for r in pcs]}), "at int, pcs array<double>")
    return people.join(table, "at").select("sample", F.posexplode("pcs").alias("i", "pc")).select("sample", (F.col("i") + 1).alias("axis"), "pc")


def _loadings(z: DataFrame, weights: np.ndarray) -> DataFrame:
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"site_id": b["site_id"], "mean": b["mean"], "sd": b["sd"], "loading": list(_values(b) @ weights)})

    return z.mapInPandas(load, f"site_id {dict(z.dtypes)['site_id']}, mean double, sd double, loading array<double>")


def project(cohort: DataFrame, loadings: DataFrame) -> DataFrame:
    """(sample, axis, pc) of people (site_id, sample, dosage) on a panel's components: a join by site and a sum; missing dosages
    count as the panel's mean."""
    rows = _once(cohort).join(loadings, "site_id")
    z = F.coalesce((F.col("dosage") - F.col("mean")) / F.col("sd"), F.lit(0.0))
    parts = rows.select("sample", z.alias("z"), F.posexplode("loading").alias("i", "w"))
    return parts.groupBy("sample", (F.col("i") + 1).alias("axis")).agg(F.sum(F.col("z") * F.col("w")).alias("pc"))


def region_components(panel: DataFrame, person: DataFrame, k: int = 10) -> Components:
    """Components of one region's people with a person (site_id, dosage) as one more row, named by the null-free id -1."""
    me = person.select("site_id", F.lit(-1).cast(dict(panel.dtypes)["sample"]).alias("sample"), "dosage")
    shared = panel.join(me.select("site_id").distinct(), "site_id", "left_semi")
    return principal_components(shared.select("site_id", "sample", "dosage").unionByName(me), k, must_have=-1)
