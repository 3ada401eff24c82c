"""Thinning of sites that are inherited together (linkage disequilibrium).

The rule: along a chromosome, in order of position and id, a site stays if none of the `window` - 1 sites before it that stayed is
correlated with it, r squared above the threshold, taken over the people called at both. Sums of dosages are integers, so
the comparison is exact.

How it is spread: sites are numbered along their chromosome and dealt to blocks of `window` sites; a block also gets the
sites of the block before it (a halo), so every pair that the rule compares meets in exactly one block, whose task finds
the correlated pairs by matrix products. Only those pairs go on. Decisions are taken in stretches of STRETCH blocks. Whether
a site stays depends on the last `window` - 1 sites before the stretch's edge; stretches first decide as if nothing stayed
before them, then again wherever what stayed there has changed, until nothing changes. That end is the result of going through
the sites one by one, whatever the partitions; rounds are few, as a decision's influence seldom outlives a stretch.

Defined results: null ids, positions or chromosomes take no part; a site without variation is correlated with none; repeated rows
of a site and person count once (the largest dosage); an empty cohort gives no rows; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import points_in
from .storage import forget, stored

#: Sites of a window, and the largest r squared (as a fraction) of two sites that both stay.
WINDOW, R2_NUM, R2_DEN = 1000, 1, 20
NUMBERING_BINS = 1 << 20
#: Blocks of a stretch that is decided in one go: only its correlated pairs are held.
STRETCH = 64


def outside(sites: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sites (chrom_order, pos) that lie in none of the ranges (chrom_order, start_pos, end_pos)."""
    return points_in(sites, ranges, ["chrom_order"], "pos", "start_pos", "end_pos", how="left_anti")


def numbered(sites: DataFrame) -> DataFrame:
    """sites (site_id, chrom_order, pos) with `i`, their number along the chromosome: numbers within bins of positions, on top of
    the count of the bins before, so no chromosome meets in one task."""
    rows = sites.withColumn("_bin", F.floor(F.col("pos") / NUMBERING_BINS))
    bins = rows.groupBy("chrom_order", "_bin").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("chrom_order").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("chrom_order", "_bin", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("chrom_order", "_bin").orderBy("pos", "site_id")) - 1
    return rows.withColumn("_own", own).join(bins, ["chrom_order", "_bin"]).withColumn("i", F.col("_before") + F.col("_own")).drop("_bin", "_own", "_before")


def correlated(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """For rows of dosages (-1 where missing): whether r squared of each row of x with each of y is above num / den."""
    a, b = (x >= 0).astype(float), (y >= 0).astype(float)
    u, v = np.where(x < 0, 0, x).astype(float), np.where(y < 0, 0, y).astype(float)
    n, sx, sy = a @ b.T, u @ b.T, a @ v.T
    cov = n * (u @ v.T) - sx * sy
    vx, vy = n * ((u * u) @ b.T) - sx * sx, n * (a @ (v * v).T) - sy * sy
    return den * cov * cov > num * vx * vy


def _pairs(window: int, num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        block, i = int(pdf["block"].iloc[0]), pdf["i"].to_numpy()
        own = np.flatnonzero(~pdf["halo"].to_numpy(dtype=bool))
        d = np.stack([np.frombuffer(x, dtype=np.int8) for x in pdf["d"]])
        earlier: list[list[int]] = []
        for lo in range(0, len(own), 256):  # the matrix of a slice of own sites with all before them
            rows = own[lo : lo + 256]
            near = correlated(d[rows], d, num, den) & (i[None, :] < i[rows][:, None]) & (i[None, :] > i[rows][:, None] - window)
            earlier += [i[np.flatnonzero(r)].tolist() for r in near]
        return pd.DataFrame({"chrom_order": pdf["chrom_order"].iloc[0], "block": block, "i": i[own], "earlier": earlier})

    return run


def _decide(window: int, span: int):
    """Sites of a stretch that stay, given those that stay at the end of the stretch before; `tail` are those at its own end."""

    def run(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"chrom_order": [], "stretch": [], "kept": [], "tail": []}, dtype=object)
        stays = set(before["tail"].iloc[0]) if len(before) else set()
        kept = []
        for i, earlier in sorted(zip(rows["i"], rows["earlier"]), key=lambda r: r[0]):
            if not stays.intersection(earlier):
                stays.add(i)
                kept.append(i)
        end = (int(key[1]) + 1) * span
        return pd.DataFrame({"chrom_order": [key[0]], "stretch": [key[1]], "kept": [kept], "tail": [[i for i in kept if i > end - window]]})

    return run


def ld_prune(cohort: DataFrame, window: int = WINDOW, num: int = R2_NUM, den: int = R2_DEN, excluded: DataFrame | None = None) -> DataFrame:
    """(site_id, chrom_order, pos, kept) of the sites of a cohort (site_id, chrom_order, pos, sample, dosage) outside the excluded
    ranges (chrom_order, start_pos, end_pos)."""
    rows = cohort.filter("site_id IS NOT NULL AND chrom_order IS NOT NULL AND pos IS NOT NULL AND sample IS NOT NULL").repartition("site_id", "chrom_order", "pos")
    rows = rows.groupBy("site_id", "chrom_order", "pos", "sample").agg(F.coalesce(F.max("dosage"), F.lit(-1)).alias("dosage"))
    people = [r["sample"] for r in rows.select("sample").distinct().orderBy("sample").collect()]  # a panel's people
    at = {s: k for k, s in enumerate(people)}

    def packed(samples: pd.Series, dosages: pd.Series) -> pd.Series:
        out = []
        for s, d in zip(samples, dosages):
            line = np.full(len(at), -1, dtype=np.int8)
            line[[at[x] for x in s]] = d
            out.append(line.tobytes())
        return pd.Series(out)

    held = rows.groupBy("site_id", "chrom_order", "pos").agg(F.collect_list(F.struct("sample", "dosage")).alias("g"))
    held = held.select("site_id", "chrom_order", "pos", F.pandas_udf(packed, "binary")(F.col("g.sample"), F.col("g.dosage")).alias("d"))
    packed_sites = stored(held, "packed")
    sites = stored(numbered(outside(packed_sites, excluded) if excluded is not None else packed_sites).withColumn("block", F.floor(F.col("i") / window)), "sites")
    own = sites.select("chrom_order", "block", "i", "d", F.lit(False).alias("halo"))
    halo = sites.select("chrom_order", (F.col("block") + 1).alias("block"), "i", "d", F.lit(True).alias("halo"))
    kinds = dict(sites.dtypes)
    blocks = f"chrom_order {kinds['chrom_order']}, block long"
    ahead = sites.select("chrom_order", "block").distinct()
    near = own.unionByName(halo.join(ahead, ["chrom_order", "block"], "left_semi"))
    links = stored(near.groupBy("chrom_order", "block").applyInPandas(_pairs(window, num, den), f"{blocks}, i long, earlier array<long>"), "links")

    span = window * STRETCH
    links = links.withColumn("stretch", F.floor(F.col("i") / span))
    keys, schema = ["chrom_order", "stretch"], f"chrom_order {kinds['chrom_order']}, stretch long, kept array<long>, tail array<long>"
    kept, todo = None, links
    while True:
        was = kept.select("chrom_order", (F.col("stretch") + 1).alias("stretch"), "tail") if kept is not None else links.sparkSession.createDataFrame([], f"chrom_order {kinds['chrom_order']}, stretch long, tail array<long>")
        new = stored(todo.groupBy(*keys).cogroup(was.groupBy(*keys)).applyInPandas(_decide(window, span), schema), "decided")
        if kept is None:
            kept, changed = new, new.filter(F.size("tail") > 0).select(*keys)
        else:
            both = new.select(*keys, "tail").join(kept.select(*keys, F.col("tail").alias("was")), keys)
            changed = stored(both.filter("tail <> was").select(*keys), "changed")
            last, kept = kept, stored(kept.join(new.select(*keys), keys, "left_anti").unionByName(new), "kept")
            forget(last)
        after = changed.select("chrom_order", (F.col("stretch") + 1).alias("stretch"))
        todo = links.join(after, keys, "left_semi")
        if todo.isEmpty():
            break
    stays = kept.select("chrom_order", F.explode("kept").alias("i")).withColumn("kept", F.lit(True))
    return sites.join(stays, ["chrom_order", "i"], "left").select("site_id", "chrom_order", "pos", F.coalesce("kept", F.lit(False)).alias("kept"))
