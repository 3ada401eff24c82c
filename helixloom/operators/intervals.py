"""Joins and aggregations over intervals. Intervals are 0-based half-open, points are 1-based: a point lies in an
interval if start < pos <= end.

Range joins deal both sides into bins, and join on (keys, bin) with the exact condition on top. Bins also spread hot
chromosomes over tasks. Bins come in levels, each FACTOR times as wide as the one below: an interval is filed at the lowest level
at which it touches no more than FACTOR + 1 bins, so its copies are bounded however long it is, and a point looks up one bin of
each level in use. How many levels there are follows from the longest interval: one number, which the caller gives where it is
known and which is read off the intervals otherwise. Intervals no longer than FACTOR * width need one level, and points are not
copied then. A pair of intervals meets at the higher of their two levels, in the bin of the larger start, so no pair is
counted twice and nothing needs to be made distinct.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import SKIP_FLAGS, query_offset

WIDTH = 2048
#: Bins of a level are FACTOR times as wide as those of the level below; the highest has bins of more than two billion letters.
FACTOR, LEVELS = 16, 6
#: Least mapping and base quality of a read that counts.
MIN_MAPQ, MIN_BASEQ = 20, 20


def _touched(lo: Column, hi: Column, width) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width)))


def _width(level, width: int) -> Column:
    return F.element_at(F.array(*[F.lit(width * FACTOR**k) for k in range(LEVELS)]), level + 1)


def _level(length: Column, width: int) -> Column:
    """The lowest level at which an interval of this length touches FACTOR + 1 bins at most."""
    out = F.lit(0)
    for k in range(1, LEVELS):
        out = F.when(length > width * FACTOR**k, k).otherwise(out)
    return out


def highest(longest: int | None, width: int = WIDTH) -> int:
    return next((k for k in range(LEVELS) if (longest or 0) <= width * FACTOR ** (k + 1)), LEVELS - 1)


def _longest(*spans: tuple[DataFrame, str, str]) -> int:
    """The longest interval of all, one number."""
    return max(df.agg(F.max(F.col(e) - F.col(s))).first()[0] or 0 for df, s, e in spans)


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, how: str = "inner", width: int = WIDTH, longest: int | None = None) -> DataFrame:
    """Points joined to the intervals that hold them; how: inner, left, left_semi or left_anti. `longest` bounds the intervals' lengths."""
    top = highest(_longest((intervals, start, end)) if longest is None else longest, width)
    own = _level(F.col(end) - F.col(start), width) if top else F.lit(0)
    right = intervals.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in intervals.columns if c not in keys], own.alias("_r_level"))
    right = right.withColumn("_r_bin", _touched(F.col(start) + 1, F.col(end), _width(F.col("_r_level"), width) if top else F.lit(width)))
    drop = ["_bin", "_r_bin", "_level", "_r_level", *[f"_r_{k}" for k in keys]]
    if not top:
        left = points.withColumn("_bin", F.floor(F.col(pos) / width))
        on = [left[k] == right[f"_r_{k}"] for k in keys] + [left["_bin"] == right["_r_bin"], left[pos] > right[start], left[pos] <= right[end]]
        return left.join(right, on, how).drop(*drop)
    # With several levels a point has several copies: whether it is held is found for distinct points first.
    seeds = points if how == "inner" else points.select(*keys, pos).distinct()
    left = seeds.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(top + 1)])))
    left = left.withColumn("_bin", F.floor(F.col(pos) / _width(F.col("_level"), width)))
    on = [left[k] == right[f"_r_{k}"] for k in keys] + [left["_level"] == right["_r_level"], left["_bin"] == right["_r_bin"], left[pos] > right[start], left[pos] <= right[end]]
    found = left.join(right, on).drop(*drop)
    if how == "inner":
        return found
    return points.join(found.select(*keys, pos).distinct() if how in ("left_semi", "left_anti") else found, [*keys, pos], how)


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = WIDTH, longest: int | None = None) -> DataFrame:
    """Pairs of intervals that share a base. Columns of both sides must have different names, keys aside."""
    (s1, e1), (s2, e2) = a_span, b_span
    top = highest(_longest((a, s1, e1), (b, s2, e2)) if longest is None else longest, width)

    def filed(df: DataFrame, s: str, e: str, tag: str) -> DataFrame:
        if not top:
            return df.withColumn(f"{tag}bin", _touched(F.col(s), F.col(e) - 1, F.lit(width)))
        own = df.withColumn(f"{tag}own", _level(F.col(e) - F.col(s), width))
        levels = own.withColumn(f"{tag}level", F.explode(F.sequence(F.col(f"{tag}own"), F.lit(top))))  # its own, and those of longer ones
        return levels.withColumn(f"{tag}bin", _touched(F.col(s), F.col(e) - 1, _width(F.col(f"{tag}level"), width)))

    left = filed(a, s1, e1, "_l_")
    right = filed(b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys]), s2, e2, "_r_")
    on = [left[k] == right[f"_r_{k}"] for k in keys] + [left["_l_bin"] == right["_r_bin"], left[s1] < right[e2], right[s2] < left[e1]]
    if top:
        on += [left["_l_level"] == right["_r_level"], F.greatest(left["_l_own"], right["_r_own"]) == left["_l_level"]]
    step = _width(left["_l_level"], width) if top else F.lit(width)
    on.append(left["_l_bin"] == F.floor(F.greatest(left[s1], right[s2]) / step))
    return left.join(right, on).drop(*[f"_{x}_{c}" for x in "lr" for c in ("bin", "level", "own")], *[f"_r_{k}" for k in keys])


def _clipped(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """(keys, _bin, s, e): the part of each interval in each bin that it touches, with one bin's parts in one partition."""
    rows = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_bin", _touched(F.col("_s"), F.col("_e") - 1, F.lit(width)))
    cut = rows.select(*keys, "_bin", F.greatest("_s", F.col("_bin") * width).alias("s"), F.least("_e", (F.col("_bin") + 1) * width).alias("e"))
    return cut.repartition(*keys, "_bin")


def _ends(runs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Runs (keys, _bin, s, e, ...) that are neither the first nor the last of their bin, and those that are: few, and the only ones
    that can go on in another bin."""
    inside = Window.partitionBy(*keys, "_bin")
    told = runs.withColumns({"_first": F.row_number().over(inside.orderBy("s")) == 1, "_last": F.lead("s").over(inside.orderBy("s")).isNull()})
    edge = F.col("_first") | F.col("_last")
    return told.filter(~edge).drop("_first", "_last"), told.filter(edge)


def merge(df: DataFrame, keys: list[str], start: str, end: str, width: int = 64 * WIDTH) -> DataFrame:
    """Overlapping and touching intervals become one. Intervals are cut at the edges of bins and merged inside each; what stands
    first or last in a bin is then merged along the chromosome."""
    inside = Window.partitionBy(*keys, "_bin").orderBy("s", "e")
    reach = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = _clipped(df, keys, start, end, width).withColumn("_new", F.when(F.col("s") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    within, edges = _ends(rows.groupBy(*keys, "_bin", "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island"), keys)
    along = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("_new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    tied = edges.groupBy(*keys, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return within.select(*keys, "s", "e").unionByName(tied.drop("_run")).select(*keys, F.col("s").alias(start), F.col("e").alias(end))


def depth_runs(df: DataFrame, keys: list[str], start: str, end: str, bounds: tuple[int, ...], width: int = 64 * WIDTH) -> DataFrame:
    """Maximal runs of one depth class (number of bounds reached), from the first start to the last end. Intervals are cut at the
    edges of bins, so a sweep inside a bin needs nothing from others; first and last runs of bins, and the gaps between bins,
    are then tied along the chromosome."""
    cut = _clipped(df.filter(F.col(start) < F.col(end)), keys, start, end, width)
    steps = cut.select(*keys, "_bin", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(*keys, "_bin", F.col("x.at").alias("s")).agg(F.sum("x.d").alias("d"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("s")
    steps = steps.withColumns({"depth": F.sum("d").over(inside), "e": F.lead("s").over(inside)}).filter("e IS NOT NULL")
    cls = F.lit(0)
    for b in bounds:
        cls = cls + F.when(F.col("depth") >= b, 1).otherwise(0)

    def tied(rows: DataFrame, by: list[str]) -> DataFrame:
        """Neighbouring rows (s, e, cls) that follow one another without a gap or a change of class become one."""
        order = Window.partitionBy(*by).orderBy("s")
        same = (F.lag("cls").over(order) == F.col("cls")) & (F.lag("e").over(order) == F.col("s"))
        runs = rows.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
        return runs.groupBy(*by, "_run", "cls").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")

    within, edges = _ends(tied(steps.withColumn("cls", cls), [*keys, "_bin"]), keys)
    # Behind a bin's last run, up to the next bin that has any, nothing is read.
    order = Window.partitionBy(*keys).orderBy("s")
    edges = edges.withColumn("_next", F.lead("s").over(order))
    gap = F.when(F.col("_last") & (F.col("_next") > F.col("e")), F.struct(F.col("e").alias("s"), F.col("_next").alias("e"), F.lit(0).alias("cls")))
    edges = edges.select(*keys, F.inline(F.array_compact(F.array(F.struct("s", "e", "cls"), gap))))
    runs = within.select(*keys, "cls", "s", "e").unionByName(tied(edges, keys))
    return runs.select(*keys, "cls", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))


def window_depth(df: DataFrame, keys: list[str], start: str, end: str, width: int = 1000) -> DataFrame:
    """Bases of reads in each window, and their mean depth; windows without reads are not listed."""
    w = df.withColumn("w", _touched(F.col(start), F.col(end) - 1, width))
    share = F.least(F.col(end), (F.col("w") + 1) * width) - F.greatest(F.col(start), F.col("w") * width)
    return w.groupBy(*keys, (F.col("w") * width).alias("start_pos")).agg(F.sum(share).alias("bases")).withColumn("mean_depth", F.col("bases") / width)


def nearest_other(points: DataFrame, others: Column, keys: list[str], pos: str, reach: int, width: int = WIDTH) -> DataFrame:
    """Distinct points with the distance to the nearest other point of which a row is among `others` within reach (null if none) and
    whether one of them stands at the point itself. Points are dealt into bins, those within reach of a bin's edge into the next
    one too, and each looks at its neighbours within reach: nothing is joined, and a bin holds width + 2 * reach points at most."""
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, pos)])
    one = points.groupBy(*keys, pos).agg(F.max(F.when(known & others, 1).otherwise(0)).alias("at_point"))
    touched = F.sequence(F.floor((F.col(pos) - reach) / width), F.floor((F.col(pos) + reach) / width))
    order = Window.partitionBy(*keys, "_bin").orderBy(pos)
    at = F.when(F.col("at_point") == 1, F.col(pos))
    before, after = F.max(at).over(order.rangeBetween(-reach, -1)), F.min(at).over(order.rangeBetween(1, reach))
    found = one.withColumn("_bin", F.explode_outer(touched)).withColumn("nearest", F.least(F.col(pos) - before, after - F.col(pos)))
    return found.filter(F.col("_bin").eqNullSafe(F.floor(F.col(pos) / width))).select(*keys, pos, "nearest", "at_point")


def snv_counts(sites: DataFrame, reads: DataFrame, longest: int | None = None) -> DataFrame:
    """Reads by the letter that they show at single-letter sites (chrom_order, pos, ref, alt). Reads of low mapping quality are
    counted apart, then those with a poor base at the site; a gap in the alignment counts as another letter."""
    r = reads.filter(F.col("flag").bitwiseAND(SKIP_FLAGS) == 0).select("chrom_order", "flag", "mapq", "cigar", "seq", "qual", "start_pos", "end_pos")
    j = points_in(sites, r, ["chrom_order"], "pos", "start_pos", "end_pos", longest=longest)
    j = j.withColumn("at", query_offset(F.col("cigar"), F.col("pos") - F.col("start_pos") - 1))
    j = j.withColumns({"base": F.substring("seq", F.col("at") + 1, F.lit(1)), "q": F.ascii(F.substring("qual", F.col("at") + 1, F.lit(1))) - 33})
    n = lambda c: F.count(F.when(c, 1))
    sure = F.col("mapq") >= MIN_MAPQ
    gap, poor = F.col("at").isNull(), F.coalesce(F.col("q") < MIN_BASEQ, F.lit(False))
    shows = lambda c: sure & ~gap & ~poor & (F.col("base") == F.col(c))
    forward = F.col("flag").bitwiseAND(16) == 0
    return j.groupBy("chrom_order", "pos", "ref", "alt").agg(
        n(~sure).alias("low_mapq"),
        n(sure & ~gap & poor).alias("low_baseq"),
        n(shows("ref")).alias("ref_reads"),
        n(shows("alt")).alias("alt_reads"),
        n(sure & (gap | (~poor & (F.col("base") != F.col("ref")) & (F.col("base") != F.col("alt"))))).alias("other"),
        n(shows("ref") & forward).alias("ref_fwd"),
        n(shows("alt") & forward).alias("alt_fwd"),
    )
