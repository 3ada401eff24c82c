"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). A flow routes token
capacity from patterns to the quotas of the sources; every further repetition of a pattern costs more than the last
(convex costs), so repeats are spread before they are stacked. Each pattern's flow is then taken from its documents:
whole passes over all of them, and for the rest a seeded choice, exact to the word: documents in the order of a seeded
hash, the last one in part.

Scale: the network has one node for each pattern and source, never one per document. Sources and their quotas are a table of
Spark, however many there are; the common share is found by a few aggregations, of which only sums come to the driver. The
network falls into components of sources that share documents, and each is solved on its own, in tasks: a source that shares
none is a component of one pattern. Only a component, of at most MOST_PATTERNS patterns (checked), must fit in a task. The seeded choice
needs no sort of a source: sums by hash prefix (16**3 prefixes, twice) find the prefix in which the choice ends, and only that
prefix's documents are ordered. Hot sources therefore stay spread over all tasks.

Defined results: a null text or a text without words has size 0 and takes 0; a null source is a source of its own and
comes last; repeated rows (same id and text) are taken alike, each of them in part where the choice ends among them, so
up to as many words as there are such rows can be missing from a target; very long texts count whole and are taken in part
where the choice ends in them; an empty table gives an empty result; other columns stay, whatever their names, and a
column already named like the output is replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, put_back, set_aside, text_of, words_of, written
from .components import components

MOST_PATTERNS = 100_000
MAX_REPEATS = 3


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def targets(sizes: list[int], weights: list[int], total: int, most: int = MAX_REPEATS) -> list[float]:
    """Shares of total by weight; none above `most` times its size, what is above being shared again by weight."""
    out = [0.0] * len(sizes)
    capped: set[int] = set()
    while len(capped) < len(sizes):
        rest = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        share = {i: rest * weights[i] / weight for i in range(len(sizes)) if i not in capped}
        over = {i for i, x in share.items() if x > most * sizes[i]}
        for i, x in share.items():
            out[i] = x
        if not over:
            break
        capped |= over
        for i in capped:
            out[i] = float(most * sizes[i])
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], most: int = MAX_REPEATS) -> list[int]:
    """Words to take from each pattern so that quotas are met as far as the patterns allow, at least cost, when every further
    pass over a pattern costs more a word. Successive shortest augmenting paths over patterns and sources, in bulk."""
    n, m = len(capacity), len(quota)
    s, t = n + m, n + m + 1
    to: list[int] = []  # arc i ^ 1 is the reverse of arc i
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, cap: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((cap, 0))

    for p in range(n):
        arc(s, p, 0)
    for p in range(n):
        for q in members[p]:
            arc(p, n + q, sum(quota) + 1)
    for q in range(m):
        arc(n + q, t, quota[q])
    for _ in range(most):  # a path's cost is that of its first arc, so the passes are opened one by one
        for p in range(n):
            room[2 * p] += capacity[p]
        while _augmented(s, t, out, to, room):
            pass
    return [room[2 * p + 1] for p in range(n)]


def _augmented(s: int, t: int, out: list[list[int]], to: list[int], room: list[int]) -> bool:
    """One phase of Dinic's algorithm: flow along shortest paths until they are blocked; False if there is no path."""
    level = {s: 0}
    queue = deque([s])
    while queue:
        a = queue.popleft()
        for e in out[a]:
            if room[e] and to[e] not in level:
                level[to[e]] = level[a] + 1
                queue.append(to[e])
    if t not in level:
        return False
    tried = dict.fromkeys(level, 0)
    path: list[int] = []
    at = s
    while True:
        if at == t:
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
            full = next(k for k, e in enumerate(path) if not room[e])
            at = to[path[full] ^ 1]
            del path[full:]
        elif tried[at] == len(out[at]):
            if not path:
                return True
            at = to[path.pop() ^ 1]
            tried[at] += 1
        else:
            e = out[at][tried[at]]
            if room[e] and level.get(to[e], -1) == level[at] + 1:
                path.append(e)
                at = to[e]
            else:
                tried[at] += 1


def mix(df: DataFrame, sources: Column, text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), seed: int = 1, most: int = MAX_REPEATS, out: str = "mix") -> DataFrame:
    """df with column `out`: struct(size, source_size, target, taken), in words.

    sources: array<string> of the sources of a row (null entries are allowed). source_size and target are those of the
    row's first source; sources weigh as `weights`, repeated in the order of the sources.
    """
    df, named = set_aside(df, "_m_")
    key, text, keep = named[key], named[text], [c for c in df.columns if c != out]
    ordered = F.concat(F.array_sort(F.array_distinct(F.filter(sources, lambda x: x.isNotNull()))), F.filter(F.array_distinct(sources), lambda x: x.isNull()))
    order_key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))
    work = df.select(*[F.col(f"`{c}`") for c in keep], ordered.alias("_m_pattern"), order_key.alias("_m_key"), size_of(F.col(f"`{text}`")).alias("_m_size"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("_m_tie"))
    slim = written(work.select("_m_pattern", "_m_key", "_m_size", "_m_tie"), "mix")
    first = written(slim.groupBy("_m_pattern", F.substring("_m_key", 1, 3).alias("h")).agg(F.sum("_m_size").alias("size")), "prefixes")
    patterns = written(first.groupBy("_m_pattern").agg(F.sum("size").alias("size")), "patterns")
    flows = _flows(patterns, weights, most)
    # One row for each pattern: passes, words left over, and where the seeded choice of those ends.
    some = F.col("size") > 0
    plan = flows.select("_m_pattern", F.when(some, F.floor(F.col("flow") / F.col("size"))).otherwise(0).alias("_m_passes"), F.when(some, F.col("flow") % F.col("size")).otherwise(0).alias("_m_rest"), F.col("source_size").alias("_m_ssize"), F.col("target").alias("_m_target"))
    plan = written(plan, "plan")
    cut = _cut(slim, first, plan)
    plan = written(plan.join(cut, "_m_pattern", "left"), "plan")
    done = joined(work, plan, ["_m_pattern"], "left")
    at = F.struct("_m_key", "_m_tie", "_m_size")
    extra = F.when(F.coalesce(F.col("_m_rest"), F.lit(0)) == 0, 0).when(at < F.col("_m_at"), F.col("_m_size")).when(at == F.col("_m_at"), F.col("_m_part")).otherwise(0)
    told = done.select(
        *[F.col(f"`{c}`") for c in keep],
        F.struct(
            F.col("_m_size").alias("size"),
            F.coalesce("_m_ssize", F.lit(0)).cast("bigint").alias("source_size"),
            F.coalesce("_m_target", F.lit(0.0)).alias("target"),
            (F.coalesce("_m_passes", F.lit(0)) * F.col("_m_size") + extra).cast("bigint").alias("taken"),
        ).alias(out),
    )
    return put_back(told, named)


def _shares(sources: DataFrame, total: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """Sources (source, size) with `target` and a number `sid`, as a written table.

    Sources at `most` times their size leave the rest of the words to the others; the set of such sources only grows, so a few
    sums over the table of sources settle the common share."""
    # The place of each source in code point order: places in its range of sources, after those of the ranges before.
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = written(ranged.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))), "sources")
    ends = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before = dict(zip(sorted(ends), accumulate((ends[p] for p in sorted(ends)), initial=0)))
    first = F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))]) if before else F.create_map(F.lit(0), F.lit(0))
    place = (F.element_at(first, F.col("part")) + F.col("row") - 1).cast("bigint")
    weight = F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), (place % len(weights)).cast("int"))
    told = written(ranged.select("source", "size", place.alias("sid"), weight.alias("w")), "sources")
    rest, weight = total, told.agg(F.sum("w")).first()[0] or 1
    while True:
        share = F.lit(rest).cast("bigint") * F.col("w") / F.lit(weight).cast("bigint")
        full = share > most * F.col("size")
        capped = told.agg(F.sum(F.when(full, most * F.col("size"))).alias("words"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        now = (total - (capped["words"] or 0), capped["w"] or 0)
        if not now[1] or now == (rest, weight):
            break
        rest, weight = now
    return told.select("source", "size", "sid", F.when(full, (most * F.col("size")).cast("double")).otherwise(share).alias("target"))


def _flows(patterns: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(_m_pattern, size, source_size, target, flow): the flow out of each pattern, its first source's size and target."""
    total = patterns.agg(F.sum("size")).first()[0] or 0
    own = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit("")).alias("name"))
    members = patterns.select("_m_pattern", F.col("size").alias("capacity"), F.posexplode_outer("_m_pattern").alias("i", "source"))
    there = members.filter("i IS NOT NULL")
    shares = _shares(there.groupBy("source").agg(F.sum("capacity").alias("size")), total, weights, most)
    known = shares.select(own("source").alias("k"), "size", "sid", "target", F.floor(F.col("target") + 0.5).cast("bigint").alias("quota"))
    edges = there.withColumn("k", own("source")).join(known, "k")
    arcs = edges.groupBy("_m_pattern", "capacity").agg(F.array_sort(F.collect_list(F.struct("i", "sid", "quota", "size", "target"))).alias("a"))  # sources of a document
    arcs = written(arcs.select("_m_pattern", "capacity", F.transform("a", lambda x: x["sid"]).alias("sids"), F.transform("a", lambda x: x["quota"]).alias("quotas"), F.get("a", F.lit(0))["size"].alias("source_size"), F.get("a", F.lit(0))["target"].alias("target")), "arcs")
    first = F.get("sids", F.lit(0))
    shared = arcs.filter(F.size("sids") > 1)
    if shared.limit(1).count():
        ties = shared.select(first.alias("a"), F.explode("sids").alias("b")).filter("a <> b")
        comp = components(ties).select(F.col("node").alias("sid"), "comp")
        arcs = arcs.withColumn("sid", first).join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")).drop("sid")
        arcs = arcs.repartition("comp").sortWithinPartitions("comp", "sids")
    else:
        arcs = arcs.withColumn("comp", first)
    fields = "_m_pattern array<string>, size long, source_size long, target double, flow long"
    solved = arcs.select("comp", "_m_pattern", "capacity", "sids", "quotas", "source_size", "target").mapInPandas(lambda batches: _solved(batches, most), fields)
    nowhere = members.filter("i IS NULL").select("_m_pattern", F.col("capacity").alias("size"), F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("flow"))
    return written(solved.unionByName(nowhere), "flows")


def _solved(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Components, whose patterns follow one another, to flows."""

    names = ["_m_pattern", "size", "source_size", "target", "flow"]

    def one(rows: list) -> list[tuple]:
        if len(rows) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} patterns of sources that share documents")
        quota = {q: n for r in rows for q, n in zip(r.sids, r.quotas)}
        number = {q: i for i, q in enumerate(sorted(quota))}
        flow = min_cost_flow([int(r.capacity) for r in rows], [[number[q] for q in r.sids] for r in rows], [int(quota[q]) for q in sorted(quota)], most)
        return [(r.pattern, r.capacity, r.source_size, r.target, f) for r, f in zip(rows, flow)]

    held: list = []
    for b in batches:
        out: list[tuple] = []
        for r in b.rename(columns={"_m_pattern": "pattern"}).itertuples(index=False):
            if held and r.comp != held[0].comp:
                out += one(held)
                held = []
            held.append(r)
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(one(held) if held else [], columns=names)


def _cut(slim: DataFrame, first: DataFrame, plan: DataFrame) -> DataFrame:
    """(pattern, at, part): the seeded choice takes documents below `at` whole and `part` words of those at it."""
    wanted = plan.filter("_m_rest > 0").select("_m_pattern", F.col("_m_rest").alias("rest"))

    def ends(sums: DataFrame, by: str, left: DataFrame) -> DataFrame:
        """Of each pattern, the prefix in which its words end, and how many of them are left there."""
        both = joined(sums, left, ["_m_pattern"])
        total = F.sum("size").over(_upto("_m_pattern", by))
        both = both.withColumn("upto", total).filter("upto >= rest AND upto - size < rest")
        return both.select("_m_pattern", by, (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))

    wanted = written(wanted, "wanted")
    one = written(ends(first, "h", wanted), "ends")
    deeper = joined(slim.withColumn("h", F.substring("_m_key", 1, 3)), one.drop("rest"), ["_m_pattern", "h"]).withColumn("h2", F.substring("_m_key", 4, 3))
    second = deeper.groupBy("_m_pattern", "h2").agg(F.sum("_m_size").alias("size"))
    two = written(ends(second, "h2", one.select("_m_pattern", "rest")), "ends")
    last = joined(deeper, two, ["_m_pattern", "h2"])
    ties = last.groupBy("_m_pattern", "rest", F.struct("_m_key", "_m_tie", "_m_size").alias("_m_at")).agg(F.sum("_m_size").alias("size"), F.count("*").alias("n"))
    total = F.sum("size").over(_upto("_m_pattern", "_m_at"))
    end = ties.withColumn("upto", total).filter("upto >= rest AND upto - size < rest")
    return end.select("_m_pattern", "_m_at", F.floor((F.col("rest") - F.col("upto") + F.col("size")) / F.col("n")).alias("_m_part"))


def _upto(part: str, order: str):
    return Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def take(mixed: DataFrame, text: str = "text", out: str = "mix") -> DataFrame:
    """The documents of the mix: one row for each whole pass over a document, and one with its first words where a pass
    takes it in part (words joined by single spaces). Column `out` goes."""
    size, taken = F.col(out)["size"], F.col(out)["taken"]
    passes = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), passes), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn("_m_n", F.explode(copies))
    cut = F.array_join(F.slice(words_of(F.col(f"`{text}`")), 1, F.greatest(F.col("_m_n"), F.lit(1))), " ")
    return rows.withColumn(text, F.when(F.col("_m_n") > 0, cut).otherwise(F.col(f"`{text}`"))).drop(out, "_m_n")
