"""N-gram Jaccard join: components of documents whose shingle sets reach a Jaccard similarity, exactly.

Shingles are hashed and dealt into groups; the counts per group are a document's point. Two points bound the overlap of
their sets by the sum of their coordinates' minima, and R-trees over the points (nodes keep the coordinates' maxima)
find the pairs whose bound reaches the threshold; those are verified on the sets.

How the index is spread: sets of sizes a and b at the threshold differ in at most D = (a + b) * (1 - t) / (1 + t)
shingles, and every such shingle changes one group. So of the first D + 1 non-empty groups of either set, one at least is
the same in both, not only in count but in content. Documents are therefore dealt to cells (size class, group, content of
the group) for those groups, and only documents that meet in a cell can be linked. Within a cell documents are compared
with its first one first (a star, not all pairs): points by the bound, then sets where the bound allows it. Members of
large families of copies are linked so. Cells in which that leaves several families are gone through again, one of each
set of members: R-trees over blocks of BLOCK members find the links that are left, where members of the cell's largest
family only serve as points and pairs of one family are skipped. No link between different components is lost, and no
cap is set.

Hashes of shingles have 64 bits and fingerprints of sets 128; equal hashes count as equal shingles.

Defined results: a text of fewer words than a shingle counts as one shingle; an empty or null text has size 0 and is
alone; a null id never is a component's id while the component has another; repeated rows and equal sets are linked;
an empty table gives an empty result; very long texts take
memory in proportion to their length in one task. Sizes from MANY_GROUPS_BELOW shingles down have one group for each shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, narrowed, put_back, remove, set_aside, sized, text_of, written
from .components import components, merged

BLOCK, BLOCK_SIZE = 1024, 1024
PAIRS_EACH = 512
MANY_GROUPS_BELOW = 16
LEAST_DIMS, MOST_DIMS = 64, 1 << 16
LEAF = 16
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over all their bytes."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    buf = np.frombuffer(b" ".join(words), dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.r_[0, np.cumsum(size[:-1] + 1)]
    total = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(buf)))]
    h = (total[start + size] - total[start]) * _powers(_B_INVERSE, len(buf))[start]
    return _mix(h, 1) + _mix(size.astype(np.uint64), 2)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out * _B + h[k : k + n], 3 + k)
    return np.unique(out)


@lru_cache(maxsize=None)
def size_classes(limit: int = 1 << 40) -> np.ndarray:
    """First size of each class; sizes grow by half from class to class."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, dtype=np.int64)


def most_apart(a: int, b: int, num: int, den: int) -> int:
    """Shingles in which two sets of these sizes can differ while num / den is reached."""
    return (a + b) * (den - num) // (den + num)


def cells(h: np.ndarray, num: int, den: int, scale: int = 1) -> tuple[np.ndarray, bool]:
    """Cells of a sorted set, and whether its groups are too few for them to be sure to meet every partner."""
    n = len(h)
    if not n:
        return np.empty(0, dtype=np.uint64), False
    first = size_classes()
    largest = n * den // num
    out, weak = [], False
    for c in range(int(np.searchsorted(first, n, "right")) - 1, int(np.searchsorted(first, largest, "right"))):
        top = int(first[c + 1]) - 1
        need = most_apart(n, min(top, largest), num, den) + 1
        if top < MANY_GROUPS_BELOW:
            group, sums = h[:need], h[:need]
        else:
            groups = int(np.ceil((most_apart(top, top, num, den) * 1.05 + 0.5 * top**0.5 + 3) * scale))
            of = ((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            weak |= len(start) < need and len(start) < n
            end = int(start[need]) if need < len(start) else n
            start = start[:need]
            group, sums = of[start], np.add.reduceat(_mix(h[:end], 7), start)
        out.append(_mix(_mix(group, 11 + c) + sums, 13 + c))
    return np.concatenate(out), weak


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _points(df: DataFrame, key: str, text: str, width: int, num: int, den: int, scale: int) -> DataFrame:
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b.pop("t"):
                h = shingle_set(t, width)
                own, weak = cells(h, num, den, scale)
                a, c = _mix(h, 17).sum(dtype=np.uint64), _mix(h, 19).sum(dtype=np.uint64)
                rows.append((len(h), int(a.view(np.int64)), int(c.view(np.int64)), weak, stored(point(h)), _signed(own)))
            names = ["n", "f1", "f2", "weak", "pt", "cells"]
            b[names] = pd.DataFrame(rows, columns=names, index=b.index)
            yield b

    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(f"`{key}`").alias("id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("th"), F.col(f"`{text}`").cast("string").alias("t"))
    return slim.mapInPandas(hashed, f"id {kind}, th long, n long, f1 long, f2 long, weak boolean, pt binary, cells array<long>")


class PointTree:
    """R-tree over count vectors, packed by size: a node keeps its points' coordinate maxima and smallest size."""

    def __init__(self, points: np.ndarray, num: int, den: int) -> None:
        self.num, self.den = num, den
        sizes = points.sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((*points.T[:4], sizes))
        self.levels = [(points[self.order].astype(np.int32, copy=False), sizes[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            p, s = self.levels[-1]
            at = np.arange(0, len(s), LEAF)
            self.levels.append((np.maximum.reduceat(p, at, axis=0), np.minimum.reduceat(s, at)))

    def near(self, q: np.ndarray) -> np.ndarray:
        """Points whose summed minima with q allow the threshold."""
        size = int(q.sum())
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, s = self.levels[depth]
            bound = np.minimum(p[at], q).sum(axis=1)
            at = at[(self.num + self.den) * bound >= self.num * (size + s[at])]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def point(h: np.ndarray) -> np.ndarray:
    """Counts by the leading bits of the hashes; one shingle in one or two groups, so that the bound stays tight for any size."""
    bits = int(np.clip(2 * len(h), LEAST_DIMS, MOST_DIMS)).bit_length() - 1
    return np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def folded(p: np.ndarray, dims: int) -> np.ndarray:
    """The point of the same set with fewer groups: each is a run of the old ones."""
    return p if len(p) == dims else p.reshape(dims, -1).sum(axis=1)


def bound(x: np.ndarray, y: np.ndarray) -> int:
    """Most shingles that two sets can share."""
    dims = min(len(x), len(y))
    return int(np.minimum(folded(x, dims), folded(y, dims)).sum())


def stored(p: np.ndarray) -> bytes:
    """A point in as few bytes as its largest coordinate allows, after a byte that tells how many."""
    small = p.max(initial=0) < 256
    return bytes([1 if small else 4]) + p.astype(np.uint8 if small else np.uint32).tobytes()


def loaded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8 if raw[0] == 1 else np.uint32, offset=1).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _bounded(num: int, den: int):
    """Pairs (a, b) with whether their points allow the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = []
            for x, y in zip(b["x"], b["y"]):
                x, y = loaded(x), loaded(y)
                near.append((num + den) * bound(x, y) >= num * int(x.sum() + y.sum()))
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "near": near})

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), num, den) for x, y in zip(b["x"], b["y"])]
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "good": good})

    return run


def _join_block(num: int, den: int, most: int):
    """For each query of a block, tree points of other families whose bound allows the threshold, `most` at once, largest
    bounds first; `cut` tells that there are more."""

    def run(members: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"cell": [], "a": [], "b": [], "cut": []}
        raw_of = dict(zip(held["node"], held["pt"]))
        members = members.sort_values(["cell", "tb", "qb", "asks"])  # of each pair of blocks, the tree's members first
        key, asks = members[["cell", "tb", "qb"]].to_numpy(), members["asks"].to_numpy()
        nodes, comps = members["node"].to_numpy(), members["comp"].to_numpy()
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        for lo, hi in zip(start, np.r_[start[1:], len(key)]):
            mid = hi - int(asks[lo:hi].sum())
            if mid in (lo, hi):
                continue
            points, queries = [loaded(raw_of[x]) for x in nodes[lo:mid]], [loaded(raw_of[x]) for x in nodes[mid:hi]]
            dims = min(map(len, points + queries))
            points = np.stack([folded(p, dims).astype(np.int32) for p in points])
            index, family, node = PointTree(points, num, den), comps[lo:mid], nodes[lo:mid]
            for own, comp, q in zip(nodes[mid:hi], comps[mid:hi], queries):
                q = folded(q, dims)
                at = index.near(q)
                at = at[family[at] != comp]
                share = np.minimum(points[at], q).sum(axis=1) / (points[at].sum(axis=1) + q.sum())
                first = at[np.lexsort((node[at], -share))][:most]
                out["cell"].append(np.full(len(first), key[lo, 0]))
                out["a"].append(np.full(len(first), own))
                out["b"].append(node[first])
                out["cut"].append(np.full(len(first), len(at) > most))
        none = [np.empty(0, dtype=np.int64)]
        return pd.DataFrame({c: np.concatenate(v or none) for c, v in out.items()}).astype({"cut": bool})

    return run


def _sets(df: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, h binary): the sets of the wanted nodes (node, row), a written table, from the text of one row of each."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "h": [shingle_set(t, width).tobytes() for t in b["t"]]})

    rows = df.select(F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("th")).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))
    one = joined(rows, wanted, ["row"]).select("node", "t").dropDuplicates(["node"])
    return written(sized(one, wanted.count(), PAIRS_EACH).mapInPandas(hashed, "node long, h binary"), "sets")


def _judged(pairs: DataFrame, sets: list[DataFrame], num: int, den: int) -> DataFrame:
    """(a, b), written: those of a written table of pairs of nodes whose sets, in written tables, are linked. Sets of other nodes
    are not shuffled."""
    ends = written(_ends(pairs), "ends")
    own = narrowed(reduce(DataFrame.unionByName, sets), ends, ["node"]) if sets else pairs.sparkSession.createDataFrame([], "node long, h binary")
    x, y = own.select(F.col("node").alias("a"), F.col("h").alias("x")), own.select(F.col("node").alias("b"), F.col("h").alias("y"))
    judged = sized(pairs.select("a", "b").join(y, "b").join(x, "a"), pairs.count(), PAIRS_EACH, *sets).mapInPandas(_verify(num, den), "a long, b long, good boolean")
    out = written(judged.filter("good").select("a", "b"), "links")
    remove(ends)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def join(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, th, n_shingles, component_id, keeper): one row for each row of df; linked where den * |A and B| >= num * |A or B|.

    th is xxhash64 of the text; keeper is the (id, th) of the component's first row.
    """
    scale = 1
    while True:
        rows = written(_points(df, key, text, width, num, den, scale).withColumn("uid", F.monotonically_increasing_id()), "points")
        if not rows.filter("weak").limit(1).count():
            break
        remove(rows)
        scale *= 2  # some set fills too few groups for the cells to be sure: deal all into more
    return classes(df, rows, key, text, width, num, den)


def classes(df: DataFrame, rows: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """What `join` returns, from a written table (uid, id, th, n, f1, f2, pt, cells) of the rows of df: those that meet in a cell
    are compared."""
    # Equal sets are one node, named by a row that has it: from here on, copies take no part.
    slim = rows.select("uid", "id", "th", "n", "f1", "f2").filter("n > 0")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    nodes = slim.groupBy("f1", "f2").agg(F.min("uid").alias("node"), F.min(order).alias("first"))
    nodes = written(nodes.select("node", "f1", "f2", F.struct("first.id", "first.th").alias("row")), "nodes")
    family = _families(df, key, text, width, rows.select(F.col("uid").alias("node"), "n", "cells", "pt"), nodes, num, den)

    # Each component's first row; nodes that met no other are their own.
    named = nodes.join(family, "node", "left").select("f1", "f2", "row", F.coalesce("comp", "node").alias("comp"))
    order = F.struct(F.col("row.id").isNull().alias("none"), F.col("row.id").alias("id"), F.col("row.th").alias("th"))
    heads = named.groupBy("comp").agg(F.min(order).alias("head"))
    told = named.join(heads, "comp").select("f1", "f2", "head")
    full = slim.join(told, ["f1", "f2"]).select("id", "th", F.col("n").alias("n_shingles"), F.col("head.id").alias("component_id"), F.struct("head.id", "head.th").alias("keeper"))
    empty = rows.filter("n = 0").select("id", "th", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.struct("id", "th").alias("keeper"))
    return full.unionByName(empty)


def _families(df: DataFrame, key: str, text: str, width: int, rows: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(node, comp), written: the nodes that are linked with others. rows are (node, n, cells, pt), of all rows."""
    met = narrowed(rows.select("node", "cells"), nodes.select("node"), ["node"]).select("node", F.explode("cells").alias("cell"))
    several = written(met.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell"), "several")
    here = written(met.join(several.hint("merge"), "cell", "left_semi"), "here")  # in proportion to the table: never broadcast
    # Cells of the same members are one.
    alike = here.groupBy("cell").agg(F.min("node").alias("a"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2"))
    chosen = written(alike.groupBy("a", "n", "s1", "s2").agg(F.min("cell").alias("cell")).select("cell", "a", "n"), "cells")
    spots = written(joined(here, chosen, ["cell"]), "spots")
    remove(several, here, chosen)
    # From here on only the points of those that met any other are read, and shuffled where they must be.
    wanted = written(spots.select("node").distinct(), "wanted")
    points = written(narrowed(rows.select("node", "n", "pt"), wanted, ["node"]), "met")
    sets: list[DataFrame] = []

    def judged(pairs: DataFrame) -> DataFrame:
        """`_judged`; the sets of nodes are made when a pair first asks for them, as points rule out most of those that met."""
        missing = _ends(pairs)
        for s in sets:
            missing = missing.join(s.select("node"), "node", "left_anti")
        missing = written(missing.join(nodes.select("node", "row"), "node"), "missing")
        if missing.limit(1).count():
            sets.append(_sets(df, key, text, width, missing))
        remove(missing)
        return _judged(pairs, sets, num, den)

    pairs = written(spots.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    x, y = points.select(F.col("node").alias("a"), F.col("pt").alias("x")), points.select(F.col("node").alias("b"), F.col("pt").alias("y"))
    both = sized(pairs.join(y, "b").join(x, "a"), pairs.count(), PAIRS_EACH, points)
    bounded = written(both.mapInPandas(_bounded(num, den), "a long, b long, near boolean"), "bounded")
    close = written(bounded.filter("near").select("a", "b"), "close")
    good = judged(close)
    family = written(components(good), "family")
    done = [bounded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))]
    remove(pairs, close, good)

    # Links between those that met in a cell but are not tied together by its star; of two members, the star has compared
    # all there is.
    used, spots_left, most = [spots, wanted, points, bounded], spots.filter("n > 2").select("cell", "node"), 1
    while True:
        now = spots_left.join(family, "node", "left").select("cell", "node", F.coalesce("comp", "node").alias("comp"))
        mixed = written(now.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("cell"), "mixed")
        now = written(narrowed(now, mixed, ["cell"]), "now")
        n = now.count()
        if not n:
            remove(mixed, now)
            break
        found = written(_near_in_blocks(now, points, num, den, most), "found")
        near = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for d in done:
            near = near.join(d, ["a", "b"], "left_anti")
        near = written(sized(near, n * most, PAIRS_EACH), "near")
        new = judged(near)
        if new.limit(1).count():
            last, family = family, written(merged(family, new), "family")
            remove(last)
        # Most queries are linked by now; those that are not, and had more points to try, try more of them.
        done.append(near)
        used.append(near)
        again = written(found.filter("cut").select("cell").distinct(), "again")
        used.append(again)
        remove(mixed, now, found, new)
        if not again.limit(1).count():
            break
        spots_left = narrowed(spots_left, again, ["cell"])
        most *= 8
    remove(*used, *sets)
    return family


def _near_in_blocks(spots: DataFrame, points: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """(cell, a, b, cut) for spots (cell, node, comp), a written table: R-trees over blocks of a cell's members. A cell's pairs of
    blocks are dealt out one by one, so that what a task holds does not grow with the cell."""
    # The points of a block take about BLOCK * BLOCK_SIZE numbers, fewer members for long texts.
    heavy = F.greatest(F.lit(1.0), F.col("size") / BLOCK_SIZE)
    sizes = spots.join(points.select("node", F.col("n").alias("size")), "node").groupBy("cell", "comp").agg(F.count("*").alias("n"), F.sum(heavy).alias("load"), F.min("node").alias("a"))
    largest = sizes.groupBy("cell").agg(F.max(F.struct("n", "comp", "load")).alias("top"), F.sum("n").alias("all"), F.sum("load").alias("load"), F.min("a").alias("a"))
    blocks = lambda x: F.ceil(x / BLOCK).cast("int")
    largest = largest.select("cell", "a", F.col("top.comp").alias("top"), "all", (F.col("all") - F.col("top.n")).alias("qs"), blocks(F.col("load")).alias("tbs"), blocks(F.greatest(F.lit(1.0), F.col("load") - F.col("top.load"))).alias("qbs"))
    largest = written(largest.withColumn("moved", F.col("all") * F.col("qbs") + F.col("qs") * F.col("tbs")), "blocks")
    moved = largest.agg(F.sum("moved")).first()[0]
    # Cells of one smallest member hold much the same members: they go to one bucket, or as many as their rows ask for, and a
    # bucket is given each point once.
    parts = largest.groupBy("a").agg(F.ceil(F.sum("moved") / BLOCK).alias("parts"))
    dealt = written(largest.join(parts, "a").select("cell", "a", "parts", "top", "tbs", "qbs"), "dealt")
    full = joined(spots, dealt, ["cell"])
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    part = F.pmod(F.xxhash64("cell", "tb", "qb"), F.col("parts"))
    bucket = F.pmod(F.xxhash64("a", part), F.lit(max(1, -(-moved // BLOCK))))
    q = full.filter("comp <> top").withColumn("qb", block("qbs", 1)).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tbs") - 1)))
    t = full.withColumn("tb", block("tbs", 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    side = lambda x, asks: x.select(bucket.alias("bucket"), "cell", "tb", "qb", "node", "comp", F.lit(asks).alias("asks"))
    members = side(q, True).unionByName(side(t, False))
    held = members.select("bucket", "node").distinct().join(points.select(F.col("node").alias("of"), "pt"), F.col("node") == F.col("of"))
    held = held.select(F.col("bucket").alias("to"), F.col("of").alias("node"), "pt")  # new names for either side
    found = members.groupBy("bucket").cogroup(held.groupBy("to")).applyInPandas(_join_block(num, den, most), "cell long, a long, b long, cut boolean")
    return sized(found, moved, BLOCK)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with one row of each component: that with the smallest id (rows with the same id and text are one)."""
    df, named = set_aside(df, "_n_")
    key, text = named[key], named[text]
    first = join(df, key, text, **how).select(F.col("keeper").alias("_n_row")).distinct()
    own = F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("th"))
    return put_back(df.withColumn("_n_row", own).join(first, "_n_row").dropDuplicates(["_n_row"]).drop("_n_row"), named)
