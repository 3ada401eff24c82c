"""Document fingerprints: MinHash signatures of word shingles, likeness of texts by them, and near copies by their bands.

A text's shingles (runs of `width` words, A-Z lower-cased) are hashed to 64 bits; PERMUTATIONS universal hashes a * x + b
modulo 2^32, a odd, each permute the upper halves, and the signature keeps the least value of each, sixteen bits of it.
Many texts are taken at once: one multiplication, one addition and one minimum by text over a block of shingles for each
permutation. The share of equal components estimates the Jaccard similarity of two texts.

`with_neighbour` deals rows to ranges of the id, so that each text meets the one after it: ranges begin at rows found in a
small sample (SAMPLED a range, as a range sort does), the first row of a range is also sent to the range before it, and
the very first to the last one. Texts are shuffled once and streamed in order; a task holds two texts and a block.

`near_copies` cuts signatures into BANDS bands of ROWS components, which are joined in Spark: rows of equal sets are
one, the others meet where a band is the same, and the sets of those that meet are compared exactly (`ngram_join`: with a band's
first member, then between families that are still apart, never all pairs). A pair of similarity 0.8 misses all bands once
in 20,000 times.

Defined results: a null or empty text has no shingle, the fingerprint of all ones, and likeness 1 with another such text, 0
with others; a text of fewer words than a shingle is one shingle; ids are ordered with nulls first, rows of the same id by
their text's hash; repeated rows follow one another; a single row is its own neighbour; very long texts take memory in
proportion to their length in one task; an empty table gives an empty result; other columns are not carried, so
their names do not matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join, word_batch
from .common import text_of, written

PERMUTATIONS, BANDS, ROWS = 256, 25, 5
BLOCK_BYTES = 256 << 10
SAMPLED, RANGE_ROWS = 64, 20_000
_RNG = np.random.default_rng(13)
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all texts' shingles in order, where each text's begin and end)."""
    words = word_batch.split(texts, word_batch.NOT_WHITE)
    h = word_batch.xxh64(words.buf, words.start, words.size)
    n = np.diff(words.first)
    runs = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    upto = np.r_[0, np.cumsum(runs)]
    text = np.repeat(np.arange(len(n)), runs)
    at = np.arange(upto[-1]) - upto[text] + words.first[text]
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        there = at + k < words.first[text + 1]
        out[there] = _mixed(out[there] * word_batch.P1 + h[at[there] + k])
    return out, upto


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * word_batch.P2
    x = (x ^ (x >> np.uint64(29))) * word_batch.P3
    return x ^ (x >> np.uint64(32))


def signatures(hashes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A row of PERMUTATIONS 16-bit numbers for each text."""
    out = np.full((len(upto) - 1, PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    some = np.flatnonzero(np.diff(upto))
    if len(some):
        x, starts = (hashes >> np.uint64(32)).astype(np.uint32), upto[some]
        v = np.empty_like(x)
        for j in range(PERMUTATIONS):
            np.multiply(x, _A[j], out=v)
            np.add(v, _B[j], out=v)
            out[some, j] = np.minimum.reduceat(v, starts).astype(np.uint16)
    return out


def signed(texts: list[str | None], width: int = 5) -> np.ndarray:
    """Signatures of texts, block by block."""
    out, lo, size = [np.empty((0, PERMUTATIONS), dtype=np.uint16)], 0, 0
    for hi, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= BLOCK_BYTES or hi == len(texts):
            out.append(signatures(*shingles(texts[lo:hi], width)))
            lo, size = hi, 0
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


KEY = ["known", "id", "th"]  # orders null ids first


def _ranges(keys: DataFrame, ranges: int) -> list[tuple]:
    """The keys of rows that begin ranges of about equal size, the least of all first: at least `ranges`, and more of RANGE_ROWS rows
    for a large table. About SAMPLED rows a range come to the driver."""
    n, first = keys.agg(F.count("*"), F.min(F.struct(*KEY))).first()
    if not n:
        return []
    ranges = max(ranges, n // RANGE_ROWS)
    sample = sorted({tuple(r) for r in keys.sample(min(1.0, SAMPLED * ranges / n), seed=13).collect()})
    return sorted({tuple(first), *sample[:: max(1, min(SAMPLED, n // ranges))]})


def with_neighbour(df: DataFrame, schema: str, each, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """The key, and columns of `schema` that `each(texts, texts after)` makes of blocks of df's rows in the order of the key, each
    with the text of the row after it; after the last comes the first."""
    spark = df.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own_id = F.col(f"`{key}`").cast("bigint")
    slim = df.select(own_id.isNotNull().alias("known"), F.coalesce(own_id, F.lit(0)).alias("id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("th"), F.col(f"`{text}`").cast("string").alias("t"))
    begins = _ranges(slim.select(KEY), ranges)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = list(zip(*(b[c] for c in KEY)))
            own = np.array([bisect_right(begins, k) - 1 for k in keys], dtype=np.int64)
            heads = np.array([begins[o] == k for o, k in zip(own, keys)], dtype=bool)
            b = b.assign(part=own, last=False)
            yield pd.concat([b, b[heads].assign(part=(own[heads] - 1) % len(begins), last=True)])

    parts = slim.mapInPandas(dealt, "known boolean, id long, th long, t string, part int, last boolean")
    stream = parts.repartitionById(max(ranges, len(begins)), F.col("part")).sortWithinPartitions("part", "last", *KEY)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row whose next one has not come yet
        for b in word_batch.chunks(batches, "t"):
            b = b if held is None else pd.concat([held, b])
            after = b["t"].shift(-1)
            own = ~b["last"].to_numpy(dtype=bool)
            own[-1] = False
            made = each(["" if t is None else t for t in b["t"][own]], ["" if t is None else t for t in after[own]])
            yield made.assign(known=b["known"][own].to_numpy(), id=b["id"][own].to_numpy())
            held = b.iloc[-1:]

    found = stream.mapInPandas(follow, f"known boolean, id long, {schema}")
    return found.select(F.when(F.col("known"), F.col("id")).cast(dict(df.dtypes)[key]).alias(key), *found.columns[2:])


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of df: its fingerprint,
    that of its edited text, and the likeness of its fingerprint to that one and to the next row's."""

    def each(texts: list[str], after: list[str]) -> pd.DataFrame:
        changed = [edited(a, b) for a, b in zip(texts, after)]
        # A block's rows follow one another, so all but the last one's neighbour is among them.
        runs = [k for k in range(len(texts)) if k + 1 == len(texts) or texts[k + 1] is not after[k]]
        own, other = signed(texts, width), signed(changed, width)
        following = np.roll(own, -1, axis=0)
        following[runs] = signed([after[k] for k in runs], width)
        hexed = lambda s: [r.tobytes().hex() for r in s.astype(">u2")]
        return pd.DataFrame({"n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                             "fingerprint": hexed(own), "edited_fingerprint": hexed(other), "near_edited": likeness(own, other), "near_next": likeness(own, following)})

    return with_neighbour(df, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", each, key, text)


def band_cells(signature: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band of each signature."""
    out = np.empty((len(signature), BANDS), dtype=np.uint64)
    for k in range(BANDS):
        h = np.full(len(signature), np.uint64(k + 1))
        for c in signature[:, k * ROWS : (k + 1) * ROWS].T:
            h = _mixed(h * word_batch.P1 + c)
        out[:, k] = h
    return out.view(np.int64)


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id): for each row of df the smallest id reachable by links; linked are texts that share a band
    and whose sets reach a Jaccard similarity of num / den."""
    kind = dict(df.dtypes)[key]

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in word_batch.chunks(batches, "t", BLOCK_BYTES):
            b = part.drop(columns="t")
            h, upto = shingles(list(part["t"]), width)
            sets = [np.unique(h[x:y]) for x, y in zip(upto, upto[1:])]
            total = lambda s, salt: int(_mixed(s + np.uint64(salt)).sum(dtype=np.uint64).view(np.int64))
            b["n"] = [len(s) for s in sets]
            b["f1"], b["f2"] = [total(s, 1) for s in sets], [total(s, 2) for s in sets]
            b["pt"] = [ngram_join.stored(ngram_join.point(s)) for s in sets]
            b["cells"] = list(band_cells(signatures(h, upto)))
            yield b

    slim = df.select(F.col(f"`{key}`").alias("id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("th"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = slim.mapInPandas(points, f"id {kind}, th long, n long, f1 long, f2 long, pt binary, cells array<long>")
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "signatures")
    return ngram_join.classes(df, rows, key, text, width, num, den).select(F.col("id").alias(key), "n_shingles", "component_id")
