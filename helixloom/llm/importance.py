"""Target-distribution importance resampling: documents drawn in proportion to how much more likely the target makes them.

Features are runs of 1 to `width` words, hashed into buckets by crc32. Each batch interns its features in an open-addressed
table: 64-bit keys (xxhash64) find a slot by linear probing, the bytes are compared before a slot is shared, and a slot
holds the feature's bucket and its count. A slot's bucket is computed once, and every occurrence keeps the id of its slot,
through which it gathers the bucket's gain.

The corpus is read twice. The first pass counts buckets: a task hands on one row for each of its buckets, so a table of
at most `buckets` rows (a parameter) is summed and goes to the driver, for the corpus and for the target; the gains made
of it go back to the tasks. The second pass weighs documents. Scores add Gumbel noise from a hash of the id, so that the
highest scores are a draw without replacement; ranks are given by a range sort, with one count for each partition.

Defined results: a null or empty text has no features, weight 0, and is not drawn; a null id hashes as an empty one and
comes first among equal scores; repeated rows are counted, weighed and drawn one by one, ranks among equal rows in any order;
very long texts are read whole; an empty corpus gives an empty result, an empty target gains from zero counts; columns
other than the key and the text are not carried, so their names do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_batch
from .common import written

BUCKETS = 10_000
ROW_BITS = 33  # monotonically_increasing_id keeps the row within the partition there


def intern(buf: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each run of bytes, occurrence that owns each slot or -1): equal bytes share a slot, others never do."""
    n = len(start)
    mask = (1 << max(4, (2 * n).bit_length())) - 1  # at most half full
    key = word_batch.xxh64(buf, start, size) if key is None else key
    owner, slot = np.full(mask + 1, -1, dtype=np.int64), np.empty(n, dtype=np.int64)
    left, at = np.arange(n), (key & np.uint64(mask)).astype(np.int64)
    while len(left):
        free = owner[at] < 0
        owner[at[free]] = left[free]  # of several that want a free slot, one gets it
        own = owner[at]
        same = (key[own] == key[left]) & (size[own] == size[left])
        maybe = np.flatnonzero(same & (own != left))
        same[maybe] = word_batch.same_bytes(buf, start[own[maybe]], start[left[maybe]], size[left[maybe]])
        slot[left[same]] = at[same]
        left, at = left[~same], (at[~same] + 1) & mask
    return slot, owner


def bucketed(words: word_batch.Words, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot, text) of each occurrence of a feature, and (bucket, count) of each slot."""
    grams = [words.grams(n) for n in range(1, width + 1)]
    start, size, text = (np.concatenate(x) for x in zip(*grams))
    slot, owner = intern(words.buf, start, size)
    bucket, used = np.zeros(len(owner), dtype=np.int64), np.flatnonzero(owner >= 0)
    raw = words.buf.tobytes()
    at, end = start[owner[used]].tolist(), (start + size)[owner[used]].tolist()
    bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(at, end)]
    return slot, text, bucket, np.bincount(slot, minlength=len(owner))


def bucket_counts(df: DataFrame, text: str = "text", width: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """How often the features of each bucket stand in all of df; at most `buckets` entries."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in word_batch.chunks(batches, "t"):
            _, _, bucket, n = bucketed(word_batch.split(list(b["t"])), width, buckets)
            np.add.at(total, bucket, n)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "n": total[found]})

    found = df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInPandas(count, "bucket int, n long")
    return {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share in the target over that in the corpus, rounded down."""
    in_corpus, in_target = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1) * (in_corpus + buckets) / ((corpus.get(b, 0) + 1) * (in_target + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def weighed(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", width: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) for each row of df: weight is the sum of its features' gains."""
    kind = dict(df.dtypes)[key]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in word_batch.chunks(batches, "t"):
            words = word_batch.split(list(b["t"]))
            slot, at, bucket, _ = bucketed(words, width, len(gain))
            total = np.zeros(len(b), dtype=np.int64)
            np.add.at(total, at, gain[bucket][slot])
            n = np.bincount(at, minlength=len(b))
            yield pd.DataFrame({"id": b["id"], "n_words": np.diff(words.first), "n_features": n, "weight": total})

    slim = df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))  # pandas makes floats of ids where one is null
    return slim.mapInPandas(weigh, "id string, n_words long, n_features long, weight long").withColumn("id", F.col("id").cast(kind))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, as a written table, with `place` (from 0) in the given order: a range sort, and the number of rows of each
    partition, of which there are as many as shuffle partitions."""
    spot = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", spot), "ranked")
    part = F.shiftright("spot", ROW_BITS).cast("int")
    before, upto = {}, 0
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before[r["part"]] = upto
        upto += r["n"]
    if not before:
        return rows.withColumn("place", F.lit(0).cast("bigint")).drop("spot")
    starts = F.broadcast(df.sparkSession.createDataFrame(sorted(before.items()), "part int, base long"))
    within = F.col("spot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.withColumn("part", part).join(starts, "part").withColumn("place", F.col("base") + within).drop("part", "base", "spot")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", width: int = 1, buckets: int = BUCKETS,
             min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) for each row of df: `percent` of the rows of at least `min_words`
    words are drawn, and ranked by falling score; rank is null for the others."""
    gain = gains(bucket_counts(df, text, width, buckets), bucket_counts(target, target_text, width, buckets), buckets)
    scored = written(weighed(df, gain, key, text, width).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    most = able.count() * percent // 100
    placed = ranked(able, [F.desc("score"), F.asc_nulls_first("id"), F.asc("n_features")])
    drawn = placed.withColumn("rank", F.when(F.col("place") < most, F.col("place") + 1)).drop("place")
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).withColumnRenamed("id", key)
