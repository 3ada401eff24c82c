"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

Vectors are rows of a sparse matrix of integer weights; a component is a term. Both sides are dealt into blocks. For each
pair of a query block and a candidate block, every term's postings (candidates with a weight there) are scattered into
the dense score arrays of the queries that hold the term. A block pair hands on its k best for each query (partition
selection), and those are merged. Nothing is skipped or approximated, and no side is broadcast: a query block is dealt
out under several numbers (salts), and a candidate block meets every query block under one of them, so that a query block's
work is spread over tasks, and memory per task is one block of each and one array of scores.

Work is queries x candidates by definition of an exhaustive search; if the queries are a share of the rows it grows with
the square of the table.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; a vector shorter than
others counts as zero beyond its end; the score of two ids is the best of their vectors where an id has several, so
repeated rows do not change the result; ties go to the smaller id; a null id takes no part; fewer than k candidates give
all; an empty table gives an empty result; other columns take no part. Scores must fit a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096
BLOCK_SCHEMA = "n int, dims int, ids binary, w binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as bigint; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~odd, whole)


def _packed_blocks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    n = 0

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        dims = max(len(v) for v in b["w"])
        w = np.zeros((dims, len(b)), dtype=np.int64)
        for i, v in enumerate(b["w"]):
            w[: len(v), i] = v
        return pd.DataFrame({"n": [len(b)], "dims": [dims], "ids": [b["id"].to_numpy(dtype=np.int64).tobytes()], "w": [w.tobytes()]})

    for b in batches:
        held.append(b)
        n += len(b)
        while n >= rows:
            whole = pd.concat(held)
            yield packed(whole.iloc[:rows])
            held, n = [whole.iloc[rows:]], n - rows
    if n:
        yield packed(pd.concat(held))


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """Rows of (id, w array<bigint>) gathered into blocks: (n, dims, ids binary, w binary), ids ascending in a block."""
    return df.mapInPandas(lambda batches: _packed_blocks(batches, rows), BLOCK_SCHEMA)


def _accumulate(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """Scores of a query block (terms x queries) against a candidate block (terms x candidates), k best for each query."""
    small = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(c).max(initial=0)), 1) * max(len(q), 1) < 2**31
    kind = np.int32 if small else np.int64
    q, c = q.astype(kind), c.astype(kind)
    scores = np.zeros((len(q_ids), len(c_ids)), dtype=kind)
    buffer = np.empty_like(scores)
    for term in range(min(len(q), len(c))):
        holders, postings = np.flatnonzero(q[term]), np.flatnonzero(c[term])
        if not len(holders) or not len(postings):
            continue
        if len(holders) == len(q_ids) and len(postings) == len(c_ids):  # every row holds the term: no scatter needed
            np.multiply(q[term][:, None], c[term][None, :], out=buffer)
            scores += buffer
        else:
            scores[np.ix_(holders, postings)] += q[term][holders, None] * c[term][None, postings]
    starts = np.flatnonzero(np.r_[True, c_ids[1:] != c_ids[:-1]])
    if len(starts) < len(c_ids):  # an id with several vectors counts with its best
        scores, c_ids = np.maximum.reduceat(scores, starts, axis=1), c_ids[starts]
    out_q, out_c, out_s = [], [], []
    for row, own in zip(scores, q_ids):
        n = len(row)
        if n > k + 1:
            least = np.partition(row, n - k - 1)[n - k - 1]  # the (k + 1)-th best: its own row may be among them
            at = np.flatnonzero(row >= least)
        else:
            at = np.arange(n)
        at = at[c_ids[at] != own]
        at = at[np.lexsort((c_ids[at], -row[at].astype(np.int64)))][:k]
        out_q.append(np.full(len(at), own))
        out_c.append(c_ids[at])
        out_s.append(row[at].astype(np.int64))
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_c), "score": np.concatenate(out_s)})


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, the query's own id aside.

    Both inputs are (id bigint, w array<bigint>)."""
    spark = queries.sparkSession
    queries, candidates = (x.select("id", "w").filter("id IS NOT NULL AND w IS NOT NULL") for x in (queries, candidates))
    queries = queries.distinct()
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = -(-n_queries // query_block)
    salts = max(1, -(-2 * spark.sparkContext.defaultParallelism // n_blocks))  # some tasks for each query block
    tasks = n_blocks * salts
    one = lambda _, pdf: next(_packed_blocks(iter([pdf]), len(pdf))).assign(qb=int(pdf["qb"].iloc[0]))
    dealt = queries.select("id", "w", F.pmod(F.xxhash64("id", "w"), F.lit(n_blocks)).cast("int").alias("qb"))
    q_blocks = dealt.groupBy("qb").applyInPandas(one, f"{BLOCK_SCHEMA}, qb int")
    q_blocks = q_blocks.select("n", F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("w").alias("q_w"), "qb", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    c_blocks = _blocks(candidates, candidate_block).select(F.col("n").alias("c_n"), "dims", "ids", "w", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"))
    c_blocks = c_blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = c_blocks.repartition(tasks, "qb", "salt").join(q_blocks.repartition(tasks, "qb", "salt").hint("merge"), ["qb", "salt"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q = np.frombuffer(r.q_w, dtype=np.int64).reshape(r.q_dims, r.n)
                c = np.frombuffer(r.w, dtype=np.int64).reshape(r.dims, r.c_n)
                yield _accumulate(np.frombuffer(r.q_ids, dtype=np.int64), q, np.frombuffer(r.ids, dtype=np.int64), c, k)

    found = pairs.mapInPandas(score, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
