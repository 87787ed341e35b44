"""Similarity search over embedded segments."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.signatures import dot

# Fixed values.
MIN_SCORE, TOP = 0.30, 5


def top_k(vectors: DataFrame, query: list[float], k: int = TOP, least: float = MIN_SCORE, order: str = "seg_idx") -> DataFrame:
    """The k rows of vectors (embedding, order, ...) most like the query by cosine, at least `least`; equal scores in the order of `order`.

    One pass with a heap of k rows for each task; nothing else is shuffled.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    size = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(F.col("embedding"), q) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.lit(size) + F.lit(1e-10))
    return vectors.withColumn("score", score).where(F.col("score") >= least).orderBy(F.desc("score"), order).limit(k)


#: Queries of a block, and parts into which the rows are dealt for each block.
BLOCK, PARTS = 4096, 64


def top_k_each(vectors: DataFrame, queries: DataFrame, key: str, k: int = TOP, least: float = MIN_SCORE, parts: int = PARTS) -> DataFrame:
    """(query, key, score): for each row of queries (key, embedding) the k rows of vectors (key, embedding) most like it.

    Queries form blocks of about BLOCK rows by a hash of their key. A block
    meets the rows in `parts` tasks as a product of matrices; each task gives
    the k best of its rows for each query, and those alone are shuffled again.
    Vectors without a value, or of another length than the query, match nothing.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    kind = queries.schema[key].dataType.simpleString()
    number = -(-max(1, queries.count()) // BLOCK)
    q = queries.where("embedding IS NOT NULL").select(F.pmod(F.xxhash64(key), F.lit(number)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), key, F.col("embedding").cast("array<double>"))
    v = vectors.where("embedding IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts)).cast("int").alias("part"), key, F.col("embedding").cast("array<double>"))

    def matrix(t: pa.Table):
        sizes = np.array([len(x) for x in t["embedding"].to_pylist()], int)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            part = t.take(pa.array(at))
            m = part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n) if n else np.zeros((len(at), 0))
            yield int(n), part[key].combine_chunks().to_numpy(zero_copy_only=False), m

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, out = {n: (i, m) for n, i, m in matrix(right)}, []
        for n, ids, m in matrix(left):
            if n in rows:
                others, r = rows[n]
                norms = np.sqrt((r * r).sum(axis=1))
                for lo in range(0, len(ids), 256):
                    own = m[lo : lo + 256]
                    score = own @ r.T / (np.sqrt((own * own).sum(axis=1))[:, None] * norms[None, :] + 1e-10)
                    for i, s in enumerate(score):
                        good = np.flatnonzero(s >= least)
                        best = good[np.lexsort((others[good], -s[good]))][:k]
                        out += [(ids[lo + i], others[j], s[j]) for j in best]
        return pa.table({"query": pa.array([x[0] for x in out], t_key), key: pa.array([x[1] for x in out], t_key), "score": pa.array([x[2] for x in out], pa.float64())})

    t_key = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    found = q.groupBy("block", "part").cogroup(v.groupBy("block", "part")).applyInArrow(meet, f"query {kind}, `{key}` {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
