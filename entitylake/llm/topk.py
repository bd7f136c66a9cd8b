"""Exact top-k search by inner product with the threshold algorithm.

Vectors lie in blocks, each with one sorted list per dimension.  A query walks the lists
of the dimensions it uses from their best end; a vector is scored in full when first met,
and the walk stops when the sum of the current list values cannot beat the k-th score.
Blocks are independent, so the best k of all blocks' best k are the best k of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries that meet in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 8_192, 256
#: List entries read per dimension before the bound is tested first; the step doubles.
FIRST_STEP = 64


def integer_vectors(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * component) of usable vectors, one per id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite)
    whole: Column = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, by score and then by smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def threshold_search(query: np.ndarray, own: int, ids: np.ndarray, v: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best vectors of a block.

    ``order`` has for each dimension the rows by ascending value; a negative component
    reads its list from the front, a positive one from the back.
    """
    dims = np.flatnonzero(query)
    n = len(ids)
    seen = np.zeros(n, bool)
    found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, step = 0, FIRST_STEP
    while depth < n:
        upto = min(n, depth + step) if len(dims) else n
        if len(dims):
            ahead = order[dims, depth:upto]
            back = order[dims, n - upto : n - depth]
            met = np.unique(np.where((query[dims] < 0)[:, None], ahead, back[:, ::-1]))
            met = met[~seen[met]]
        else:
            met = np.arange(n)
        seen[met] = True
        met = met[ids[met] != own]
        found, scores = np.concatenate([found, met]), np.concatenate([scores, v[met] @ query])
        top = best(scores, ids[found], k)
        found, scores = found[top], scores[top]
        depth, step = upto, step * 2
        if len(dims) and depth < n and len(found) == k:
            last = np.where(query[dims] < 0, order[dims, depth - 1], order[dims, n - depth])
            bound = int((query[dims] * v[last, dims]).sum())
            if bound < scores[-1]:
                break
    return ids[found], scores


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other vectors of each query.

    Queries are the vectors whose id is divisible by ``every``; scores are inner products
    of floor(scale * component), ties go to the smaller id.  Vectors that are null or hold
    a null or non-finite component take no part, nor do rows without an id.  An id counts
    once, with its least vector where rows repeat it.  A shorter vector is extended by
    zeros.  Scores are longs, so components have to be small enough for their sums.
    Fewer than k others give fewer rows, an empty table gives none.
    """
    known = integer_vectors(vectors, id_col, vector, scale)
    queries = known.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_vectors, n_queries = vectors.count(), vectors.where(F.pmod(F.col(id_col), F.lit(every)) == 0).count()
    v_blocks, q_blocks = n_vectors // BLOCK_VECTORS + 1, n_queries // BLOCK_QUERIES + 1
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.select("*", part(v_blocks).alias("vb"), every_block(q_blocks).alias("qb"))
    right = queries.select("*", part(q_blocks).alias("qb"), every_block(v_blocks).alias("vb"))

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if block.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(block["v"].map(len).max(), asked["v"].map(len).max())
        v, q, ids = matrix(block["v"], width), matrix(asked["v"], width), block["vec_id"].to_numpy()
        order = np.argsort(v, axis=0, kind="stable").T.copy()
        rows = []
        for own, query in zip(asked["vec_id"], q, strict=True):
            found, scores = threshold_search(query, own, ids, v, order, k)
            rows.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": scores}))
        return pd.concat(rows)

    schema = "query_id long, vec_id long, score long"
    blocks = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return blocks.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
