from __future__ import annotations

import math

import numpy as np
import pytest

from entitylake.llm import topk
from entitylake.llm.queries import ORACLES, QUERIES


def brute(vectors, k, every, scale=1024):
    known = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(scale * x) for x in v]
            known[i] = min(known.get(i, whole), whole)
    rows = []
    for q in known:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q)
            rows += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(rows)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=4).round(1).tolist()) for i in range(60)]
    vectors += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    vectors += [(64, [1.0, 2.0]), (65, []), (5, vectors[5][1]), (70, [0.0] * 4), (71, [0.5] * 4), (72, [0.5] * 4), (7, [9.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in vectors], "vec_id long, embedding array<double>, rank string, score int")
    assert result(topk.top_k(df, k=5, every=7)) == brute(vectors, 5, 7)
    assert result(topk.top_k(df, k=500, every=10)) == brute(vectors, 500, 10)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "FIRST_STEP", 4)
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert result(topk.top_k(df, k=4, every=10)) == brute(vectors, 4, 10)


def test_the_search_stops_before_the_end():
    n = 4_000
    v = np.zeros((n, 3), np.int64)
    v[:, 0] = np.arange(n)
    order = np.argsort(v, axis=0, kind="stable").T.copy()
    reads = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            reads.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    found, scores = topk.threshold_search(np.array([2, 0, 0]), -1, np.arange(n), v.view(Counting), order, 5)
    assert found.tolist() == [n - 1 - i for i in range(5)] and scores.tolist() == [2 * (n - 1 - i) for i in range(5)]
    assert sum(reads) < n / 10


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", ["op1_top_k_search"])
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert result(QUERIES[name](spark, sf)) == sorted(db.execute(ORACLES[name]).fetchall())
