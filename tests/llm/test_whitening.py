from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from entitylake.llm import whitening
from entitylake.llm.queries import QUERIES


def dense(vectors, components=8):
    """n, deviations, eigenvalues, trace and whitened rows by the whole covariance matrix."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    centred = np.array([[float(c) for c in row] for row in (n * x - sums)]) / n
    cov = centred.T @ centred / n
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    return n, deviation, values, np.trace(cov), centred @ q / np.sqrt(values)


def compare(df, rows, components=8, atol=1e-9):
    collected = df.collect()
    found = pd.DataFrame([r.asDict() for r in collected], columns=df.columns)
    kept = [(i, v) for i, v in rows]
    n, deviation, values, trace, white = dense([v for _, v in kept], components)
    assert set(found["n"]) == {n} and len(found) == n * len(values)
    order = [i for i, _ in kept]
    table = found.pivot(index="vec_id", columns="component", values="whitened").loc[order].to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    np.testing.assert_allclose(table, white * sign, atol=atol)
    got = {r["vec_id"]: r["deviation"] for r in collected}
    assert [got[i] for i in order] == [d if d < 1 << 63 else None for d in deviation]
    # shares of the trace: both sides round by 1e-16 of the largest
    np.testing.assert_allclose(found.drop_duplicates("component").sort_values("component")["explained"], values / trace, rtol=1e-10, atol=1e-15)
    assert found["identity_error"].max() < 1e-9 and found["residual"].max() < 1e-10


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, n string, component int")


def test_query_against_the_whole_matrix(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(QUERIES["op11_embedding_whitening"](spark, sf), rows)


@pytest.mark.parametrize("block", [9, 16, 40])
def test_blocks_of_any_width(spark, block):
    rng = np.random.default_rng(3)
    spread = np.geomspace(30, 0.5, 40)
    rows = [(i, (rng.normal(size=40) * spread).tolist()) for i in range(400)]
    compare(whitening.whitened(frame(spark, rows).repartition(3), block=block), rows)


def test_a_dominant_direction(spark):
    """The first eigenvalue is a million times the eighth; the filter must not drown the last."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=20) * 1000
    rows = [(i, (rng.normal() * base + rng.normal(size=20)).tolist()) for i in range(300)]
    compare(whitening.whitened(frame(spark, rows)), rows, atol=1e-6)


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=5).tolist()) for i in range(50)]
    odd = [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0]), (62, [float("nan")] * 5), (63, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    odd += [(64, [1.0, 2.0]), (65, []), (66, [1e300] * 5)]
    compare(whitening.whitened(frame(spark, good + odd)), good, components=5)


def test_repeated_rows_and_rows_without_an_id(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(30)] + [(None, [1.0] * 6), (3, [0.5] * 6), (3, [0.5] * 6)]
    found = whitening.whitened(frame(spark, rows)).toPandas()
    assert len(found) == 33 * 6 and set(found["n"]) == {33}
    assert len(found[found["vec_id"].isna()]) == 6
    white = np.stack([g["whitened"].to_numpy() for _, g in found.groupby("component")])
    np.testing.assert_allclose(white @ white.T / 33, np.eye(6), atol=1e-9)


def test_fewer_components_than_asked_for(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(frame(spark, [(i, [1.0] * 12) for i in range(9)])).count() == 0
    line = whitening.whitened(frame(spark, [(i, [float(i), 0.0, 2.0 * i] + [7.0] * 9) for i in range(9)])).toPandas()
    assert set(line["component"]) == {1} and line["explained"].tolist() == pytest.approx([1.0] * 9)


def test_large_integers_stay_exact(spark):
    rows = [(i, [1e10 * i, -1e9 * i * i]) for i in range(6)]
    found = whitening.whitened(frame(spark, rows)).toPandas()
    expected = dense([v for _, v in rows], 2)[1]
    got = found.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist()
    assert [None if math.isnan(g) else int(g) for g in got] == [d if d < 1 << 63 else None for d in expected]


def test_no_covariance_leaves_the_tasks(spark, sf, monkeypatch):
    """Every pass sends one column per direction."""
    shapes = []
    summed = whitening.summed
    monkeypatch.setattr(whitening, "summed", lambda rows, width, mean, of, shape: shapes.append(shape) or summed(rows, width, mean, of, shape))
    whitening.whitened(spark.read.parquet(f"{sf}/embeddings.parquet")).count()
    assert set(shapes) == {(1, 1), (64, 32), (9, 8)}


def test_the_degree_keeps_the_gain_bounded():
    assert whitening.degree_within(1e6, 1.5, 1.2, 12) == 12
    assert whitening.degree_within(1e6, 1e9, 1.1, 12) == 1
    grown = [whitening.degree_within(g, 100, 1.2, 12) for g in (1e3, 1e6, 1e9)]
    assert grown == sorted(grown) and grown[0] < grown[-1]
