"""Whitening of vectors by their leading principal components.

The components are found by Chebyshev-filtered subspace iteration.  A block of directions Q
is filtered by a polynomial of the covariance that grows beyond the largest unwanted
eigenvalue and stays small below it; each step of its three-term recurrence is one
distributed pass that sums (x - m)((x - m)'Q) over all vectors.  QR makes the block
orthonormal, Rayleigh-Ritz turns it to the best eigenvectors it holds, and the residuals
||VQ - QE|| of the same pass certify them.  Only matrices of one column per direction leave
the tasks; the covariance itself is never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import lean
from entitylake.sources.stage import staged

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Largest degree of the filter between two Rayleigh-Ritz steps.
DEGREE = 12
#: What the filter may gain on the largest eigenvalue over the smallest wanted one: beyond it
#: rounding of the first would drown the last.
GAIN = 1e6
#: Residual, relative to the largest eigenvalue, that the iteration aims at, and that it has to reach.
AIM, CERTAIN = 1e-14, 1e-10
#: Rayleigh-Ritz steps with one block before it is widened.
STEPS = 40
#: Eigenvalues below this part of the trace count as zero.
ZERO = 1e-13
#: Components have to be smaller than this for exact integers.
LARGEST = float(1 << 52)


@dataclass(frozen=True)
class Fit:
    """Counts and exact sums of the vectors, and their leading eigenpairs, largest first."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        """S / n by parts, so that the quotient of large sums keeps all its digits."""
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums]) if self.n else np.zeros(0)


def integer_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``vec_id, x``: floor(1024 c) + 100000 of each usable vector."""

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST)

    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    rows = vectors.where(F.col(vector).isNotNull() & F.forall(vector, usable))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The integer vectors of a batch, one a row."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def exact_sums(rows: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Vectors and their sums per dimension, as exact integers: one row per dimension reaches the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, width)
                # halves of 32 bits: sums of a batch stay within 64
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low)]
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({
                "dim": np.arange(width), "n": np.full(width, n), "total": [str(t) for t in total]
            })

    parts = rows.select("x").mapInArrow(lean(part), "dim long, n long, total string")
    sums = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["dim"]: r for r in sums.collect()}
    if not found:
        return 0, (0,) * width
    return found[0]["n"], tuple(int(found[d]["total"]) for d in range(width))


def summed(rows: DataFrame, width: int, mean: np.ndarray, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all vectors of ``of`` (centred rows of a batch), a matrix of ``shape``.

    Tasks send their part of the matrix, Spark adds them cell by cell; the driver gets the
    cells of one matrix.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch, width) - mean)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "value": total.ravel()})

    parts = rows.select("x").mapInArrow(lean(part), "cell long, value double")
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[cells["cell"].to_numpy(np.int64)] = cells["value"].to_numpy()
    return out.reshape(shape)


def degree_within(gain: float, top: float, wanted: float, largest: int) -> int:
    """The largest degree whose Chebyshev polynomial gains no more than this on ``top`` over ``wanted`` (both beyond 1)."""
    degree = 1
    while degree < largest:
        grown = np.cosh((degree + 1) * np.arccosh(top)) / np.cosh((degree + 1) * np.arccosh(max(wanted, 1.0)))
        if not grown <= gain:
            break
        degree += 1
    return degree


def leading(covariance: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, eigenvectors (columns) and their largest relative residual, by filtered subspace iteration.

    ``covariance`` applies the matrix to a block.  A block that does not converge is doubled;
    one as wide as the space needs a single step.
    """
    rng = np.random.default_rng(11)
    block = min(block, width)
    q = np.linalg.qr(rng.normal(size=(width, block)))[0]
    while True:
        best, stalled = np.inf, 0
        for _ in range(STEPS):
            w = covariance(q)
            small = q.T @ w
            values, turn = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(-values)
            values, turn = values[order], turn[:, order]
            q, w = q @ turn, w @ turn
            top = max(values[0], 0.0)
            residual = np.linalg.norm(w[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max()
            relative = float(residual / top) if top > 0 else 0.0
            stalled = stalled + 1 if relative > best / 2 else 0
            best = min(best, relative)
            if relative <= AIM or block == width or (relative <= CERTAIN and stalled >= 2):
                return values[:wanted], q[:, :wanted], relative
            # damp [0, the least Ritz value of the block]; Chebyshev's recurrence, scaled at the largest
            centre = half = max(values[-1], top * 1e-12) / 2
            sigma = first = half / (top - centre)
            degree = degree_within(GAIN, (top - centre) / half, (values[min(wanted, block) - 1] - centre) / half, DEGREE)
            before, now = q, (w - centre * q) * (first / half)
            for _ in range(degree - 1):
                after = 1 / (2 / first - sigma)
                before, now = now, (covariance(now) - centre * now) * (2 * after / half) - sigma * after * before
                sigma = after
            q = np.linalg.qr(now)[0]
        wider = min(width, 2 * block)
        q = np.linalg.qr(np.hstack([q, rng.normal(size=(width, wider - block))]))[0]
        block = wider


def fit(rows: DataFrame, width: int, components: int, block: int) -> Fit:
    """Mean and leading eigenpairs of the covariance (divisor n) of ``rows`` (``x``)."""
    n, sums = exact_sums(rows, width)
    none = Fit(n, sums, 0.0, np.zeros(0), np.zeros((width, 0)), 0.0, 0)
    if not n or not width:
        return none
    mean = none.mean
    trace = float(summed(rows, width, mean, lambda y: (y * y).sum().reshape(1, 1), (1, 1))[0, 0] / n)
    if not trace > 0:
        return none
    passes = 0

    def covariance(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return summed(rows, width, mean, lambda y: y.T @ (y @ q), q.shape) / n

    values, vectors, residual = leading(covariance, width, min(components, width), block)
    real = values > ZERO * trace
    return Fit(n, sums, trace, values[real], vectors[:, real], residual, passes)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 63 bits."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if reach**2 * x.shape[1] < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def whitened(
    vectors: DataFrame, *, components: int = COMPONENTS, block: int | None = None, id_col: str = "vec_id", vector: str = "embedding", owner: str | None = None
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, residual`` of each usable vector.

    A component c becomes floor(1024 c) + 100000.  ``whitened`` is the projection of the
    centred vector on a component (numbered from 1 by falling eigenvalue e) over sqrt(e),
    ``explained`` e over the trace, ``identity_error`` the largest entry of the whitened
    covariance minus the identity, measured on all rows, ``residual`` the certificate
    ||Vq - eq|| of the worst component over the largest eigenvalue.  ``block`` directions
    (four a component at first) are iterated together.

    Vectors that are null or hold nulls, non-finite or huge (2^52 / 1024 and more) entries
    take no part, nor do those that are not as long as most are (of equally many the longer);
    an empty vector has no components.  Rows without an id and repeated rows count like
    others.  Where the covariance has fewer positive eigenvalues than asked for, as with
    constant or few vectors, there are only so many components.  ``deviation`` is null beyond
    63 bits.  No usable vector gives no rows.
    """
    owner = owner or f"whitening-{uuid4().hex}"
    spark = vectors.sparkSession
    rows = staged(integer_vectors(vectors, id_col, vector), owner)
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths["width"] if lengths else 0
    rows = rows.where(F.size("x") == width)
    model = fit(rows, width, components, block or 4 * components)
    count = len(model.values)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if not count:
        return spark.createDataFrame([], schema)
    mean, scaled = model.mean, model.vectors / np.sqrt(model.values)
    products = summed(rows, width, mean, lambda y: np.vstack([(z := y @ scaled).T @ z, z.sum(axis=0)]), (count + 1, count))
    middle = products[-1] / model.n
    error = float(np.abs(products[:-1] / model.n - np.outer(middle, middle) - np.eye(count)).max())
    explained, sums, n, residual = model.values / model.trace, model.sums, model.n, model.residual

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, width)
            at = np.repeat(np.arange(batch.num_rows), count)
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()),
                "n": np.full(len(at), n),
                "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(at)),
                "whitened": ((x - mean) @ scaled).ravel(),
                "explained": np.tile(explained, batch.num_rows),
                "identity_error": np.full(len(at), error),
                "residual": np.full(len(at), residual),
            })

    return rows.mapInArrow(lean(project), schema)
