"""Whitening of vectors by principal components that a randomised range finder gives.

The covariance is never formed from uncentred values: every row is centred first, exactly in whole numbers (n x - S), and then
multiplied. A random block of as many directions as components are asked for, and some more, is sent through the centred rows; each power
pass multiplies it by the covariance in one scan and orthonormalises it. Rayleigh-Ritz in its span gives
eigenpairs, and what the covariance does to them beyond their eigenvalue is their residual. Where residuals stay above the
tolerance after all passes, as on flat spectra, the block is expanded to the full dimension: its span is then the whole space, and
Rayleigh-Ritz is exact.

What leaves a task is a block of dimension x directions, added up by Spark; the driver holds such a block, which
grows with the dimension and never with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared, vectors

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, OVERSAMPLE, PASSES = 32, 8, 8
TOLERANCE = 1e-13  # residual of an eigenpair, as a share of the greatest eigenvalue
ZERO = 1e-12  # an eigenvalue below this share of the greatest one is none
LONGEST = (1 << 63) - 1


class Fit(NamedTuple):
    """n rows, their sums by dimension (whole numbers), the axes as columns and their eigenvalues, the covariance's trace, how the axes were found."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    expanded: bool
    passes: int


def scaled(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x, good = vectors.grid(batch, SCALE, dim)
    return x + SHIFT, good


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S in whole numbers, divided by n once. Beyond 64 bits in Python's whole numbers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < LONGEST // 2:
        return (n * x - np.array(sums, np.int64)) / n
    return ((x.astype(object) * n - np.array(sums, object)) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Exact sums of (n x - S)^2 over dimensions; beyond a long the greatest long."""
    most = int(np.abs(x).max(initial=0)) + 1
    d = n * x - np.array(sums, np.int64) if n * most < LONGEST // 2 else x.astype(object) * n - np.array(sums, object)
    if d.size and d.dtype != object and int(np.abs(d).max()) ** 2 * d.shape[1] < LONGEST:
        return (d * d).sum(1).tolist()
    d = d.astype(object)
    return [min(int(v), LONGEST) for v in (d * d).sum(1)] if d.shape[1] else [0] * len(d)


def totals(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """n and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for b in vectors.pieces(batches):
            x, _ = scaled(b, dim)
            n, total = n + len(x), total + (x.sum(0) if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([int(t) for t in total], pa.decimal128(38, 0)), pa.array(np.full(dim, n))], names=["at", "total", "n"])

    got = rows.select("v").mapInArrow(run, "at long, total decimal(38,0), n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    return (got[0].n if got else 0), tuple(int(r.total) for r in got)


def added(frame: DataFrame, width: int) -> np.ndarray:
    """Rows (at, values) of equal `at`, added up value by value: one row for each `at` comes back."""
    sums = [F.sum(F.col("values")[j]).alias(f"s{j}") for j in range(width)]
    got = frame.groupBy("at").agg(*sums).orderBy("at").collect()
    return np.array([r[1:] for r in got], np.float64)


def sweep(rows: DataFrame, n: int, sums: tuple[int, ...], block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times a block of directions, and its trace, by one scan of the centred rows."""
    dim, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace, any_ = np.zeros((dim, width)), np.zeros((1, width)), False
        for b in vectors.pieces(batches):
            x, _ = scaled(b, dim)
            y = centred(x, n, sums)
            total += y.T @ (y @ block)
            trace[0, 0] += np.einsum("ij,ij->", y, y)
            any_ = any_ or len(x) > 0
        if any_:
            both = np.vstack([total, trace])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(list(both), pa.list_(pa.float64()))], names=["at", "values"])

    got = added(rows.select("v").mapInArrow(run, "at long, values array<double>"), width) / n
    return got[:dim], float(got[dim, 0])


def orthonormal(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block)[0]


def ritz(block: np.ndarray, image: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Values and axes in the span of an orthonormal block, falling, and the greatest residual of the first `want`, as a share of the greatest value."""
    inner = block.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    axes = block @ turn
    rest = np.linalg.norm(image @ turn - axes * values, axis=0)[:want]
    top = max(float(values[0]), 0.0) if len(values) else 0.0
    return values, axes, float(rest.max(initial=0) / top) if top else 0.0


def fit(rows: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 7) -> Fit:
    """Axes of a frame with a column v, found on all its rows."""
    dim = vectors.about(rows, SCALE).dim
    n, sums = totals(rows, dim)
    if not n or not dim:
        return Fit(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, False, 0)
    width, made = min(dim, components + oversample), 0
    rng = np.random.default_rng(seed)
    block = orthonormal(rng.standard_normal((dim, width)))
    rest, before = np.inf, np.inf
    while True:
        image, trace = sweep(rows, n, sums, block)
        made += 1
        values, axes, rest = ritz(block, image, components)
        # A pass shrinks residuals by a steady factor; where the passes that are left can't bring them down, they aren't made.
        left = passes - made
        hopeless = before < np.inf and rest > 0 and rest * (rest / before) ** left > tolerance
        if rest <= tolerance or width == dim or left <= 0 or hopeless:
            break
        block, before = orthonormal(image), rest
    expanded = rest > tolerance and width < dim
    if expanded:
        block = orthonormal(np.hstack([axes, rng.standard_normal((dim, dim - width))]))
        image, trace = sweep(rows, n, sums, block)
        values, axes, _ = ritz(block, image, components)
        made += 1
    kept = values[:components] > ZERO * values[0]
    return Fit(n, sums, axes[:, :components][:, kept], values[:components][kept], trace, expanded, made)


def whitened(x: np.ndarray, found: Fit) -> np.ndarray:
    return centred(x, found.n, found.sums) @ found.axes / np.sqrt(found.values)


def identity_error(rows: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by one scan."""
    dim, width = found.axes.shape
    if not width:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first = np.zeros((width, width)), np.zeros((1, width))
        for b in vectors.pieces(batches):
            w = whitened(scaled(b, dim)[0], found)
            second += w.T @ w
            first += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(list(np.vstack([second, first])), pa.list_(pa.float64()))], names=["at", "values"])

    got = added(rows.select("v").mapInArrow(run, "at long, values array<double>"), width) / found.n
    return float(np.abs(got[:width] - np.outer(got[width], got[width]) - np.eye(width)).max())


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every row and component.

    Rows whose vector is null or holds null or non-finite components take no part. Repeated rows, and rows with a null id, count and are whitened like any others. Shorter vectors
    count as padded with zeros, components beyond 2**53 / 64 as that, deviations beyond a long as the greatest long. There are no more components than dimensions, and none whose eigenvalue is
    zero (below 1e-12 of the greatest): one row, or equal rows, give no component and so no rows; so does an empty table. Extra columns are left out. The input is
    read once for each pass and four times more: hand in a written table where it is costly.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    found = fit(rows, components, oversample, passes, tolerance)
    error, (dim, width) = identity_error(rows, found), found.axes.shape
    explained = found.values / found.trace if width else found.values
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.pieces(batches) if width else ():
            x, good = scaled(b, dim)
            m = len(x)
            ids = b.column("id").filter(pa.array(good)).take(pa.array(np.repeat(np.arange(m), width)))
            columns = [
                ids, np.tile(np.arange(1, width + 1, dtype=np.int32), m), np.full(m * width, found.n), np.repeat(np.array(deviations(x, found.n, found.sums), np.int64), width),
                whitened(x, found).ravel(), np.tile(explained, m), np.full(m * width, error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if isinstance(c, np.ndarray) else c for c, t in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(shared.table(spark, sf_dir, "embeddings"))
