"""Embedding whitening: distributed centred covariance, eigenvectors of its leading eigenvalues, broadcast projection.

A vector's entries c become whole numbers x = floor(1024 * c) + 100000. One pass adds them up; a second one, with the
whole number nearest to each mean taken off before anything is multiplied, adds up products. Both sums are exact (every
block's products fit a double's 53 bits, blocks are cut so that they do, and sums of blocks are decimals), so the
covariance does not depend on how rows are dealt or on tasks that ran twice. Tasks send one sum for each pair of
dimensions; the driver gets the final sums only, as many as there are pairs. It finds the eigenvectors: Householder
tridiagonalisation, bisection on Sturm counts for the leading eigenvalues, inverse iteration with reorthogonalisation
inside clusters, and the reflections back. The components, dimensions times 8 numbers, go to all tasks for the
projection.

Edge cases: rows whose vector is null, or holds a null, NaN, an infinite entry or one beyond 2^52, are dropped, and so are
those whose length is not the most frequent one (the longer of two equally frequent); components whose eigenvalue is 0 to
working precision are left out, since nothing whitens them, so a table of equal vectors gives no row; a ``deviation``
beyond a long is null; repeated rows are kept and counted; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries beyond this are dropped as if they were infinite.
LARGEST = float(1 << 52)
EXACT = 1 << 53


def whole(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable rows of a column of vectors, and their whole numbers."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == length)
    entries = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), length)
    fine = (np.abs(entries) <= LARGEST).all(axis=1)
    return at[fine], np.floor(SCALE * entries[fine]).astype(np.int64) + SHIFT


def vector_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, 0 if there are none."""
    found = df.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return found["length"] if found else 0


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def sums(df: DataFrame, vector: str, length: int) -> tuple[int, list[int]]:
    """The number of usable vectors and their exact sum by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (length + 1)
        for batch in batches:
            x = whole(batch.column(0), length)[1]
            total[0] += len(x)
            for i, s in enumerate((x >> 32).sum(axis=0).tolist()):  # halves, so that no sum leaves 64 bits
                total[i + 1] += s << 32
            for i, s in enumerate((x & 0xFFFFFFFF).sum(axis=0).tolist()):
                total[i + 1] += s
        yield pa.RecordBatch.from_arrays([pa.array(range(length + 1), pa.int32()), _decimals(total)], names=["i", "s"])

    rows = df.select(vector).mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(length)]


def _products(y: np.ndarray) -> np.ndarray:
    """The exact sum of the rows' outer products, as Python numbers."""
    most = int(np.abs(y).max(initial=0)) ** 2
    if most >= EXACT:
        wide = y.astype(object)
        return wide.T @ wide
    step = max(1, (EXACT - 1) // max(most, 1))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i in range(0, len(y), step):
        block = y[i : i + step].astype(np.float64)
        total += (block.T @ block).astype(np.int64).astype(object)
    return total


def covariance(df: DataFrame, vector: str, n: int, total: list[int]) -> np.ndarray:
    """The covariance (divisor n) of the whole numbers, each entry correctly rounded from exact sums."""
    length = len(total)
    near = [(2 * s + n) // (2 * n) for s in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array(near, np.int64)
        products, rest = np.zeros((length, length), object), [0] * length
        for batch in batches:
            y = whole(batch.column(0), length)[1] - centre
            products += _products(y)
            high, low = (y >> 32).sum(axis=0).tolist(), (y & 0xFFFFFFFF).sum(axis=0).tolist()
            rest = [r + (h << 32) + lo for r, h, lo in zip(rest, high, low, strict=True)]
        i, j = np.triu_indices(length)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.arange(length)]), pa.int32()), pa.array(np.concatenate([j, np.full(length, -1)]), pa.int32()), _decimals([*products[i, j].tolist(), *rest])],
            names=["i", "j", "q"],
        )

    rows = df.select(vector).mapInArrow(run, "i int, j int, q decimal(38,0)").groupBy("i", "j").agg(F.sum("q").alias("q")).collect()
    q = {(r["i"], r["j"]): int(r["q"]) for r in rows}
    out = np.zeros((length, length))
    for i in range(length):
        for j in range(i, length):
            out[i, j] = out[j, i] = (n * q[i, j] - q[i, -1] * q[j, -1]) / (n * n)
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflection vectors of a symmetric matrix (Householder)."""
    a, vectors = a.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max(initial=0.0)
        if scale > 0:
            v /= scale
        length = np.linalg.norm(v)
        v[0] += length if v[0] >= 0 else -length
        size = np.linalg.norm(v)
        if size > 0:
            v /= size
            p = a[k + 1 :, k + 1 :] @ v
            w = p - (v @ p) * v
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
            column = a[k + 1 :, k]
            a[k + 1 :, k] = a[k, k + 1 :] = column - 2 * v * (v @ column)
        vectors.append(v)
    return a.diagonal().copy(), a.diagonal(1).copy(), vectors


def smaller(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each of ``at`` (Sturm counts)."""
    least = np.finfo(float).tiny * max(1.0, float((e * e).max(initial=0.0)))
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` largest eigenvalues of a tridiagonal matrix, largest first, each bisected to neighbouring doubles."""
    beside = np.concatenate([[0.0], np.abs(e)]) + np.concatenate([np.abs(e), [0.0]])
    low, high = np.full(m, (d - beside).min()), np.full(m, (d + beside).max())
    pad = 1e-12 * max(abs(low[0]), abs(high[0]), 1e-300)
    low, high = low - pad, high + pad
    wanted = len(d) - np.arange(m)  # as many eigenvalues lie below anything above the k-th largest
    for _ in range(2100):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = smaller(d, e, middle) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return low + (high - low) / 2


def _solve(d: np.ndarray, e: np.ndarray, value: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - value) z = b by elimination with row exchanges; pivots under ``least`` become it."""
    n = len(d)
    u = np.zeros((n, 3))
    z = b.copy()
    row = [d[0] - value, e[0] if n > 1 else 0.0, 0.0]
    for i in range(n - 1):
        below = [e[i], d[i + 1] - value, e[i + 1] if i + 2 < n else 0.0]
        if abs(below[0]) > abs(row[0]):
            row, below = below, row
            z[i], z[i + 1] = z[i + 1], z[i]
        pivot = row[0] if abs(row[0]) > least else least
        u[i] = pivot, row[1], row[2]
        f = below[0] / pivot
        row = [below[1] - f * row[1], below[2] - f * row[2], 0.0]
        z[i + 1] -= f * z[i]
    u[n - 1, 0] = row[0] if abs(row[0]) > least else least
    for i in range(n - 1, -1, -1):
        z[i] = (z[i] - (u[i, 1] * z[i + 1] if i + 1 < n else 0.0) - (u[i, 2] * z[i + 2] if i + 2 < n else 0.0)) / u[i, 0]
        if abs(z[i]) > 1e150:
            z *= 1e-150
    return z


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those of close eigenvalues are kept orthogonal to one another."""
    norm = float((np.abs(d) + np.concatenate([[0.0], np.abs(e)]) + np.concatenate([np.abs(e), [0.0]])).max(initial=0.0)) or 1.0
    eps = np.finfo(float).eps
    chance = np.random.default_rng(0)
    out = np.zeros((len(d), len(values)))
    first, shifted = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first, shifted = k, np.inf
        shifted = min(value, shifted - 10 * eps * norm) if k > first else value
        z = chance.standard_normal(len(d))
        for _ in range(8):
            z = _solve(d, e, shifted, z / np.linalg.norm(z), eps * norm)
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= out[:, first:k] @ (out[:, first:k].T @ z)
            z /= np.linalg.norm(z)
        out[:, k] = z
    return out


def eigen(a: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` leading eigenvalues of a symmetric matrix, largest first, and their unit eigenvectors (columns)."""
    d, e, reflections = tridiagonal(a)
    vectors = tridiagonal_vectors(d, e, leading(d, e, m))
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    return np.einsum("ik,ij,jk->k", vectors, a, vectors), vectors


@dataclass(frozen=True)
class Whitening:
    """What was learned: the fit list's size, sums and trace, eigenvalues and components (columns)."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: in 64 bits where that is enough, else as Python numbers."""
        large = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) >= 1 << 62
        kind = object if large else np.int64
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        c = self.centred(x)
        if c.dtype != object and (int(np.abs(c).max(initial=0)) ** 2) * max(c.shape[1], 1) < 1 << 62:
            return (c * c).sum(axis=1).tolist()
        c = c.astype(object)
        return [s if s < 1 << 63 else None for s in map(int, (c * c).sum(axis=1))]

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(np.float64) @ (self.components / np.sqrt(self.values))


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none."""
    length = vector_length(df, vector)
    if length == 0:
        return None
    n, total = sums(df, vector, length)
    if n == 0:
        return None
    v = covariance(df, vector, n, total)
    trace = float(v.trace())
    values, vectors = eigen(v, min(components, length))
    some = values > length * np.finfo(float).eps * trace
    values, vectors = values[some], vectors[:, some]
    w = vectors / np.sqrt(values)
    error = float(np.abs(w.T @ v @ w - np.eye(len(values))).max(initial=0.0))
    return Whitening(n, tuple(total), trace, values, vectors, error)


def whiten(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``whitened`` (one number for each component) of each usable row."""
    length = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole(batch.column(1), length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(model.project(x)), pa.list_(pa.float64()))], names=[key, "whitened"])

    return df.select(key, vector).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, whitened array<double>")


def apply(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    model = fit(df, components=components)
    kind = df.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    length, m = len(model.sums), len(model.values)
    explained = model.values / model.trace if m else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole(batch.column(1), length)
            rows = len(at)
            columns = [
                batch.column(0).take(pa.array(np.repeat(at, m))), pa.array(np.tile(np.arange(1, m + 1), rows), pa.int32()), pa.array(np.full(rows * m, model.n), pa.int64()),
                pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), m))), pa.array(model.project(x).reshape(-1)),
                pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select("vec_id", "embedding").mapInArrow(run, schema)
