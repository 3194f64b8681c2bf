"""Embedding whitening: eigenvectors and covariance against numpy and exact fractions, edge cases."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from inodelake.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1.0, 41.0), np.r_[np.full(5, 7.0), np.arange(6.0)], np.r_[[9, 9 - 1e-12, 9 - 2e-12, 3], np.zeros(8)], np.ones(6), np.zeros(5), np.r_[1e12, 1e-6, np.ones(10)],
        np.r_[[5.0, 4.0]], np.r_[[3.0]], np.geomspace(1e8, 1, 64),
    ],
)
def test_eigenvectors(values):
    a = symmetric(values)
    m = min(8, len(a))
    found, vectors = W.eigen(a, m)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.allclose(found, np.sort(values)[::-1][:m], rtol=0, atol=1e-13 * len(a) * scale)
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * len(a) * scale
    assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-11


def test_split_matrices():
    a = np.diag([2.0, 5.0, 5.0, 1.0, 5.0])
    found, vectors = W.eigen(a, 4)
    assert np.allclose(found, [5, 5, 5, 2]) and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_sturm_counts():
    a = symmetric(np.array([1.0, 2, 2, 3, 8]))
    d, e, _ = W.tridiagonal(a)
    assert W.smaller(d, e, np.array([0.5, 1.5, 2.5, 7.0, 9.0])).tolist() == [0, 1, 3, 4, 5]


def brute(rows):
    """Whole numbers, n, exact sums, deviations and covariance, one vector after another."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in rows]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    mean = [Fraction(s, n) for s in total]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n) for j in range(len(total))] for i in range(len(total))]
    return np.array(x), n, total, deviation, np.array(cov)


def test_apply_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 12)) @ np.diag(np.geomspace(1, 0.01, 12)) + 0.3).astype(np.float32).tolist()
    vectors[7] = vectors[6]
    bad = [None, [None] + [0.0] * 11, [float("nan")] * 12, [0.0] * 11 + [float("-inf")], [], [0.5] * 11]
    rows = [(i, v, 0, 1, "x") for i, v in enumerate(vectors)] + [(900 + i, v, 0, 1, None) for i, v in enumerate(bad)]
    got = W.apply(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    x, n, total, deviation, cov = brute(vectors)
    assert len(got) == 300 * 8 and (got["n"] == n).all()
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == dict(enumerate(deviation))
    values, own = np.linalg.eigh(cov)
    values, own = values[::-1][:8], own[:, ::-1][:, :8]
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - np.array(total) / n) @ (own / np.sqrt(values))
    signs = np.sign((wide * want).sum(axis=0))
    assert np.abs(wide * signs - want).max() < 1e-7
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(8)).max() < 1e-9 and (got["identity_error"] < 1e-10).all()
    first = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(first, values / cov.trace(), rtol=1e-10)


def test_dealing_does_not_change_the_covariance(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(6).tolist(), 0, 0, "") for i in range(400)], SCHEMA)
    found = [W.fit(df.repartition(k)) for k in (1, 2, 7)]
    assert all((f.values == found[0].values).all() and (f.components == found[0].components).all() for f in found)


def test_edge_cases(spark):
    assert W.apply(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.apply(spark.createDataFrame([(1, None, 0, 0, "")], SCHEMA)).collect() == []
    assert W.apply(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, ""), (2, [1.0, 2.0], 0, 0, "")], SCHEMA)).collect() == []
    two = W.apply(spark.createDataFrame([(1, [1.0, 2.0, 0.0], 0, 0, ""), (2, [2.0, 2.0, 0.0], 0, 0, "")], SCHEMA)).collect()
    assert [(r["component"], abs(r["whitened"]), r["explained"]) for r in two] == [(1, 1.0, 1.0), (1, 1.0, 1.0)]
    model = W.fit(spark.createDataFrame([(i, [2.0**40 * i, 1.0], 0, 0, "") for i in range(5)], SCHEMA))
    huge = np.array([[(1 << 50) * 4 + 100_000, 101_024]])
    assert model.deviation(huge) == [None] and np.isfinite(model.project(huge)).all()


def test_whiten_keeps_rows_whole(spark):
    df = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0], 0, 0, "") for i in range(30)], SCHEMA)
    model = W.fit(df)
    got = W.whiten(df, model).collect()
    assert len(got) == 30 and {len(r["whitened"]) for r in got} == {2}
