"""Embedding whitening against direct computations."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import whitening

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def rows_of(seed, n, width, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, width)) + noise * rng.normal(size=(n, width))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def result(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("vec", "at", "n", "deviation", "whitened", "values", "label"):
        df = df.withColumn(c, F.lit(c))
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op13_whitening(spark, str(tmp_path))
    assert out.columns == COLUMNS
    return out.collect()


def direct(rows):
    """x-vectors with their ids, exact sums and deviations, eigenvalues and vectors of the covariance."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] + [100000] * (width - len(v)) for _, v in good], dtype=object)
    n = len(good)
    sums = x.sum(0)
    centred = np.array([[float(Fraction(int(n * v - s), n)) for v, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return good, [sum(int(n * v - s) ** 2 for v, s in zip(row, sums)) for row in x], centred, values[::-1], vectors[:, ::-1]


def odd(seed):
    rows = rows_of(seed, 120, 12)
    return rows + [(3, rows[4][1]), (None, rows[5][1]), (5, rows[5][1]), (500, None), (501, [1.0, None]), (502, [float("nan")] * 12),
                   (503, [float("inf")]), (504, [0.5] * 7), (505, [])] + [(600, rows[9][1])] * 40


@pytest.mark.parametrize("rows", [rows_of(1, 300, 20), odd(2), rows_of(4, 40, 3)], ids=["plain", "odd", "narrow"])
def test_query(spark, tmp_path, rows):
    got = result(spark, tmp_path, rows)
    good, deviation, centred, values, vectors = direct(rows)
    k = min(8, len(values))
    assert sorted(((r.vec_id, r.component, r.n, r.deviation) for r in got), key=repr) == sorted(
        ((i, c + 1, len(good), d) for (i, _), d in zip(good, deviation) for c in range(k)), key=repr)
    for c in range(k):
        want = centred @ vectors[:, c] / np.sqrt(values[c])
        have = np.sort([r.whitened for r in got if r.component == c + 1])
        assert min(np.abs(have - np.sort(s * want)).max() for s in (1, -1)) < 1e-8
        assert abs(next(r.explained for r in got if r.component == c + 1) / (values[c] / values.sum()) - 1) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_without_variance(spark, tmp_path):
    """No rows, one row, and more dimensions than directions."""
    assert result(spark, tmp_path / "none", []) == []
    one = result(spark, tmp_path / "one", [(7, [1.0, 2.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (7, 1, 1, 0, 0.0, 0.0, 0.0), (7, 2, 1, 0, 0.0, 0.0, 0.0)]
    line = [(i, [float(i), float(i), 1.0]) for i in range(50)]
    got = result(spark, tmp_path / "line", line)
    assert {(r.component, r.explained > 0.99, r.whitened == 0.0) for r in got} >= {(2, False, True), (3, False, True)}
    assert got[0].identity_error < 1e-9 and all(r.whitened == 0.0 for r in got if r.component > 1)


@pytest.mark.parametrize("values", [
    [9.0, 4.0, 1.0, 0.5], [5.0, 5.0, 5.0, 1.0, 1.0], [3.0, 3.0 + 1e-9, 3.0 + 2e-9, 3.0 - 1e-10, 1.0, 1.0 + 1e-7, 0.0],
    list(1 + 1e-6 * np.arange(40)), [1.0] * 10, [0.0] * 4, list(10.0 ** -np.arange(12)),
], ids=["apart", "equal", "close", "dense", "one", "none", "graded"])
def test_eigenpairs(values):
    """Close and equal eigenvalues: residual, orthogonality and values to double precision."""
    size = len(values)
    q = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal to extended precision
        q = q @ (3 * np.eye(size) - q.T @ q) / 2
    a = (q @ np.diag(np.array(values, dtype=np.longdouble)) @ q.T).astype(float)
    a = (a + a.T) / 2
    got, x = whitening.eigenpairs(a)
    want = np.sort(values)[::-1]
    top = max(want.max(), 1e-300)
    assert np.abs(got - want).max() <= 4e-15 * top
    assert np.abs(x.T @ x - np.eye(size)).max() < 4e-15
    assert np.abs(a @ x - x * got).max() <= 1e-14 * top
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    if want.max() and len(set(values)) > 1:
        assert np.abs(start.T @ start - np.eye(size)).max() > 1e-9  # what the iterations had to correct


def test_clusters_are_solved(spark):
    """Directions inside a cluster of eigenvalues 1e-7 apart: as exact as double precision of the matrix allows."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    a = q @ np.diag([2, 1 + 2e-7, 1 + 1e-7, 1, 0.3, 0.1]) @ q.T
    x = whitening.eigenpairs((a + a.T) / 2)[1]
    assert np.abs(np.abs((x * q).sum(0)) - 1).max() < 1e-14
    assert np.abs(x.T @ q - np.diag(np.diag(x.T @ q))).max() < 1e-7


def test_large_numbers(spark):
    """deviation beyond 64 bits is null, not wrong."""
    rows = spark.createDataFrame([(1, [2.0 ** 31]), (2, [-(2.0 ** 31)]), (3, [0.0])], "vec_id long, embedding array<float>")
    vectors = whitening.whole_vectors(rows)
    model = whitening.fit(vectors)
    got = {r.vec_id: r.deviation for r in whitening.whitened(vectors, model).collect()}
    assert got == {1: None, 2: None, 3: 0}
