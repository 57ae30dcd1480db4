"""Whitening against numpy's own eigenvectors and exact sums."""

import math
from fractions import Fraction

import numpy as np
import pytest

from parcelcover.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, n int, component string")


def check(vectors, rows, components=32):
    """rows against a dense solution: exact counts, variances, and whitened up to the sign of a component."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    x = np.array([np.floor(64 * v).astype(int) + 1_000_000 for _, v in good])
    n, d = x.shape
    sums = [sum(map(int, c)) for c in x.T]
    centred = np.array([[float(Fraction(n * int(a) - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(rows) == n * k
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
        assert r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    for (i, _), row in zip(good, x, strict=True):
        deviation = sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True))
        assert sorted(by[i, deviation]) == list(range(1, k + 1))
    ids = [i for i, _ in good]
    got = np.array([[by[i, sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True))][c] for c in range(1, k + 1)] for i, row in zip(ids, x, strict=True)])
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-7


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in df.collect()], queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect())


def test_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r.normal(size=5) * (1, 2, 3, 50, 0.1)]) for i in range(40)]
    odd = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [1.0, NAN, 2.0, 3.0, 4.0]), (93, [1.0, 2.0, INF, 3.0, 4.0]), (94, [-INF, 0.0, 0.0, 0.0, 0.0]), (1, rows[1][1]), (1, rows[1][1]), (None, rows[2][1])]
    df = table(spark, rows + odd)
    out = whitening.whiten(df).collect()
    assert {r.vec_id for r in out} == {None, *range(40)} and len(out) == 43 * 5
    check(rows, whitening.whiten(df.where("vec_id < 90 and vec_id <> 1").unionByName(table(spark, [rows[1]]))).collect())
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id > 89")).collect() == []


@pytest.mark.parametrize("vectors", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])]])
def test_without_variance(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).collect() == []


def test_lower_rank(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(a), float(b), float(a), 1.0]) for i, (a, b) in enumerate(r.integers(-9, 9, (30, 2)))]
    check(rows, whitening.whiten(table(spark, rows)).collect())


def test_ragged_vectors_are_an_error(spark):
    with pytest.raises(ValueError, match="1 to 2 entries"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_large_numbers_stay_exact(spark):
    """Products and deviations beyond 64 bits."""
    r = np.random.default_rng(6)
    rows = [(i, [float(c) for c in r.integers(-(2**40), 2**40, 3)]) for i in range(20)]
    check(rows, whitening.whiten(table(spark, rows)).collect())


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_factors(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d + 3)) * 10.0 ** r.integers(-3, 3, (d, 1))
    a = a @ a.T
    f = whitening.pivoted_cholesky(a)
    assert np.allclose(f @ f.T, a, rtol=1e-12, atol=1e-12 * np.abs(a).max())
    values, components = whitening.jacobi(f)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=1e-13 * values[0])
    assert np.abs(components @ components.T - np.eye(d)).max() < 1e-12
    assert np.allclose(components.T * values @ components, a, rtol=1e-12, atol=1e-12 * np.abs(a).max())
