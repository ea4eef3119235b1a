"""Whitening against dense eigenvectors and exact integer sums, with awkward rows."""

import math

import numpy as np
import pytest

from verdictflow.llm import whitening as W


def brute(vectors, k=4):
    """(rows of integers, e, u, n, S) for vectors without bad entries."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    e, u = np.linalg.eigh(z.T @ z / n)
    return x, e[::-1][:k], u[:, ::-1][:, :k], e.sum(), n, sums


def check(found, ids, vectors, k=4, tol=1e-8):
    x, e, u, trace, n, sums = brute(vectors, k)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted(set(ids))
    sign = None
    for i, v in zip(ids, x, strict=True):
        got = by[i]
        assert sorted(got) == list(range(1, len(e) + 1))
        want = np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)]) @ u / np.sqrt(e)
        mine = np.array([got[c].whitened for c in sorted(got)])
        if sign is None:
            sign = np.where(np.abs(want) > 1e-3, np.sign(want * mine), 0)
        sign = np.where((sign == 0) & (np.abs(want) > 1e-3), np.sign(want * mine), sign)
        assert np.allclose(mine, want * np.where(sign == 0, 1, sign), atol=tol)
        for c, r in got.items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert abs(r.explained * trace / e[c - 1] - 1) < 1e-10 and r.identity_error < 1e-9


@pytest.mark.parametrize("d", [1, 2, 3, 5, 17, 64, 150])
def test_eigenpairs(d):
    """Flat, steep and repeated spectra; also beyond the size of the subspace."""
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for values in (np.linspace(1, 1.2, d), 0.5 ** np.arange(d), np.ones(d), np.r_[np.zeros(d - 1), 3.0], 1 + rng.random(d) ** 4):
        a = (basis * values) @ basis.T
        found, u = W.jacobi_davidson(lambda q: a @ q, d, 4)
        want = np.sort(values)[::-1][:4]
        assert np.allclose(found, want, atol=1e-13)
        assert np.abs(a @ u - u * found).max() < 1e-13 and np.abs(u.T @ u - np.eye(len(found))).max() < 1e-13


def test_minres_solves():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a, b = a + a.T, rng.normal(size=(30, 3))
    assert np.allclose(a @ W.minres(lambda x: a @ x, b, 200, 1e-13), b, atol=1e-8)


def test_codes():
    x = np.array([[0, 1, -1], [127, -128, 0], [128, 0, 0], [-2**31, 1, 2], [2**63 - 1, -2**63, 0]])
    codes = W.to_codes(x)
    assert [len(c) // 3 for c in codes] == [1, 1, 2, 4, 8]
    assert (W.from_codes(codes, 3) == x).all()


def test_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    found = W.op12_whitening(spark, sf)
    assert [c for c, _ in found.dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), [r[0] for r in rows], [r[1] for r in rows])


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, 1.0, -0.25]), (2, [-0.001, 0.0, 0.0]), (3, [-0.0, 0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]),
            (6, [100.0, -90.0, 5.0]), (7, [0.25, 0.0, 0.0])]
    bad = [(8, None), (9, [None, 1.0, 1.0]), (10, [nan, 1.0, 1.0]), (11, [1.0, inf, 1.0]), (12, [1.0, 1.0, -inf])]
    df = spark.createDataFrame([(i, v, 1, "x", b"c") for i, v in good + bad + good[:2]],
                               "vec_id long, embedding array<float>, n int, x string, code binary")
    found = W.whitened(df).collect()
    assert len(found) == (len(good) + 2) * 3
    check(found, [i for i, _ in good], [v for _, v in good], 3, 1e-6)
    short = spark.createDataFrame([(None, [0.5]), (2, [1.0, 2.0]), (3, [])], "vec_id long, embedding array<double>")
    assert sorted({str(r.vec_id) for r in W.whitened(short).collect()}) == ["2", "3", "None"]


def test_outlier(spark):
    rng = np.random.default_rng(0)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 6)))] + [(50, [1e6, -1e6, 3.0, 0.0, 0.0, 0.0])]
    found = W.whitened(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 51 * 4 and {r.identity_error < 1e-5 for r in found} == {True}
    assert sum(r.explained for r in found[:4]) < 1.0001


@pytest.mark.parametrize("vectors", [[], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [None]])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    assert W.whitened(df).collect() == []


def test_components_without_variance_and_huge_entries(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 1.0]), (1, [1.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in W.whitened(df).collect()) == [(0, 1, 2, 65536), (1, 1, 2, 65536)]
    df = spark.createDataFrame([(0, [0.0, 1e300]), (1, [1.0, -1e300])], "vec_id long, embedding array<double>")
    assert [(r.n, r.deviation) for r in W.whitened(df).collect()] == [(2, None)] * 2
