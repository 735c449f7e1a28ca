from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors):
    """Integers, their sums and covariance by Python's own numbers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(dim)]
    d = [[n * r[k] - s[k] for k in range(dim)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(dim)] for i in range(dim)])
    return x, s, [sum(v * v for v in r) for r in d], cov


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 24):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        values, rows = whitening.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12) and np.allclose(rows @ rows.T, np.eye(n), atol=1e-13)
        assert np.allclose(rows.T * values @ rows, a, rtol=1e-12)
    scale = np.diag([1.0, 1e-5, 1e-10])  # graded: the smallest is 20 orders below the largest
    base = np.array([[2.0, 0.5, 0.3], [0.5, 2.0, 0.4], [0.3, 0.4, 2.0]])
    values, _ = whitening.jacobi(scale @ base @ scale)
    determinant = np.linalg.det(base) * 1e-30
    assert values[2] > 0 and abs(np.prod(values) / determinant - 1) < 1e-12
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0] and whitening.jacobi(np.zeros((0, 0)))[0].size == 0


def test_agrees_with_exact_numbers(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(250, 12)) @ rng.normal(size=(12, 12))
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(mixed)] + [(3, mixed[3].astype(np.float32).tolist(), 0), (None, mixed[4].astype(np.float32).tolist(), 0)]
    odd = [(900, None, 0), (901, [1.0], 0), (902, [float("nan")] * 12, 0), (903, [None] + [0.0] * 11, 0), (904, [float("inf")] * 12, 0), (905, [], 0)]
    x, s, deviation, cov = exact([v for _, v, _ in rows])
    values, columns = np.linalg.eigh(cov)
    got = whitening.components(spark.createDataFrame(rows + odd, SCHEMA).repartition(3)).collect()
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)} and {r.component for r in got} == set(range(1, 9))
    assert sorted(r.deviation for r in got) == sorted(d for d in deviation for _ in range(8))
    for k in range(8):
        e, u = values[-1 - k], columns[:, -1 - k]
        want = {(i, round(abs(w), 8)) for (i, _, _), w in zip(rows, (np.array(x) - np.array(s) / len(x)) @ u / math.sqrt(e))}
        have = [r for r in got if r.component == k + 1]
        assert {(r.vec_id, round(abs(r.whitened), 8)) for r in have} == want
        assert all(abs(r.explained - e / values.sum()) < 1e-10 and r.identity_error < 1e-9 for r in have)
        signs = {np.sign(r.whitened * (np.array(x[r.vec_id]) - np.array(s) / len(x)) @ u) for r in have if r.vec_id is not None}
        assert len(signs) == 1


def test_equal_however_dealt(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, many = (whitening.fitted(d) for d in (df.coalesce(1), df.repartition(7)))
    assert (one.matrix == many.matrix).all() and one.sums == many.sums and one.n == 500


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, (30, 3))
    x[:20] //= 2**30
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(3)] for i in range(3)]
    assert whitening._products(x).tolist() == want
    model = whitening.Model(2, 3, [30, 3 * 2**39], [[6, 0], [0, 2 * 2**70]], 2)
    assert model.deviation(np.array([[10, 2**39], [11, 2**39]])).tolist() == [0, 9]
    assert model.deviation(np.array([[10, -(2**40)]])).tolist() == [2**63 - 1]


@pytest.mark.parametrize("rows, n, width", [([], 0, 0), ([(1, [0.5, 0.25], 0)], 1, 2), ([(k, [0.5, float(k)], 0) for k in range(4)], 4, 2), ([(1, [], 0)], 0, 0), ([(1, None, 0)], 0, 0)])
def test_small_tables(spark, rows, n, width):
    got = whitening.components(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", n int")).collect()
    assert len(got) == n * width and all(np.isfinite([r.whitened, r.explained, r.identity_error]).all() for r in got)
    if n == 4:
        assert {round(r.explained, 9) for r in got} == {1.0, 0.0} and {r.whitened for r in got if r.component == 2} == {0.0}


def test_extreme_components_and_clashing_names(spark):
    df = spark.createDataFrame([(k, [3e38 if k % 2 else -3e38, float(k)], "x", 1) for k in range(6)], "vec_id long, embedding array<float>, deviation string, component int")
    assert len(whitening.components(df).collect()) == 12


def test_query(spark):
    got = registry.queries()["op13_embedding_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 500 * 8 and got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide.T @ wide / 500, np.eye(8), atol=1e-9)
