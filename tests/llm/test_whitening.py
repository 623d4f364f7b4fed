"""Whitening against exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np

from textloom.llm import whitening as w


def write(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as component", "'y' as whitened", "'z' as deviation").repartition(3).write.parquet(f"{path}/embeddings.parquet")


def exact(vectors):
    """x-vectors, n, sums and the covariance of float vectors in whole numbers and fractions."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    cov = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / Fraction(n**3) for j in range(d)] for i in range(d)]
    return x, n, sums, cov


def test_double_doubles_lose_nothing():
    random.seed(1)
    x = np.array([[random.randrange(1 << 52) for _ in range(3)] for _ in range(501)], float)
    high, low = w.sum_pairs(x, np.zeros_like(x))
    assert [int(h) + int(l) for h, l in zip(high, low, strict=True)] == [sum(int(r[i]) for r in x) for i in range(3)]
    y = np.array([[random.randrange(-900, 900) + 100000.0 for _ in range(4)] for _ in range(300)])
    mean = w.mean_pair(*w.sum_pairs(y, np.zeros_like(y)), len(y))
    high, low = w.outer_sum(y, mean)
    n, sums = len(y), [sum(int(r[i]) for r in y) for i in range(4)]
    for k, (i, j) in enumerate(zip(*np.triu_indices(4), strict=True)):
        want = Fraction(sum((n * int(r[i]) - sums[i]) * (n * int(r[j]) - sums[j]) for r in y), n * n)
        assert abs(Fraction(high[k]) + Fraction(low[k]) - want) <= abs(want) * Fraction(1, 10**28) + Fraction(1, 10**20)


def test_eigenvectors_to_double_precision():
    random.seed(2)
    q, _ = np.linalg.qr(np.array([[random.gauss(0, 1) for _ in range(12)] for _ in range(12)]))
    m = (q * (10.0 ** -np.arange(12))) @ q.T
    m = (m + m.T) / 2
    values, vectors = w.eigen(m, np.zeros_like(m))
    assert np.all(np.diff(values) <= 0) and np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-15
    v = vectors.astype(np.longdouble)
    assert np.abs(m.astype(np.longdouble) @ v - v * values).max() < 1e-15
    values, vectors = w.eigen(np.eye(5) * 3, np.zeros((5, 5)))  # equal eigenvalues
    assert np.allclose(values, 3) and np.allclose(vectors.T @ vectors, np.eye(5))


def test_op13(spark, tmp_path):
    random.seed(3)
    good = [[random.gauss(0, 0.2) * (1 + j) for j in range(10)] for _ in range(200)] + [[0.25] * 10] * 300
    ids = list(range(498)) + [None, 7]
    bad = [(600, None), (601, []), (602, [None] + [0.1] * 9), (603, [float("nan")] * 10), (604, [float("inf")] + [0.0] * 9), (605, [0.5] * 9), (606, [0.1] * 10 + [float("-inf")])]
    write(spark, tmp_path, [(i, v, 0) for i, v in zip(ids, good, strict=True)] + [(i, v, 1) for i, v in bad])
    x, n, sums, cov = exact(good)
    rows = w.op13_whitening(spark, str(tmp_path)).collect()
    assert len(rows) == 8 * len(good) and {r.n for r in rows} == {n}
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in rows if r.component == 1) == sorted((i is None, i or 0, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in zip(ids, x, strict=True))
    values, vectors = np.linalg.eigh(np.array(cov, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    z = np.array([[float(a - Fraction(s, n)) for a, s in zip(v, sums, strict=True)] for v in x])
    want = z @ vectors[:, :8] / np.sqrt(values[:8])
    for k in range(1, 9):
        found = {(r.vec_id, r.deviation): r.whitened for r in rows if r.component == k}
        mine = np.array([found[i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))] for i, v in zip(ids, x, strict=True)])
        sign = np.sign(mine @ want[:, k - 1])
        assert np.abs(mine * sign - want[:, k - 1]).max() < 1e-9
        assert abs(next(r.explained for r in rows if r.component == k) - values[k - 1] / values.sum()) < 1e-12
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-12


def test_few_entries_equal_rows_and_nothing(spark, tmp_path):
    write(spark, tmp_path / "a", [(i, [float(i % 5), 1.0], 0) for i in range(40)])  # the second entry has no variance
    rows = w.op13_whitening(spark, f"{tmp_path}/a").collect()
    assert sorted({(r.component, r.explained) for r in rows}) == [(1, 1.0), (2, 0.0)] and all(r.whitened == 0 for r in rows if r.component == 2) and rows[0].identity_error < 1e-12
    write(spark, tmp_path / "b", [(1, [0.5] * 3, 0)] * 4)
    rows = w.op13_whitening(spark, f"{tmp_path}/b").collect()
    assert len(rows) == 12 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in rows} == {(0.0, 0.0, 0.0, 0)}
    for k, none in enumerate(([], [(1, None, 0)], [(1, [None], 0), (2, [], 0)])):
        write(spark, tmp_path / f"n{k}", none)
        assert w.op13_whitening(spark, f"{tmp_path}/n{k}").count() == 0


def test_deviation_beyond_a_long_is_null():
    model = w.Whitener(10**7, (10**12,), np.array([[1e5], [0.0]]), np.ones((1, 1)), np.ones(1), 1.0)
    assert model.deviation(np.array([[100000.0], [101000.0], [100001.0]])) == [0, None, 10**14]
