"""Whitening against plain numpy and exact integers, with the edge cases of the docstring."""

import math
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
SCHEMA = "vec_id bigint, embedding array<double>, label int, v string"


def plain(rows):
    """(n, deviations, eigenvalues, covariance) of the vectors that count."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    dev = [(i, sum((n * x[j] - sums[j]) ** 2 for j in range(d))) for i, x in kept]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for _, x in kept])
    cov = centred.T @ centred / n
    return n, dev, np.linalg.eigvalsh(cov)[::-1], cov, centred


def make(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) * np.linspace(3, 0.2, d) + 5).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("n, d", [(300, 40), (50, 7), (20, 33)])
def test_matches_numpy(spark, n, d):
    from ledgerwise.llm.whitening import whiten

    rows = make(n, d)
    got = whiten(frame(spark, rows).repartition(5)).collect()
    count, dev, values, _, centred = plain(rows)
    k = min(32, d, n - 1)
    assert len(got) == n * k and {(r.vec_id, r.deviation) for r in got} == set(dev) and {r.n for r in got} == {count}
    for r in got:
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9
    w = np.zeros((n, k))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-9)
    # whitened vectors span the components: w / sqrt(e) maps back to eigenvectors of the covariance
    u = centred.T @ w / n / np.sqrt(values[:k])
    cov = centred.T @ centred / n
    assert np.allclose(cov @ u, u * values[:k], atol=1e-7 * values[0]) and np.allclose(u.T @ u, np.eye(k), atol=1e-9)


def test_factor_and_rotations():
    from ledgerwise.llm.whitening import jacobi, pivoted_cholesky

    rng = np.random.default_rng(2)
    b = rng.normal(size=(30, 12))
    a = b @ b.T  # rank 12
    g = pivoted_cholesky(a)
    assert g.shape == (30, 12) and np.allclose(g @ g.T, a)
    assert all(np.count_nonzero(np.abs(g[:, k]) > 1e-12) <= 30 - k for k in range(12))  # a triangle but for the row order
    values, vectors = jacobi(g)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:12]) and np.allclose(vectors.T @ vectors, np.eye(12))
    assert pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0) and jacobi(np.zeros((3, 0)))[0].size == 0


def test_products_are_exact():
    from ledgerwise.llm.whitening import exact_products

    x = np.array([[1 << 40, 3], [-(1 << 40) + 1, 5], [7, -2]])
    o = x.astype(object)
    assert (exact_products(x) == o.T @ o).all()


def test_edges(spark):
    from ledgerwise.llm.whitening import whiten

    rows = make(12, 3)
    odd = [(None, rows[0][1]), (0, rows[0][1]), (90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]),
           (93, [float("inf"), 0.0, 0.0]), (94, []), (95, [1.0, 2.0])]
    got = whiten(frame(spark, rows + odd)).collect()
    assert len(got) == 14 * 3 and {r.vec_id for r in got} == {None, *range(12)}
    assert dict(plain(rows + odd[:2])[1])[5] == next(r.deviation for r in got if r.vec_id == 5)
    assert whiten(frame(spark, rows[:1])).collect() == [] and whiten(frame(spark, rows[:1] * 4)).collect() == []
    empty = whiten(frame(spark, rows).limit(0))
    assert empty.collect() == [] and empty.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    huge = whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 4.0])])).collect()
    assert len(huge) > 0 and {r.deviation for r in huge if r.vec_id == 1} == {None}
