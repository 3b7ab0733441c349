import numpy as np
import pytest

from loomtext.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, v string, component string, whitened int"


def _table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "v", "c", 3) for i, v in vectors], SCHEMA)


def _plain(vectors, most=32):
    """x, S, and per component (eigenvalue, direction) by a plain eigen-decomposition."""
    x = np.array([np.floor(64 * np.array([np.float32(c) for c in v], float)).astype(int) + 1_000_000 for _, v in vectors])
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return x, s, c, e[::-1][:most], q[:, ::-1][:, :most]


def _vectors(n=300, d=40, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.geomspace(5, 0.2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return [(i, v) for i, v in enumerate(base)]


def _compare(got, vectors, most=32):
    x, s, c, e, q = _plain(vectors, most)
    n = len(x)
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, len(e) + 1))
    for k, rows in by.items():
        white = np.array([rows[i].whitened for i, _ in vectors])
        want = c @ q[:, k - 1] / np.sqrt(e[k - 1])
        assert min(np.abs(white - want).max(), np.abs(white + want).max()) < 1e-8
        assert all(abs(r.explained / (e[k - 1] / (c**2).sum() * n) - 1) < 1e-9 for r in rows.values())
        for (i, _), far in zip(vectors, n * x - s):
            assert rows[i].deviation == sum(int(v) ** 2 for v in far) and rows[i].n == n and 0 <= rows[i].identity_error < 1e-9


def test_equals_plain_decomposition(spark):
    vectors = _vectors()
    _compare(W.whiten(_table(spark, vectors).repartition(5)).collect(), vectors)


def test_odd_rows(spark):
    vectors = _vectors(60, 6)
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [nan] * 6), (903, [1.0, None, 1, 1, 1, 1]), (904, [inf, 1, 1, 1, 1, 1]), (905, [1.0] * 5), (906, [1e30] * 6), (907, [-inf] + [0.0] * 5)]
    _compare(W.whiten(_table(spark, vectors + odd)).collect(), vectors)
    again = vectors + [(None, vectors[0][1]), (5, vectors[5][1])]  # repeated and null ids come back row by row
    got = W.whiten(_table(spark, again)).collect()
    assert len(got) == len(again) * 6 and sum(r.vec_id is None for r in got) == 6 and sum(r.vec_id == 5 for r in got) == 12


def test_empty_tables_and_vectors_without_spread(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        out = W.whiten(_table(spark, vectors))
        assert out.count() == 0 and out.columns == [c.split()[0] for c in W.COLUMNS.split(", ")]
    flat = [(i, [i, 2 * i, 5.0]) for i in range(20)]  # rank one
    got = W.whiten(_table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and abs(got[0].explained - 1) < 1e-12


def test_equal_eigenvalues(spark):
    """A basis of equal eigenvalues is free, the whitened covariance is not."""
    vectors = [(k, np.eye(8)[k % 8] * (1 if k < 8 else -1)) for k in range(16)]
    got = W.whiten(_table(spark, vectors)).collect()
    white = np.zeros((16, 8))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(white.T @ white / 16 - np.eye(8)).max() < 1e-10 and got[0].identity_error < 1e-10


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_components_are_eigenvectors(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for e in (np.geomspace(1, 1e-6, d), np.repeat(2.0, d), np.where(np.arange(d) < d // 2, 3.0, 1.0), np.arange(d) * 1.0, np.sort(rng.random(d)), np.zeros(d)):
        a = q * e @ q.T
        a = (a + a.T) / 2
        values, vectors = W.components(a)
        size = max(np.abs(e).max(), 1e-300)
        assert np.abs(values - np.sort(e)[::-1]).max() <= 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size


def test_polar_factor():
    rng = np.random.default_rng(1)
    for d in (1, 5, 30):
        a = rng.normal(size=(d, d))
        a = a + a.T
        u = W.polar_factor(a)
        e, q = np.linalg.eigh(a)
        assert np.abs(u - q * np.sign(e) @ q.T).max() < 1e-10
