import numpy as np
import pytest

from pitlake.llm import whitening


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1.5, "a") for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, whitened double, n string")


def plain(vectors, top=32):
    """By a dense solver: (n, deviations, whitened up to sign, explained)."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    z = x - s / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:top], u[:, ::-1][:, :top]
    return n, ((n * x - s) ** 2).sum(1), z @ u / np.sqrt(e), e / np.trace(z.T @ z / n)


def held(df):
    rows = df.orderBy("vec_id", "component").collect()
    k = max(r.component for r in rows)
    return rows, np.array([r.whitened for r in rows]).reshape(-1, k), k


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(400, 40)) * np.linspace(0.5, 4, 40)).tolist()
    rows, w, k = held(whitening.whiten(frame(spark, vectors)))
    n, dev, ref, share = plain(vectors)
    assert k == 32 and {r.n for r in rows} == {400}
    assert [r.deviation for r in rows[::k]] == dev.tolist()
    sign = np.sign((w * ref).sum(0))
    assert np.allclose(w, ref * sign, rtol=0, atol=1e-9)
    assert np.allclose([r.explained for r in rows[:k]], share, rtol=1e-10)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-9
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("spectrum", [2.0 ** -np.arange(40), np.repeat([4.0, 3, 3, 1], 10), 1 + 1e-9 * np.arange(40), np.r_[np.ones(39), 1e6]])
def test_spectra(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(40, 40)))
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.components(v, 32)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(v))[::-1][:32], rtol=0, atol=1e-13 * spectrum.max())
    assert np.abs(u.T @ u - np.eye(32)).max() < 1e-13 and np.abs(v @ u - u * e).max() < 1e-11 * spectrum.max()
    tri = whitening.tridiagonal(v)
    for bound in (0.0, 0.99, 1.0000000005, 2.5, 1e7):
        assert whitening.below(tri, bound) == pytest.approx((np.linalg.eigvalsh(v) < bound).sum(), abs=0 if bound != 1.0000000005 else 1)


def test_odd_rows(spark):
    good = [[1.0, 2.0], [2.0, 0.5], [0.25, -1.0], [2.0, 0.5]]
    odd = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    df = frame(spark, good + odd, [5, 1, None, 1] + list(range(20, 27)))
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 and {r.n for r in rows} == {4} and {r.component for r in rows} == {1, 2}
    same = [r for r in rows if r.vec_id == 1]
    assert len(same) == 4 and len({(r.component, r.whitened, r.deviation) for r in same}) == 2
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, odd[:5])).count() == 0


def test_without_variance(spark):
    rows = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(rows) == 6 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in rows} == {(None, None, None, 0)}
    flat = whitening.whiten(frame(spark, [[1.0, 2.0], [3.0, 2.0]])).collect()
    assert sorted((r.component, r.explained, None if r.whitened is None else abs(r.whitened)) for r in flat)[::2] == [(1, 1.0, 1.0), (2, 0.0, None)]


def test_large_numbers_stay_exact(spark):
    for c in (1.9e7, 3.0e6):
        vectors = [[c, 3.0], [-c, 4.0]]
        rows = whitening.whiten(frame(spark, vectors)).collect()
        x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64).astype(object) + 1_000_000
        assert {(r.vec_id, r.deviation) for r in rows} == set(enumerate(((2 * x - x.sum(0)) ** 2).sum(1).tolist()))
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whiten(frame(spark, [[4e7, 3.0], [-4e7, 4.0]])).collect()
