"""Nearest rows by pivots against brute force, with ties, and how many distances they take."""

import numpy as np
import pytest

from vanewright.operators import anomaly as A


def brute(x, q, k, own=False):
    near, far = [], []
    for i, row in enumerate(q):
        d = A.distances(x, row)
        if own:
            d[i] = np.inf
        order = np.lexsort((np.arange(len(x)), d))[:k]
        near.append(order)
        far.append(d[order])
    return np.array(near), np.array(far)


def tables():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 5)) * 50
    yield "clusters", centres[rng.integers(12, size=900)] + rng.normal(size=(900, 5))
    yield "grid of ties", rng.integers(0, 4, size=(700, 3)).astype(float)
    yield "one point many times", np.concatenate((np.ones((400, 4)), rng.normal(size=(60, 4))))
    yield "all the same", np.full((50, 3), 7.25)
    yield "far from the origin", rng.normal(size=(300, 6)) + 1e6
    yield "scales apart", rng.normal(size=(400, 4)) * [1e-6, 1, 1e3, 1e5]
    yield "two rows", np.array([[0.0, 1.0], [2.0, 3.0]])


@pytest.mark.parametrize("name, x", list(tables()))
@pytest.mark.parametrize("k", [1, 7, 35])
def test_neighbours_are_those_of_brute_force(name, x, k):
    k = min(k, len(x) - 1)
    rng = np.random.default_rng(4)
    q = np.concatenate((x[:80], x[rng.integers(len(x), size=60)] + rng.normal(size=(60, x.shape[1])), rng.normal(size=(20, x.shape[1])) * 1e4))
    index = A.NearestRows(x)
    for asked, own in ((q, False), (x, True)):
        near, far = index.nearest(asked, k, own)
        want, want_far = brute(x, asked, k, own)
        assert np.array_equal(far, want_far) and np.array_equal(near, want)
    # no matter how queries come in batches
    parts = [index.nearest(q[i : i + 13], k, block=5) for i in range(0, len(q), 13)]
    assert np.array_equal(np.concatenate([p[0] for p in parts]), index.nearest(q, k)[0])


def test_rings_save_distances():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 20
    made = lambda n: centres[rng.integers(40, size=n)] + rng.normal(size=(n, 16))
    x, q = made(5000), made(2000)
    index = A.NearestRows(x)
    index.nearest(q, 35)
    assert index.compared < 0.2 * len(x) * len(q)


def test_scores_by_definition_and_odd_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    bad = np.array([[np.nan, 0, 0, 0], [np.inf, 0, 0, 0], [1e200, 0, 0, 0]])
    factor = A.OutlierFactor(np.concatenate((bad, x)), 20)
    near, far = brute(x, x, 20, True)
    density = 1 / (np.maximum(far, far[:, -1][near]).mean(1) + 1e-10)
    q = rng.normal(size=(50, 4)) * 2
    to, d = brute(x, q, 20)
    want = density[to].mean(1) * (np.maximum(d, far[:, -1][to]).mean(1) + 1e-10)
    got = factor.score(np.concatenate((q, bad)))
    assert got[:50] == pytest.approx(want) and np.isnan(got[50:]).all()
    assert factor.score(q[:0]).shape == (0,)
    for few in (x[:0], x[:1], np.zeros(0)):
        assert np.isnan(A.OutlierFactor(few).score(q)).all()
    assert np.isfinite(A.OutlierFactor(x[:2]).score(q)).all()
