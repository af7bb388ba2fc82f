"""Kernels against brute force and known answers, without Spark."""

import itertools
import random

import numpy as np
import pytest

from kinetrace.operators import kernels as k


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    score = rng.normal(0, 5, (n, m)).round(2)
    found = k.assign(score)
    assert len(found) == min(n, m) == len({a for a, _ in found}) == len({b for _, b in found})
    small, wide = (score, range(m)) if n <= m else (score.T, range(n))
    best = max(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(wide, len(small)))
    assert sum(score[a, b] for a, b in found) == pytest.approx(best)


def test_interpolation_stops_at_gaps():
    t = np.array([0.0, 1.0, 4.0])
    y = k.interpolate(np.array([-1, 0, 0.5, 1, 2, 4, 5]), t, t * 2, np.ones(3, bool), 2.0)
    assert np.array_equal(y, [np.nan, 0, 1, 2, np.nan, 8, np.nan], equal_nan=True)
    assert k.fill_missing(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3]
    assert k.fill_missing(np.array([np.nan, np.nan])).tolist() == [0, 0]


def test_savgol_keeps_polynomials():
    x = np.arange(30.0)
    y = 0.3 * x**2 - x + 4
    assert np.allclose(k.savgol(y, 7, 2), y)
    assert np.allclose(k.rolling_median(np.ones(9), 5), 1) and np.allclose(k.rolling_mean(x, 1), x)


def test_peaks():
    x = np.array([0, 1, 3, 3, 3, 1, 0, 2, 0, 5, 0], float)
    at, base, height = k.peaks(x, 1, 0.5)
    assert at.tolist() == [3, 7, 9] and base.tolist()[0] == 0 and height.tolist() == [3, 2, 5]
    assert k.peaks(x, 4, 0.5)[0].tolist() == [3, 9]
    assert k.peaks(x, 1, 2.5)[0].tolist() == [3, 9]
    assert k.peaks(np.zeros(5), 1, 0.1)[0].tolist() == []


def test_periodicity_against_plain_sums():
    rng = np.random.default_rng(5)
    for n in (3, 20, 61):
        x = rng.normal(size=n)
        y = x - x.mean()
        lags = range(max(1, int(0.7 * 9)), min(n - 1, int(1.3 * 9) + 1) + 1)
        want = max([0.0, *(sum(y[i] * y[i + lag] for i in range(n - lag)) / sum(y * y) * n / (n - lag) for lag in lags)])
        assert k.periodicity(x, 9.0) == pytest.approx(want)
    assert k.periodicity(np.ones(50), 9.0) == 0.0


def test_thinning():
    assert k.thin(np.array([0, 0.5, 1.0, 1.4, 2.1]), 1.0).tolist() == [True, False, True, False, True]


def test_constrained_merging():
    assert k.merged(4, [(3, 0, 1), (2, 1, 2), (1, 2, 3)], {frozenset((0, 2))}) == [0, 0, 2, 2]


def test_homography_round_trip_and_grades():
    h = np.array([[0.02, 0.001, 0.5], [0.0005, 0.03, 1.0], [0.00001, 0.0001, 1.0]])
    px = np.random.default_rng(0).uniform(0, 600, (7, 2))
    world = k.projected(h, px)
    assert np.abs(k.projected(k.homography(px, world), px) - world).max() < 1e-6
    assert k.fit_report(k.homography(px, world), px, world)["grade"] == "good"
    four = px[:4] * 0.01 + 300
    assert k.fit_report(k.homography(four, k.projected(h, four)), four, k.projected(h, four))["grade"] == "weak"


def test_rigid_and_consensus():
    a = np.random.default_rng(1).normal(0, 5, (40, 2))
    c, s = np.cos(0.4), np.sin(0.4)
    b = a @ np.array([[c, s], [-s, c]]) + [1, 2]
    _, theta, shift = k.rigid(a, b)
    assert theta == pytest.approx(0.4) and np.allclose(shift, [1, 2])
    b[:10] += 20
    theta, _, n = k.ransac_rigid(a, b)
    assert theta == pytest.approx(0.4) and n == 30
