"""Filters in stretches against the kernels over whole tracks; similarity search against all pairs; repetitions of made-up figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import filters as f
from kinetrace.operators import kernels as k
from kinetrace.plans import reps
from kinetrace.plans.world import most_similar


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(3)
    out = {}
    for key, n in enumerate([1, 2, 3, 4, 5, 7, 60, 150]):
        t = np.sort(rng.uniform(0, n * 1.3, n)).round(3)
        out[key] = (t, rng.normal(0, 5, n).round(3))
    return out


@pytest.mark.parametrize("stretch", [8, 4096])
def test_filters_equal_the_kernels(spark, samples, stretch):
    rows = [(key, float(t), float(x)) for key, (ts, xs) in samples.items() for t, x in zip(ts, xs)]
    grid = f.on_regular_grid(spark.createDataFrame(rows, "key int, t double, x double"), ["key"], "t", "x", 0.5, 2.0)
    out = f.smoothed(grid, ["key"], "y", "smooth", 7, stretch=stretch)
    out = f.rolling_mean(f.rolling_median(out, ["key"], "smooth", "slow", 9, stretch), ["key"], "smooth", "mean", 6, stretch)
    found = out.toPandas().sort_values(["key", "i"])
    for key, (t, x) in samples.items():
        mine = found[found.key == key]
        points = np.arange(t[0], t[-1] + 1e-9, 0.5)
        y = k.fill_missing(k.interpolate(points, t, x, np.isfinite(x), 2.0))
        smooth = k.savgol(y, 7, 2)
        assert mine.i.tolist() == list(range(len(points))) and (mine.n == len(points)).all()
        for column, want in (("y", y), ("smooth", smooth), ("slow", k.rolling_median(smooth, 9)), ("mean", k.rolling_mean(smooth, 6))):
            assert np.allclose(mine[column], want, atol=1e-9), (key, column)


def test_no_rows(spark):
    grid = f.on_regular_grid(spark.createDataFrame([], "key int, t double, x double"), ["key"], "t", "x", 0.5, 2.0)
    assert f.smoothed(grid, ["key"], "y", "smooth", 7).count() == 0


def test_most_similar_equals_all_pairs(spark, monkeypatch):
    from kinetrace.plans import world

    monkeypatch.setattr(world, "QUERY_BLOCK", 7)
    monkeypatch.setattr(world, "VECTOR_CELL", 30)
    rng = np.random.default_rng(1)
    e = rng.integers(-3, 4, (120, 4)).astype(float)  # many ties
    e[5] = 0
    rows = [(i, f"l{i % 3}", v.tolist()) for i, v in enumerate(e)]
    v = spark.createDataFrame([*rows, (200, "x", None)], "vec_id long, label string, e array<double>")
    got = {(r.a, r.k): (r.b, round(r.s, 9), r.la, r.lb) for r in most_similar(v, v.where("vec_id % 6 = 0"), 4).collect()}
    length = np.linalg.norm(e, axis=1)
    want = {}
    for a in range(0, 120, 6):
        others = [(-np.floor(float(e[a] @ e[b]) / (length[a] * length[b]) * 1e9 + 0.5), b) for b in range(120) if b != a and length[a] and length[b]]
        for place, (s, b) in enumerate(sorted(others)[:4], 1):
            want[a, place] = (b, f"l{a % 3}", f"l{b % 3}")
    assert {key: (b, la, lb) for key, (b, _, la, lb) in got.items()} == want


def test_figures_are_chains_of_limbs():
    n = 5
    angles = {"knee": np.linspace(0, 2, n), "arm": np.linspace(0, 1.5, n), "elbow": np.zeros(n)}
    body = reps.figure(angles, np.zeros(n))
    assert np.allclose(body[:, 5, 0], -body[:, 6, 0]) and (np.diff(body[:, 11, 1]) < 0).all()  # mirror images; hips sink as knees bend
    arm = np.linalg.norm(body[:, 7] - body[:, 5], axis=1)
    assert np.allclose(arm, reps.UPPER_ARM)


@pytest.mark.parametrize("what", ["jitter", "small", "unseen", "slow", "fast", "walker", "fidgeter"])
def test_repetitions_of_hard_figures(spark, what):
    """One figure that is hard to count in one way, beside the ordinary ones of the query."""
    from types import SimpleNamespace

    from kinetrace.operators.reps import count_sets

    person = SimpleNamespace(k=6, video=what, exercise=2, reps=8, more=0, passes=what == "walker", pace={"slow": 4.5, "fast": 1.1}.get(what, 2.3), height=70.0 if what == "small" else 260.0, breaks=False)
    rows = reps.detections_of(person)
    rng = np.random.default_rng(4)
    kp = np.stack([np.array(x) for x in rows.kp])
    if what == "jitter":
        kp[..., :2] += rng.normal(0, 0.012 * person.height, kp[..., :2].shape)
    if what == "unseen":
        kp[..., 2] = np.where(rng.random(kp.shape[:2]) < 0.2, 0.1, kp[..., 2])
    if what == "fidgeter":  # moves now and then, not evenly
        still = np.repeat(kp[:1], len(kp), 0) + rng.normal(0, 1.5, kp.shape) * [1, 1, 0]
        for at in (50, 95, 210):
            still[at : at + 20, 9:11, 1] -= np.hanning(20)[: len(still) - at, None] * 60
        kp = still
    rows["kp"] = [x.tolist() for x in kp]
    rows["box"] = [x.tolist() for x in rows.box]
    frame = spark.createDataFrame(rows, "video string, track long, t double, box array<double>, kp array<array<double>>")
    assert [r.reps for r in count_sets(frame).collect()] == ([] if what in ("walker", "fidgeter") else [8])
