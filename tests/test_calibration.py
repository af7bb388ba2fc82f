"""Robust least squares by aggregates: known curves and cameras, with outliers."""

import numpy as np
from pyspark.sql import functions as F

from kinetrace.operators.calibration import Block, Problem, ground, least_squares, pixel

LINE = Problem((-100.0, -100.0), (100.0, 100.0), (1e-4, 1e-4), scale=0.5)


def test_lines_with_outliers(spark):
    rng = np.random.default_rng(2)
    true = {"one": (2.0, -1.0), "two": (-0.5, 7.0)}
    rows = [(key, float(x), float(a * x + b + rng.normal(0, 0.05) + (30 if i % 8 == 0 else 0))) for key, (a, b) in true.items() for i, x in enumerate(rng.uniform(-5, 5, 80))]
    frame = spark.createDataFrame(rows, "key string, x double, y double")
    starts = spark.createDataFrame([(key, s, [float(s), 0.0]) for key in true for s in range(5)], "key string, start int, p array<double>")
    log = []
    found = least_squares(LINE, starts, [Block(frame, lambda p, r: [p[0] * r["x"] + p[1] - r["y"]], (0, 1))], log=lambda *x: log.append(x)).collect()
    assert {r.key for r in found} == set(true) and log[-1][1] < 3e-5
    for r in found:
        assert np.allclose(r.p, true[r.key], atol=0.1)


def test_bounds_hold(spark):
    frame = spark.createDataFrame([("k", float(x), 500.0 * x) for x in range(10)], "key string, x double, y double")
    starts = spark.createDataFrame([("k", 0, [1.0, 0.0])], "key string, start int, p array<double>")
    found = least_squares(LINE, starts, [Block(frame, lambda p, r: [p[0] * r["x"] + p[1] - r["y"]], (0, 1))], most=12).first()
    assert all(-100 <= v <= 100 for v in found.p) and found.p[0] > 99


def test_nothing_to_fit(spark):
    frame = spark.createDataFrame([], "key string, x double, y double")
    starts = spark.createDataFrame([], "key string, start int, p array<double>")
    assert least_squares(LINE, starts, [Block(frame, lambda p, r: [p[0] * r["x"] + p[1] - r["y"]], (0, 1))]).count() == 0


def test_a_pixel_and_its_floor_point_belong_together(spark):
    p = [F.lit(v) for v in (900.0, 0.5, 0.07, 4.0)]
    rows = spark.createDataFrame([(x, y) for x in (-3.0, 0.0, 4.0) for y in (3.0, 8.0, 20.0)], "x double, y double")
    u, v = pixel(p, F.col("x"), F.col("y"), F.lit(0.0), F.lit(640.0), F.lit(360.0))
    gx, gy = ground(p, F.col("u"), F.col("v"), F.lit(640.0), F.lit(360.0))
    for r in rows.select("x", "y", u.alias("u"), v.alias("v")).select("x", "y", gx.alias("gx"), gy.alias("gy")).collect():
        assert abs(r.x - r.gx) < 1e-9 and abs(r.y - r.gy) < 1e-9
