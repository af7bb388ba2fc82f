"""Faults found in the third round, on tables made for them."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__
from kinetrace.operators import kernels


def table(folder, name, columns, rows):
    pd.DataFrame(rows, columns=columns.split()).to_parquet(f"{folder}/{name}.parquet")


def events(folder, rows):
    """Rows of event_id, hours since the first day, user_id, event_type, value, number of sets."""
    first = datetime.datetime(2024, 1, 1)
    rows = [(i, first + datetime.timedelta(hours=h), u, kind, value, '{"k": %d}' % k) for i, h, u, kind, value, k in rows]
    d = pd.DataFrame(rows, columns="event_id ts user_id event_type value props".split())
    d["ts"] = d.ts.astype("datetime64[us]")
    d.to_parquet(f"{folder}/events.parquet")


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got, want = __spark_entry__.queries()[name](spark, str(folder)).toPandas(), c.sql(__spark_entry__.oracle_sql()[name]).df()
    as_rows = lambda d: sorted(tuple(float(x) if isinstance(x, (int, float, np.number)) else str(x) for x in r) for r in d[sorted(want.columns)].itertuples(index=False))
    assert len(want) and as_rows(got) == as_rows(want)
    return got


def test_consensus_fits_all_samples_at_once(monkeypatch):
    px = np.random.default_rng(0).uniform(0, 600, (10, 2))
    world = kernels.projected(np.array([[0.02, 0.001, 0.5], [0.0005, 0.03, 1.0], [0.00001, 0.0001, 1.0]]), px)
    world[3] += 4.5
    calls, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **k: calls.append(1) or svd(*a, **k))
    error = np.linalg.norm(kernels.projected(kernels.homography(px, world), px) - world, axis=1)
    assert len(calls) == 2 and error[3] > 1 and np.delete(error, 3).max() < 1e-6
    world[5, 0] = np.nan
    assert np.isfinite(np.delete(kernels.projected(kernels.homography(px, world), px), 5, 0)).all()


def test_a_matrix_is_not_bent_for_a_wrong_point(spark, tmp_path):
    table(tmp_path, "supplier", "s_suppkey", [(k,) for camera in (100, 517, 529) for k in range(camera * 10, camera * 10 + 10)])
    same_as_sql(spark, tmp_path, "homography_check")


def test_draws_are_computed_once(spark):
    from kinetrace.plans import recordings

    rows = spark.range(300)
    got = recordings.drawn(rows, 7, F.col("id"))
    assert {x.id: x.u for x in got.collect()} == {x.id: x.u for x in rows.select("id", recordings.draw(7, F.col("id")).alias("u")).collect()}
    plan = __spark_entry__.queries()["members_and_visits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20000 and "lambda" not in plan


def test_the_next_row_is_found_by_a_frame_that_grows(spark):
    from kinetrace.operators.relational import nearest

    rows = spark.range(10).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.col("id").alias("v"))
    for cell in (None, 3.0):
        found = nearest(rows.select("k", "t"), rows.where("v % 4 = 0"), ["k"], "t", ["v"], cell=cell)
        assert "UNBOUNDED FOLLOWING" not in found._jdf.queryExecution().optimizedPlan().toString().upper().replace("UNBOUNDEDFOLLOWING", "UNBOUNDED FOLLOWING")
        assert {x.t: x.v for x in found.collect()} == {t: min((0, 4, 8), key=lambda v: (abs(v - t), -v)) for t in range(10)}


def test_boxes_meet_all_of_their_column(spark, tmp_path):
    rows = [(k, 3) for k in (1, 15301, 30601, 2, 401, 5102, 700, 1300)] + [(7, 4), (1500000, 3), (2500000, 3)]  # 1, 15301 and 30601 are equal boxes; late ids weigh in the order
    table(tmp_path, "customer", "c_custkey c_nationkey", rows)
    got = same_as_sql(spark, tmp_path, "iou_match")
    assert {1: 15301, 15301: 1}.items() <= dict(zip(got.a, got.b)).items()


def test_overlaps_across_rooms_and_days(spark, tmp_path):
    events(tmp_path, [(1, 23.5, 2, "view", 90.0, 1), (2, 24.25, 13, "view", 60.0, 1), (3, 24.0, 12, "view", 30.0, 1), (4, 24.0, 14, "view", 30.0, 1)])
    assert len(same_as_sql(spark, tmp_path, "temporal_overlap_pairs")) == 2


def test_late_visits_weigh_as_in_sql(spark, tmp_path):
    events(tmp_path, [(5, 1.0, 1, "view", 60.0, 3), (2_500_000, 2.0, 1, "view", 60.0, 1), (7, 1.0, 2, "view", 60.0, 3), (8, 2.0, 2, "view", 60.0, 1)])
    got = same_as_sql(spark, tmp_path, "least_covered")
    assert dict(zip(got.member, got.visit)) == {1: 5, 2: 8}


def test_rows_of_a_key_go_through_a_step_together(spark):
    from kinetrace.operators import calibration

    rows = spark.range(9000).select((F.col("id") % 2).alias("key"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    packs = calibration._packed(rows).collect()
    assert len(packs) < 20 and max(len(p.x) for p in packs) < 2 * calibration.PACK
    assert sorted((p.key, x, y) for p in packs for x, y in zip(p.x, p.y)) == sorted(map(tuple, rows.collect()))


def test_more_line_items_are_dealt_to_more_tasks(spark, monkeypatch):
    from kinetrace.plans import members

    folder = "/root/testdata/sf0.001"
    usual = {name: sorted(map(tuple, members.query.queries[name](spark, folder).collect())) for name in ("muscle_intensity", "workout_title", "last_trained")}
    monkeypatch.setattr(members, "TASK_ROWS", 500)
    assert members.sets(spark, folder).rdd.getNumPartitions() > 8
    for name, rows in usual.items():
        assert sorted(map(tuple, members.query.queries[name](spark, folder).collect())) == rows


def test_chains_are_followed_without_copies_through_the_driver(spark):
    from kinetrace.operators.matching import kept_apart

    rows = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("t"))
    kept = kept_apart(rows, ["k"], "t", 6.0)
    assert kept.count() == 3 * 34 - 1
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def written_for(spark, folder, monkeypatch, name):
    """The rows of a query on forty suppliers, and the bytes of its own files and of its shuffles."""
    from kinetrace.operators import reps

    table(folder, "supplier", "s_suppkey s_nationkey", [(k, k % 25) for k in range(40)])
    monkeypatch.setattr(reps, "new_folder", lambda spark, name, n=iter(range(99)): f"{folder}/own/{name}{next(n)}")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    rows = __spark_entry__.queries()[name](spark, str(folder)).collect()
    files = sum(os.path.getsize(f"{at}/{f}") for at, _, found in os.walk(f"{folder}/own") for f in found)
    return rows, files + shuffled() - before


def test_rep_counts_write_no_samples(spark, tmp_path, monkeypatch):
    rows, size = written_for(spark, tmp_path, monkeypatch, "rep_counts")
    assert len(rows) > 30 and size < 1_000_000  # the samples themselves are 7 MB
    monkeypatch.undo()
    os.rename(f"{tmp_path}/own", f"{tmp_path}-own")
    same_as_sql(spark, tmp_path, "rep_counts")


def test_rep_sets_equal_those_of_stored_detections(spark, tmp_path, monkeypatch):
    from kinetrace.operators.reps import count_sets
    from kinetrace.plans import reps

    rows, size = written_for(spark, tmp_path, monkeypatch, "rep_sets")
    assert size < 1_000_000
    monkeypatch.undo()
    assert sorted(map(str, rows)) == sorted(map(str, count_sets(reps.detections(spark, str(tmp_path))).collect()))


def test_windows_of_movement_are_solved_where_bounds_leave_it_open():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6, 20)) * rng.uniform(0, 1, (300, 6, 1)) ** 3
    a = np.r_[x @ x.transpose(0, 2, 1), np.zeros((1, 6, 6)), np.diag([2.0, 0, 0, 0, 0, 0])[None]]
    for limit in (0.5, 2.0, 8.0, 1000.0):
        assert (kernels.eigenvalue_over(a, limit) == (np.linalg.eigvalsh(a)[:, -1] > limit)).all()


def test_covariances_are_formed_only_where_variances_leave_it_open(monkeypatch):
    from kinetrace.operators import reps

    p, formed, solve = reps.Params(), [], kernels.eigenvalue_over
    monkeypatch.setattr(kernels, "eigenvalue_over", lambda a, limit: formed.append(len(a)) or solve(a, limit))
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(3000, 8)) * np.repeat([0.001, 0.1, 0.02, 0.001, 0.016, 0.04], 500)[:, None]
    windows = np.lib.stride_tricks.sliding_window_view(flat, 50, axis=0)
    want = [np.linalg.eigvalsh(np.cov(w))[-1] > p.energy**2 for w in windows]
    assert (reps._strong(flat, p) == np.array(want)[np.clip(np.arange(3000) - 25, 0, len(want) - 1)]).all()
    assert 0 < sum(formed) < 2000  # of 2951 windows


def test_medians_of_all_columns_are_found_together():
    x = np.random.default_rng(4).integers(0, 40, (3, 2500)) / 8
    for size in (1, 2, 5, 30, 31, 100):
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (size // 2, size - 1 - size // 2)), "edge"), size, axis=1)
        assert (kernels.rolling_median(x, size) == np.median(windows, axis=2)).all()


def test_more_suppliers_are_dealt_to_more_tasks(spark, monkeypatch):
    from kinetrace.plans import reps

    monkeypatch.setattr(reps, "TASK_ROWS", 5)
    assert reps.dealt(spark.range(100).select("id", F.col("id").alias("video"))).rdd.getNumPartitions() == 21


def test_session_documents_write_no_samples(spark, tmp_path, monkeypatch):
    import json

    rows, size = written_for(spark, tmp_path, monkeypatch, "session_documents")
    assert size < 1_000_000
    monkeypatch.undo()
    want = {}
    for x in __spark_entry__.queries()["rep_sets"](spark, str(tmp_path)).collect():
        want.setdefault(x.video, {}).setdefault(x.person, []).append((x.start_s, x.end_s, x.exercise, x.reps))
    got = {x.video: {p["person"]: [tuple(s.values()) for s in p["sets"]] for p in json.loads(x.document)["people"]} for x in rows}
    assert got == {video: {n: sorted(sets) for n, sets in people.items()} for video, people in want.items()}


def test_session_documents_keep_and_shuffle_only_what_they_hold(spark, tmp_path, monkeypatch):
    from kinetrace.operators import reps

    table(tmp_path, "supplier", "s_suppkey s_nationkey", [(k, k % 25) for k in range(6)])
    monkeypatch.setattr(reps, "new_folder", lambda spark, name: f"{tmp_path}/own/{name}")
    documents = __spark_entry__.queries()["session_documents"](spark, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/own/reps-options")
    assert not [c for c, kind in kept.dtypes if kind.startswith("array")]  # peaks are many times the rest, and no document has them
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan  # the sets are read once
    assert documents.count() == 3


def test_a_session_document_has_all_sets_and_totals(spark):
    import json

    from kinetrace.sources.documents import session_document

    sets = [("v", 0, "squat", 9.0, 12.0, 4), ("v", 0, "other", 20.0, 30.0, 5), ("v", 0, "squat", 1.0, 5.0, 3), ("v", 0, "squat", 1.0, 5.0, 3), ("v", 1, "other", 2.0, 6.0, 7), ("w", 0, "squat", 0.0, 4.0, 6)]
    found = session_document(spark.createDataFrame(sets, "video string, person int, exercise string, start_s double, end_s double, reps int"))
    one = lambda a, b, exercise, n: {"start_s": a, "end_s": b, "exercise": exercise, "reps": n}
    first = [one(1.0, 5.0, "squat", 3), one(1.0, 5.0, "squat", 3), one(9.0, 12.0, "squat", 4), one(20.0, 30.0, "other", 5)]
    assert {x.video: json.loads(x.document)["people"] for x in found.collect()} == {
        "v": [
            {"person": 0, "total_reps": 15, "exercises": {"other": 5, "squat": 10}, "sets": first},
            {"person": 1, "total_reps": 7, "exercises": {"other": 7}, "sets": [one(2.0, 6.0, "other", 7)]},
        ],
        "w": [{"person": 0, "total_reps": 6, "exercises": {"squat": 6}, "sets": [one(0.0, 4.0, "squat", 6)]}],
    }
