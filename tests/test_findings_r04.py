"""Faults found in the fourth round, on tables made for them."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from test_findings_r03 import events

import __spark_entry__
from kinetrace.operators import intervals


def sorted_rows(spark, folder, name):
    """Rows of a query and of its SQL, which is read in order by one thread: so ties go to the first row."""
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = c.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(folder)).select(*want.columns).collect()
    return sorted(map(tuple, got)), sorted(want.fetchall())


def test_of_equal_boxes_the_camera_that_saw_first_counts(spark, tmp_path):
    kinds = ["view", "click", "signup", "error", "purchase"]
    events(tmp_path, [(i * 5 + j, i / 10 + j / 100, i, kinds[(i * (1 + i // 5) + j * (1 + i % 4)) % 5], 90.0, 1 + j % 2) for i in range(60) for j in range(5)])
    got, want = sorted_rows(spark, tmp_path, "cross_camera_sessions")
    assert got == want and [r[2] for r in got] == [kinds[i * (1 + i // 5) % 5] for i in range(60)]


def test_rows_without_a_camera_choose_none(spark, tmp_path):
    events(tmp_path, [(1, 1.0, 1, None, 90.0, 9), (2, 2.0, 1, "view", 60.0, 1), (3, 3.0, 2, None, 60.0, 1), (4, 4.0, 3, "view", None, 1), (5, 5.0, 3, "click", 30.0, 1)])
    got, want = sorted_rows(spark, tmp_path, "cross_camera_sessions")
    assert got == want


def test_all_tracks_of_the_two_groups_are_paired(spark, tmp_path):
    begin = {i: float(i * 7 % 24) for i in range(30)}
    events(tmp_path, [(i, t, i, "view", 150.0, 1) for i, t in begin.items()])
    got, want = sorted_rows(spark, tmp_path, "temporal_overlap_pairs")
    near = {(i, j) for i in range(0, 30, 2) for j in range(1, 30, 2) if abs(begin[i] - begin[j]) < 2.5}
    assert got == want and {r[:2] for r in got} == near and any(i % 10 != j % 10 - 1 for i, j in near)


def test_overlaps_of_odd_intervals_equal_their_sql(spark, tmp_path):
    draw = random.Random(3)
    hours, minutes = [0.0, 3.5, 4.0, 4.25, 8.0, 11.75, 12.0, -2.0], [0.0, 15.0, 30.0, 240.0, 1500.0, -45.0, None]
    (tmp_path / "made").mkdir()
    events(tmp_path / "made", [(i, draw.choice(hours), draw.randrange(12), "view", draw.choice(minutes), 1) for i in range(160)])
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 16 > 0 THEN event_id END AS event_id) FROM '{tmp_path}/made/events.parquet') TO '{tmp_path}/events.parquet'")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.sql(__spark_entry__.oracle_sql()["temporal_overlap_pairs"])
    got = __spark_entry__.queries()["temporal_overlap_pairs"](spark, str(tmp_path)).select(*want.columns)
    assert "JOIN" not in got._jdf.queryExecution().optimizedPlan().toString().upper()  # no row of an interval is shuffled
    rows = Counter(want.fetchall())
    assert Counter(map(tuple, got.collect())) == rows and any(None in r for r in rows) and any(r[2] < 0 for r in rows)


def test_packed_intervals_are_small_and_pairs_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(intervals, "PAIRS", 1000)
    r, n = np.random.default_rng(1), 40_000
    t, x = np.sort(r.integers(0, 10**11, n)) / 3.6e9, np.round(r.exponential(5, n), 2)
    columns = {"kind": pa.array(np.arange(n, dtype=np.int32) % 2), "id": pa.array(np.arange(n)), "t": pa.array(t), "x": pa.array(x)}
    (blocks,) = intervals._packed(4.0, 60.0)(iter([pa.record_batch(columns)]))
    assert sum(len(b) for c in ("id", "t", "x") for b in blocks[c].to_pylist()) < 13 * n  # of 24
    batches = list(intervals._of_cells(4.0, 60.0)(iter([blocks])))
    e = t + x / 60.0
    want = sum(int(((t[i] < e[1::2]) & (t[1::2] < e[i])).sum()) for i in range(0, n, 2))
    assert sum(b.num_rows for b in batches) == want and max(b.num_rows for b in batches) < 2000
