"""Queries against their SQL twins on the smallest tables; helpers against brute force; sources and streams."""

import json
import numbers
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinetrace.operators import relational as r
from kinetrace.plans import registries
from kinetrace.plans.views import world_at, world_between
from kinetrace.sources import documents
from kinetrace.streaming.stateful import count_repetitions, count_repetitions_batch, hysteresis

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = {name: query for x in registries() for name, query in x.queries.items()}
SQL = {name: sql for x in registries() for name, sql in x.sql.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if pd.isna(x):
        return None
    return float(x) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted(str(tuple(map(plain, row))) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = PLANS[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    if not len(got) and name == "risk_counts":  # a rollup of nothing is nothing in Spark
        return
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_query_runs(spark, name):
    assert PLANS[name](spark, SF).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 126


def test_hours_covered(spark):
    rng = random.Random(1)
    data = [(i, rng.uniform(0, 30), rng.uniform(0, 5)) for i in range(80)] + [(90, 3.0, 2.0), (91, 4.0, 0.0)]
    df = spark.createDataFrame([(i, a, a + d) for i, a, d in data], "id int, a double, b double")
    got = {(x.id, x.hour): x.overlap for x in r.hours_covered(df, "a", "b").collect()}
    want = {(i, h): min(a + d, h + 1) - max(a, h) for i, a, d in data for h in range(40) if min(a + d, h + 1) - max(a, h) > 0}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in got)


def test_overlapping_and_nearest(spark):
    rng = random.Random(2)
    make = lambda n: [(i, float(rng.randint(0, 40)), float(rng.randint(0, 40))) for i in range(n)]
    a, b = ([(i, min(x, y), max(x, y) + 1) for i, x, y in make(40)] for _ in "ab")
    schema = "id int, s double, e double"
    got = {(x.l_id, x.r_id) for x in r.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "s", "e", 3.0).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]}
    right = sorted({float(rng.randint(0, 100)) for _ in range(20)})
    left = [(i, rng.randint(0, 200) / 2) for i in range(60)]
    for later, cell in ((True, None), (False, None), (True, 7.0), (False, 0.5)):
        out = r.nearest(spark.createDataFrame([(1, i, t) for i, t in left], "k int, i int, t double"), spark.createDataFrame([(1, t, t) for t in right], "k int, t double, v double"), ["k"], "t", ["v"], later, 4.0, cell)
        for x in out.collect():
            best = min(right, key=lambda v: (abs(v - x.t), -v if later else v))
            assert x.v == (best if abs(best - x.t) <= 4 else None)


def test_sources(spark, tmp_path):
    row = {"camera_id": "cam1", "frame": 1, "t_local": 0.5, "local_track_id": 3, "bbox": [1, 2, 3, 4], "det_conf": 0.9, "floor_point_px": [2, 4], "floor_method": "ankles"}
    (tmp_path / "raw.jsonl").write_text(json.dumps(row) + "\n")
    got = documents.raw_observations(spark, str(tmp_path / "raw.jsonl")).first()
    assert got.floor_point_px_raw == [2.0, 4.0] and got.keypoints is None
    for version in (1, 2):
        camera = {"camera_id": "cam1", "homography": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}
        (tmp_path / f"c{version}.json").write_text(json.dumps({"schema_version": version, "cameras": [camera]}))
    assert documents.calibrations(spark, str(tmp_path / "c1.json")).first().camera_id == "cam1"
    with pytest.raises(Exception, match="unsupported schema_version"):
        documents.calibrations(spark, str(tmp_path / "c2.json")).collect()
    known = documents.calibrations(spark, str(tmp_path / "c1.json"))
    assert documents.homographies(known).first().h4 == 1.0 and documents.camera_homography(known, "cam1")[0] == [1.0, 0.0, 0.0]
    with pytest.raises(KeyError):
        documents.camera_homography(known, "cam9")
    document = {"video": "v", "fps": 30.0, "frames": [{"i": 0, "t": 0.0, "people": [{"id": 4, "box": [1, 2, 3.6, 4], "score": 0.9, "kp": [[5, 6, 0.9], [7, 8, 0.1]]}]}, {"i": 1, "t": 0.1, "people": []}]}
    (tmp_path / "tracks.json").write_text(json.dumps(document))
    poses = documents.pose_tracks(spark, str(tmp_path / "tracks.json"))
    assert [x.track for x in poses.collect()] == [4]
    assert documents.overlay_rows(poses).first().row == [4, 1, 2, 4, 4, 5, 6, -1, -1]
    frames = spark.createDataFrame([(i, i / 10) for i in range(10)], "frame long, t_local double")
    assert [x.frame for x in documents.frame_subset(frames, 3, 0.6).collect()] == [0, 3, 6]
    documents.export_segments(spark.createDataFrame([(i, 1) for i in range(20)], "tick long, x int"), {"a": (0.4, 1.0)}, str(tmp_path / "seg"))
    assert sorted(x.tick for x in spark.read.json(str(tmp_path / "seg/a")).collect()) == [2, 3, 4, 5]
    for name in ("a.mov", "b.mp4", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = documents.first_videos(spark, str(tmp_path), {"cam1": "*.m*"}).first()
    assert os.path.basename(found.path) == "b.mp4"
    documents.write_by_camera(spark.createDataFrame([("cam1", 1), ("cam2", 2)], "camera_id string, n int"), str(tmp_path / "out"))
    assert sorted(x.n for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_world_queries(spark):
    frames = spark.createDataFrame([(i, i % 2) for i in range(10, 40, 2)], "tick long, x int")
    tick = lambda t: world_at(frames, t).first().tick
    assert (tick(0.0), tick(2.2), tick(99.0), tick(4.0)) == (10, 12, 38, 20)
    assert sorted(x.tick for x in world_between(frames, 2.0, 4.0, 2).collect()) == [10, 14, 18]
    with pytest.raises(ValueError):
        world_between(frames, 0, 601)


def test_stream_counts_as_the_table(spark, tmp_path):
    rng = random.Random(4)
    data = [(k, float(i), rng.uniform(0, 180)) for k in range(3) for i in range(60)]
    schema = "key long, t double, angle double"
    for part in range(3):
        spark.createDataFrame([x for x in data if x[1] // 20 == part], schema).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    running = count_repetitions(stream, 60, 120).writeStream.format("memory").queryName("reps").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    got = {x.key: x.reps for x in spark.table("reps").groupBy("key").agg(F.max("reps").alias("reps")).collect()}
    twin = {x.key: x.reps for x in count_repetitions_batch(spark.createDataFrame(data, schema), 60.0, 120.0).collect()}
    assert got == twin == {k: hysteresis((False, 0), (a for q, _, a in data if q == k), 60, 120)[1] for k in range(3)}


def test_stream_of_identities_as_the_table(spark, tmp_path):
    from kinetrace.operators.people import world
    from kinetrace.streaming.stateful import resolve_identities

    rows = [("s", t, f"cam{c}:{k}", f"cam{c}", 1 + 0.1 * t + k * 5, 2.0, 0.2, False) for t in range(80) for c in (1, 2) for k in range(2)]
    schema = "site string, tick long, key string, camera string, x double, y double, sigma double, edge boolean"
    ends = [0, 23, 41, 60, 80]  # the last row of a part comes with the next one, so ticks are dealt over batches
    for part in range(4):
        mine = [r_ for i, r_ in enumerate(rows) if 4 * ends[part] - (part > 0) <= i < 4 * ends[part + 1] - (part < 3)]
        mine += [("s", None, None, None, None, None, None, None)] * (part == 3)  # the end of the recording
        spark.createDataFrame(mine, schema).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
    want = {(x.tick, x.person, x.cameras) for x in world(spark.createDataFrame(rows, schema)).collect()}
    for emit in ("people", "events"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in*"))
        found = resolve_identities(stream, emit)
        running = found.writeStream.format("memory").queryName(emit).outputMode("append").option("checkpointLocation", str(tmp_path / emit)).start()
        running.processAllAvailable()
        if emit == "people":
            got = {(x.tick, x.person, x.cameras) for x in spark.table(emit).collect()}
            assert got == want
        else:
            events = [(x.type, x.first, x.second) for x in spark.table(emit).collect()]
            assert {e for e in events if e[0] == "cross_camera_link"} == {("cross_camera_link", "cam1:0", "cam2:0"), ("cross_camera_link", "cam1:1", "cam2:1")}
            assert not any(e[0] == "late_row" for e in events)
        running.stop()
