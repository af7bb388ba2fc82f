"""Scans, sinks and views of recordings on small made-up ones."""

import json

import pytest
from pyspark.sql import functions as F

from kinetrace.plans import recordings as views
from kinetrace.sources import recordings as r
from kinetrace.sources.documents import RAW


def test_recording_is_read_lazily(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "tick long, people int").write.parquet(str(tmp_path / "run/frames"))
    spark.createDataFrame([("cam1", 1), ("cam2", 2)], "camera_id string, n int").write.partitionBy("camera_id").parquet(str(tmp_path / "run/cameras"))
    run = r.Recording(spark, str(tmp_path / "run"))
    assert run.frames().first().people == 2 and run.camera_rows("cam2").first().n == 2
    with pytest.raises(KeyError):
        run.camera_rows("cam9")
    with pytest.raises(FileNotFoundError):
        r.Recording(spark, str(tmp_path / "none")).frames()


def test_outputs(spark, tmp_path):
    events = spark.createDataFrame([("link", 1), ("link", 2), ("merge", 3)], "type string, tick long")
    rows = spark.createDataFrame([("cam1", 4, i / 10, f"c{i}" if i % 2 else None) for i in range(20)], "camera_id string, local_track_id long, t_local double, crop string")
    r.write_outputs(events, rows, str(tmp_path / "out"))
    tracklet = spark.read.json(str(tmp_path / "out/tracklets")).first()
    assert (tracklet.n, tracklet.first_s, tracklet.last_s, tracklet.crops) == (20, 0.0, 1.9, ["c1", "c3", "c5", "c7", "c9", "c11"])
    metrics = spark.read.json(str(tmp_path / "out/metrics")).first()
    assert (metrics.observations, metrics.cameras, metrics.events.link, metrics.events.merge) == (20, 1, 2, 1)
    assert spark.read.json(str(tmp_path / "out/events")).count() == 3


def test_materialised_stage_is_reused(spark, tmp_path):
    built = []
    path = str(tmp_path / "stage")

    def build():
        built.append(1)
        return spark.range(len(built))

    assert [r.materialised(spark, path, build).count() for _ in range(2)] == [1, 1] and len(built) == 1
    assert r.materialised(spark, path, build, again=True).count() == 2


def test_live_rows_have_the_source_clock(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps({"camera_id": "cam1", "local_track_id": 1, "t_local": 2.5}) + "\n")
    stream = r.live_observations(spark, str(tmp_path / "in"), "2024-01-01 00:00:00")
    running = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert str(spark.read.parquet(str(tmp_path / "out")).first().ts) == "2024-01-01 00:00:02.500000"


def figure(knee=0.0, sure=0.9):
    y = [100, 98, 98, 99, 99, 130, 130, 160, 160, 190, 190, 180, 180, 220, 220, 262, 262]
    return [[50.0 + (knee if i in (13, 14) else 0), float(v), sure] for i, v in enumerate(y)]


def test_standing_people(spark):
    base = {"camera_id": "cam1", "frame": 0, "local_track_id": 1, "floor_method": "ankles", "floor_point_px": [50.0, 262.0], "quality_flags": []}
    rows = [base | {"t_local": i / 10, "keypoints": figure()} for i in range(10)]
    bad = [{"keypoints": figure(knee=40.0)}, {"keypoints": figure(sure=0.4)}, {"keypoints": None}, {"keypoints": figure(), "floor_method": "knees"}, {"keypoints": figure(), "quality_flags": ["touches_frame_edge"]}]
    rows += [base | {"local_track_id": 2 + i, "t_local": 0.0} | change for i, change in enumerate(bad)]
    found = views.standing_samples(spark.createDataFrame([{c: x.get(c) for c in [f.split()[0] for f in RAW.split(", ")]} for x in rows], RAW))
    assert sorted((x.local_track_id, x.t_local) for x in found.collect()) == [(1, 0.0), (1, 0.5)]


def test_unknown_camera():
    with pytest.raises(KeyError):
        views.camera_range(None, "cam9", 0, 1)


def test_draws_equal_plain_arithmetic(spark):
    def plain(seed, i):
        a = (seed + (i + 1) * 0x6D2B79F5) % 2**32
        b = (a ^ a >> 15) * (a | 1) % 2**32
        c = b ^ (b + (b ^ b >> 7) * (b | 61)) % 2**32
        return (c ^ c >> 14) / 2**32

    got = spark.range(500).select("id", views.draw(7, F.col("id")).alias("u")).collect()
    assert all(x.u == plain(7, x.id) for x in got)
