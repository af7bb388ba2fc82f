"""Changes by key against the same changes of a whole frame; files of untouched buckets stay."""

import os

from pyspark.sql import functions as F

from kinetrace.operators.relational import upsert
from kinetrace.sources.keyed import KeyedTable

SCHEMA = "k int, name string, n int, at int"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, f"n{i}", i % 5, 0) for i in range(200)] + [(None, "none", 1, 0)], SCHEMA)
    table = KeyedTable(spark, path, ["k"], 16)
    table.create(old)
    assert table.read().columns == old.columns and rows_of(table.read()) == rows_of(old)
    merge = {"n": F.col("old.n") + F.col("new.n"), "at": F.col("new.at")}
    new = spark.createDataFrame([(3, "again", 10, 1), (3, "last", 20, 2), (999, "fresh", 7, 1), (None, "also", 5, 1)], SCHEMA)
    before = files(path)
    table.upsert(new, "at", merge)
    want = rows_of(upsert(old, new, ["k"], "at", merge))
    assert rows_of(table.read()) == want and len(want) == 202
    kept = before & files(path)
    assert len(before) - 3 <= len(kept) < len(before)

    changed = table.update(spark.createDataFrame([(5,), (6,), (-1,)], "k int"), {"name": F.upper("name"), "n": F.col("n") + 100})
    assert rows_of(changed) == [(5, "N5", 100, 0), (6, "N6", 101, 0)]
    gone = table.delete(spark.createDataFrame([(5,), (None,), (77,)], "k int"))
    assert sorted(str(r.k) for r in gone.collect()) == ["5", "77", "None"]
    left = table.read()
    assert left.count() == 199 and left.where("k = 6").first().name == "N6" and left.where("k is null or k in (5, 77)").count() == 0

    before = files(path)
    nothing = spark.createDataFrame([], "k int")
    assert table.delete(nothing).count() == table.update(nothing, {"n": F.lit(0)}).count() == 0 and files(path) == before


def test_a_bucket_can_become_empty(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    rows = spark.createDataFrame([(i, "x", 1, 0) for i in range(12)], SCHEMA)
    table.create(rows)
    assert table.delete(rows.where("k < 11").select("k")).count() == 11
    assert [r.k for r in table.read().collect()] == [11]
