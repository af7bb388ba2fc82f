"""Loaders of the engine's tables; zone-less timestamps become UTC timestamps here and nowhere else."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Day 0 of the engine's clock.
EPOCH = "2024-01-01"
HOUR_US = 3_600_000_000


def utc(df: DataFrame) -> DataFrame:
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return utc(spark.read.parquet(f"{folder}/{name}.parquet"))


def visits(spark: SparkSession, folder: str, days: tuple[int, int] | None = None) -> DataFrame:
    """Visits from events: visit, member, zone, t (hours since EPOCH), day, start (hour of day), duration (hours), sets.

    ``days``, both ends included, is a filter on the stored timestamp, so it reaches the scan.
    """
    epoch = F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    if days:
        first, after = (F.lit(str(date.fromisoformat(EPOCH) + timedelta(days=d))).cast(events.schema["ts"].dataType) for d in (days[0], days[1] + 1))
        events = events.where((F.col("ts") >= first) & (F.col("ts") < after))
    e = utc(events).withColumn("us", F.unix_micros("ts") - epoch)
    return e.select(
        F.col("event_id").alias("visit"),
        F.col("user_id").alias("member"),
        F.col("event_type").alias("zone"),
        (F.col("us") / F.lit(float(HOUR_US))).alias("t"),
        F.floor(F.col("us") / F.lit(24.0 * HOUR_US)).cast("int").alias("day"),
        (F.pmod("us", F.lit(24 * HOUR_US)) / F.lit(float(HOUR_US))).alias("start"),
        (F.col("value") / 60).alias("duration"),
        F.get_json_object("props", "$.k").cast("int").alias("sets"),
    )


#: The same table for the oracle.
VISITS_SQL = f"""visits AS (
    SELECT event_id AS visit, user_id AS member, event_type AS zone, us / {float(HOUR_US)} AS t, floor(us / {24.0 * HOUR_US})::INT AS day,
        (us % {24 * HOUR_US}) / {float(HOUR_US)} AS start, value / 60 AS duration, json_extract(props, '$.k')::INT AS sets
    FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}') AS us FROM events))"""


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Members from the events' users: member, join_day (some before day 0)."""
    return load(spark, folder, "events").select(F.col("user_id").alias("member")).distinct().withColumn("join_day", (F.pmod("member", F.lit(21)) - 3).cast("int"))


MEMBERS_SQL = "members AS (SELECT DISTINCT user_id AS member, (user_id % 21 - 3)::INT AS join_day FROM events)"
