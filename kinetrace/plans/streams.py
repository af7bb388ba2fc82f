"""Streaming queries run to completion over the events as files; each has the oracle of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.functions.scalars import half_up
from kinetrace.plans.registry import Registry
from kinetrace.sources.tables import load
from kinetrace.sources.work import new_folder
from kinetrace.streaming.stateful import count_repetitions_batch, lifecycle, on_each_batch, session_counts, tick_counts

query = Registry()


def event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream of files; the schema is that of the table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*events*").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is and returns its result table, which executors write; the driver sees none of it."""
    spark = stream.sparkSession
    folder, last = new_folder(spark, "stream"), []

    def keep(rows: DataFrame, batch: int) -> None:
        path = f"{folder}/result/{batch}"
        rows.write.mode("overwrite").parquet(path)
        last[:] = [path] if mode == "complete" else [*last, path]

    on_each_batch(stream, keep, f"{folder}/checkpoint", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_ticks(spark, sf_dir):
    """Hourly counts of a stream, updated as rows arrive."""
    n = drained(tick_counts(event_stream(spark, sf_dir), "ts", "1 hour", "10 minutes", ["event_type"]), "complete")
    return n.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query(
    """WITH g AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT, 0) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def stream_sessions(spark, sf_dir):
    """Sessions of each user that end after six hours."""
    s = drained(session_counts(event_stream(spark, sf_dir), "ts", "6 hours", "10 minutes", ["user_id"]), "complete")
    return s.select("user_id", F.unix_micros("start").alias("start"), "n")


@query(
    """WITH c AS (SELECT user_id AS key, ts, event_id, CASE WHEN value < 120 THEN -1 WHEN value > 380 THEN 1 END AS side FROM events),
    k AS (SELECT key, side, lag(side) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM c WHERE side IS NOT NULL)
    SELECT u.key, count(*) FILTER (side = 1 AND before = -1) AS reps FROM (SELECT DISTINCT user_id AS key FROM events) u LEFT JOIN k ON k.key = u.key GROUP BY u.key"""
)
def hysteresis_reps(spark, sf_dir):
    """Repetitions of a signal that must fall below one level and rise above another."""
    e = load(spark, sf_dir, "events")
    return count_repetitions_batch(e.select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("t"), F.col("value").alias("angle")), 120.0, 380.0)


@query(
    """WITH l AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts))) / 3.6e9 AS unseen, max(value) / 500 AS c FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY user_id)
    SELECT user_id, CASE WHEN unseen <= 0 THEN 'active' WHEN unseen <= 5 THEN 'occluded' ELSE 'exited' END AS state, floor(CASE WHEN unseen <= 0 THEN c ELSE c * exp(-unseen / 5) END * 1e4 + 0.5) / 1e4 AS confidence FROM l WHERE unseen <= 7"""
)
def identity_lifecycle(spark, sf_dir):
    """Occlusion and exit by time since the last observation."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    e = load(spark, sf_dir, "events").where(F.col("ts") <= now)
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"), (F.max("value") / 500).alias("confidence"))
    unseen = ((F.unix_micros(now) - F.unix_micros("last")) / 3.6e9).alias("unseen")
    seen = last.select("user_id", "confidence", (-unseen).alias("last_t"))
    return lifecycle(seen, F.lit(0.0)).select("user_id", "state", half_up(F.col("confidence"), 4).alias("confidence"))
