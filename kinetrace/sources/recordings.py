"""A processed recording on disk: its scan, its outputs, stages kept for reuse, and the same rows while they are still coming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.sources.documents import RAW

CROPS = 6


class Recording:
    """World frames and camera rows of a recording's folder (frames, cameras by camera_id); nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                raise FileNotFoundError(f"{self.folder} has no {name}") from error
            raise

    def frames(self) -> DataFrame:
        return self._read("frames")

    def camera_rows(self, camera_id: str) -> DataFrame:
        """The rows of one camera, from its own files; KeyError for one that is not there."""
        rows = self._read("cameras").where(F.col("camera_id") == camera_id)
        if rows.isEmpty():
            raise KeyError(camera_id)
        return rows


def write_outputs(events: DataFrame, observations: DataFrame, folder: str) -> None:
    """events: audit events as they are; tracklets: span, rows and the first crops of each; metrics: counts, one row."""
    events.write.mode("overwrite").json(f"{folder}/events")
    crop = F.when(F.col("crop").isNotNull(), F.struct("t_local", "crop"))
    tracklets = observations.groupBy("camera_id", "local_track_id").agg(
        F.min("t_local").alias("first_s"), F.max("t_local").alias("last_s"), F.count(F.lit(1)).alias("n"),
        F.transform(F.slice(F.array_sort(F.collect_list(crop)), 1, CROPS), lambda c: c["crop"]).alias("crops"),
    )
    tracklets.write.mode("overwrite").json(f"{folder}/tracklets")
    kinds = events.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("events"))
    counts = observations.agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("camera_id").alias("cameras"))
    counts.crossJoin(kinds).write.mode("overwrite").json(f"{folder}/metrics")  # one row each


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """A stage's table: read where it has been written before, else built and written.  A write that broke off does not count."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not again and mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def live_observations(spark: SparkSession, folder: str, started: str, late: str = "3 seconds") -> DataFrame:
    """Observations as their files come, with ``ts``, the source's own clock counted from ``started``, as event time; arrival does not matter."""
    rows = spark.readStream.schema(RAW).json(folder)
    micros = F.unix_micros(F.lit(started).cast("timestamp")) + (F.col("t_local") * 1_000_000).cast("long")
    return rows.withColumn("ts", F.timestamp_micros(micros)).withWatermark("ts", late)
