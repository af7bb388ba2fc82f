"""Tables that are changed by key: rows are dealt into buckets of their key, and a change rewrites only the buckets it touches.

A bucket is a partition folder.  A change reads the touched buckets, writes their new rows to a folder of its own and then
over the old ones, by Spark's dynamic partition overwrite; files of other buckets stay as they are.  What is overwritten
was written whole before, so a job that fails on the way can be run again: a change is the same when it is made twice.
One change at a time: there is no lock.

Defined results: nulls in keys are equal to each other; of several new rows of a key the last by ``order`` counts; a change
without rows touches nothing; ``update`` and ``delete`` return the changed and the deleted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators.relational import upsert
from kinetrace.sources.work import new_folder

BUCKET = "_bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        """Writes all rows; one file a bucket."""
        self._placed(rows).repartition(self.buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``; there are at most ``buckets``."""
        return [r[0] for r in self._placed(rows).select(BUCKET).distinct().collect()]

    def _within(self, touched: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)

    def _rewrite(self, rows: DataFrame, touched: list[int]) -> None:
        """Puts ``rows`` in place of all rows of the touched buckets; a bucket that is left without rows is removed."""
        staged = new_folder(self.spark, "rewrite")
        self._placed(rows).repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(staged)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        files = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        filled = [b for b in touched if files.exists(hadoop(f"{staged}/{BUCKET}={b}"))]
        if filled:
            new = self.spark.read.schema(self.read().schema).option("basePath", staged).parquet(*[f"{staged}/{BUCKET}={b}" for b in filled])
            new = self._placed(new.select(*self.read().columns))
            new.repartition(self.buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for b in set(touched) - set(filled):
            files.delete(hadoop(f"{self.path}/{BUCKET}={b}"), True)
        files.delete(hadoop(staged), True)

    def upsert(self, new: DataFrame, order: str, merge: dict[str, Column]) -> None:
        """Merges ``new`` by key; see ``relational.upsert``."""
        touched = self._touched(new)
        if touched:
            self._rewrite(upsert(self._within(touched), new, self.keys, order, merge).select(*self.read().columns), touched)

    def update(self, where: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Sets columns of the rows whose key is in ``where``; returns those rows as they are now, in a table of its own."""
        touched = self._touched(where)
        if not touched:
            return self.read().limit(0)
        asked = where.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct().withColumn("_asked", F.lit(True))
        rows = self._within(touched).join(asked, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left")
        set_ = {c: F.when(F.col("_asked"), value).otherwise(F.col(c)) for c, value in values.items()}
        changed = rows.select(*[set_.get(c, F.col(c)).alias(c) for c in self.read().columns], "_asked")
        kept = new_folder(self.spark, "updated")
        changed.where("_asked").drop("_asked").write.parquet(kept)
        schema = self.read().schema
        self._rewrite(changed.drop("_asked"), touched)
        return self.spark.read.schema(schema).parquet(kept)

    def delete(self, where: DataFrame) -> DataFrame:
        """Removes the rows whose key is in ``where``; returns them, in a table of its own."""
        touched = self._touched(where)
        if not touched:
            return self.read().limit(0)
        asked = where.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        rows, schema, kept = self._within(touched), self.read().schema, new_folder(self.spark, "deleted")
        rows.join(asked, match, "left_semi").write.parquet(kept)
        self._rewrite(rows.join(asked, match, "left_anti"), touched)
        return self.spark.read.schema(schema).parquet(kept)
