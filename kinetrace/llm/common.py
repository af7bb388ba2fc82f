"""Shared helpers: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handled at once inside a task, in bytes; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20

_LOCAL_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the cluster, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder that goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        folder = tempfile.mkdtemp(prefix="kinetrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_DIRS[app] = f"file://{folder}"
    return _LOCAL_DIRS[app]


class Workspace:
    """Written intermediate tables below the shared folder; they cut lineage and survive lost executors."""

    made: list[Workspace] | None = None  # those made inside ``dropping_workspaces``

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if Workspace.made is not None:
            Workspace.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self) -> None:
        """Deletes all tables of this workspace; nothing may read them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropping_workspaces() -> Iterator[None]:
    """Deletes the workspaces made inside when it is left; their tables must have been used up by then."""
    outer, Workspace.made = Workspace.made, []
    try:
        yield
        for made in Workspace.made:
            made.drop()
    finally:
        Workspace.made = outer


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def salt(rows: DataFrame, on: list[str], copies: Column) -> Column:
    """A number below ``copies`` from the row's columns beside ``on``, so a row gets the same one whenever and wherever it is formed again."""
    others = [rows[f.name] for f in rows.schema.fields if f.name not in on and _hashable(f.dataType)]
    return F.pmod(F.xxhash64(*others), copies) if others else F.lit(0)


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, how: str = "inner", least: int = 1000, total: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``keys`` by the columns ``on``; a key of very many rows is dealt over many tasks.

    ``keys`` must have one row for each key, whose column ``count`` says how many rows have it (``total``: their sum, if
    known; ``counts``: a table of keys and counts, if it is cheaper to form than ``keys``), and come out the same each time it
    is computed; the result has all columns of both but not ``count``.  A key is hot if it has more than a quarter of an even task's share
    of all those rows, and more than ``least``, below which no task is worth sparing.  So at most 4 x shuffle partitions are hot, whatever the data, and only a hash and the number of
    copies of each goes to the driver, once, and is broadcast.  A hot key's row is copied once for each such share and its rows are dealt over the
    copies by a hash of their other columns: not by their place, which can change when a lost task is formed again.  All is a merge join, as neither side has a bound.
    """
    spark = rows.sparkSession
    counts = keys if counts is None else counts
    parts = partitions(spark)
    total = counts.agg(F.sum(count)).first()[0] or 0 if total is None else total
    if total <= least:
        return rows.join(keys.drop(count).hint("merge"), on, how)
    share = max(least, -(-total // (4 * parts)))
    copies = F.ceil(F.col(count) / share).cast("int")
    hot = counts.where(F.col(count) > share).select(F.xxhash64(*on).alias("_h"), copies.alias("_n")).groupBy("_h").agg(F.max("_n").alias("_n"))
    found = hot.collect()  # at most one for each share
    if not found:
        return rows.join(keys.drop(count).hint("merge"), on, how)
    hot = spark.createDataFrame(pa.table({"_h": pa.array([r[0] for r in found], pa.int64()), "_n": pa.array([r[1] for r in found], pa.int32())}))
    # equal hashes of different keys only make a further key hot, on both sides
    known = rows.join(F.broadcast(hot), F.xxhash64(*[rows[c] for c in on]) == F.col("_h"), "left")
    dealt = known.withColumn("_salt", F.when(F.col("_n").isNotNull(), salt(rows, on, F.col("_n"))).otherwise(F.lit(0)).cast("int")).drop("_h", "_n")
    spread = keys.join(F.broadcast(hot), F.xxhash64(*[keys[c] for c in on]) == F.col("_h"), "left")
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n") - 1, F.lit(0))))).drop("_h", "_n", count)
    return dealt.join(spread.hint("merge"), [*on, "_salt"], how).drop("_salt")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_texts(column: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets, nulls as empty texts."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each, in order."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def arrow_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts Arrow batches by text size; yields the rows and their texts."""
    for batch in batches:
        texts = as_texts(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(texts, limit):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over slices of bounded text size."""

    def run(batches):
        for rows, texts in arrow_slices(batches, text):
            yield work(rows, texts)

    return df.mapInArrow(run, schema)
