"""Reusable transforms: interval overlap, as-of, islands, grids, top-k, mutual neighbours.

Keys are lists of column names; ties are resolved by explicit keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours_covered(df: DataFrame, start: str, end: str, hour: str = "hour", overlap: str = "overlap") -> DataFrame:
    """A row for each whole hour that an interval [start, end), in hours, touches for longer than nothing.

    The hours are generated from the interval, so there is no join over all pairs.
    """
    first, last = F.floor(start).cast("long"), F.ceil(end).cast("long") - 1
    out = df.withColumn(hour, F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    shared = F.least(F.col(end), F.col(hour) + 1.0) - F.greatest(F.col(start), F.col(hour).cast("double"))
    return out.withColumn(overlap, shared).where(F.col(overlap) > 0)


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of intervals [start, end) that overlap, as columns l_* and r_*.

    Both sides are put into cells of ``width``; a pair is kept in the cell where the later one starts, so once.
    Choose the width near the usual length: cells, not the square of the rows, bound the work.
    """

    def cells(df: DataFrame, side: str) -> DataFrame:
        a, b = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
        return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns], F.explode(F.sequence(a, b)).alias(f"{side}cell"))

    l, r = cells(left, "l"), cells(right, "r")
    later = F.floor(F.greatest(F.col(f"l_{start}"), F.col(f"r_{start}")) / width)
    same = (F.col("lcell") == F.col("rcell")) & (F.col("lcell") == later) & (F.col(f"l_{start}") < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(f"l_{end}"))
    for key in on or []:
        same &= F.col(f"l_{key}") == F.col(f"r_{key}")
    return l.join(r, same).drop("lcell", "rcell")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, carry: list[str], later_on_tie: bool = True, within: float | None = None, cell: float | None = None) -> DataFrame:
    """Left rows with the columns ``carry`` of the right row nearest in ``at`` (null beyond ``within``).

    One sort of the union: the last right row before and the first after are found by window functions.
    With ``cell`` the sort is per key and cell of that width, and each cell learns from a row per cell what lies
    before and after it; so a key with very many rows is no single task's load.  Right rows must differ in (keys, at).
    """
    row = F.struct(F.col(at).alias("at"), *[F.col(c).alias(c) for c in carry])
    r = right.select(*keys, F.col(at).alias("_at"), row.alias("_r"))
    l = left.withColumn("_at", F.col(at)).withColumn("_left", F.lit(True))
    both = l.unionByName(r, allowMissingColumns=True)
    groups = [*keys, "_cell"] if cell else keys
    if cell:
        both = both.withColumn("_cell", F.floor(F.col("_at") / cell))
    before = Window.partitionBy(*groups).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*groups).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # from the last on: a frame that grows, one that shrinks is read anew for each row
    found = both.withColumn("_b", F.last("_r", True).over(before)).withColumn("_a", F.last("_r", True).over(after)).where("_left")
    if cell:
        there = F.when(F.col("_r").isNotNull(), F.col("_at"))
        ends = both.groupBy(*groups).agg(F.max_by("_r", there).alias("_last"), F.min_by("_r", there).alias("_first"))
        w, back = (Window.partitionBy(*keys).orderBy(c) for c in ("_cell", F.desc("_cell")))  # a row per cell
        ends = ends.select(*groups, F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_back"), F.last("_first", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))
        found = found.join(ends, groups).withColumn("_b", F.coalesce("_b", "_back")).withColumn("_a", F.coalesce("_a", "_ahead"))
    back, ahead = F.col("_at") - F.col("_b.at"), F.col("_a.at") - F.col("_at")
    use_after = F.col("_b").isNull() | (F.col("_a").isNotNull() & ((ahead <= back) if later_on_tie else (ahead < back)))
    chosen = F.when(use_after, F.col("_a")).otherwise(F.col("_b"))
    if within is not None:
        chosen = F.when(F.least(back, ahead) <= within, chosen)
    out = found.withColumn("_c", chosen)
    return out.select(*left.columns, *[F.col(f"_c.{c}").alias(c) for c in carry])


def sessions(df: DataFrame, keys: list[str], at: str, gap: float, name: str = "session", order: list[str] | None = None) -> DataFrame:
    """Numbers the runs of rows whose steps in ``at`` are at most ``gap``, from 0."""
    w = Window.partitionBy(*keys).orderBy(at, *(order or []))
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, keys: list[str], at: str, flag: str) -> DataFrame:
    """Islands of consecutive true rows: keys, begin, end (both inclusive), n."""
    w = Window.partitionBy(*keys).orderBy(at)
    numbered = df.withColumn("_i", F.row_number().over(w)).where(F.col(flag))
    island = numbered.withColumn("_g", F.col("_i") - F.row_number().over(w))
    return island.groupBy(*keys, "_g").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


def closed_gaps(islands: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Merges islands (begin, end) that are at most ``most`` apart."""
    w = Window.partitionBy(*keys).orderBy("begin")
    new = F.coalesce((F.col("begin") - F.lag("end").over(w) > most).cast("int"), F.lit(0))
    grouped = islands.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_g")


def filled(grid: DataFrame, df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every row of the grid, missing values as 0; the grid is a fixed small table."""
    return grid.join(df, keys, "left").na.fill(0, values)


def numbers(spark, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each key in a total order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def mutual(pairs: DataFrame, bins: list[str], a: str, b: str, distance: str) -> DataFrame:
    """Pairs that are each other's nearest within a bin; ties go to the smaller partner."""
    from_a = Window.partitionBy(*bins, a).orderBy(distance, b)
    from_b = Window.partitionBy(*bins, b).orderBy(distance, a)
    return pairs.withColumn("_a", F.row_number().over(from_a)).withColumn("_b", F.row_number().over(from_b)).where("_a = 1 and _b = 1").drop("_a", "_b")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, merge: dict[str, Column]) -> DataFrame:
    """Rows of ``old`` with those of ``new`` merged in by key.

    For a conflict the columns of ``merge`` are formed from ``old.*`` and ``new.*``, the others keep their old value;
    of several new rows of a key the last by ``order`` counts.
    """
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")
    found = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    o, n = old.withColumn("_o", F.lit(1)).alias("old"), last.withColumn("_n", F.lit(1)).alias("new")
    joined = o.join(n, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")
    columns = []
    for c in old.columns:
        kept = F.when(F.col("_o").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        columns.append((F.when(found, merge[c]).otherwise(kept) if c in merge else kept).alias(c))
    return joined.select(*columns)
