"""Exact deduplication by distributed most-significant-byte-first partitioning.

All rows start in one group.  A level takes the next bytes of every row that is
still in an open group, splits the groups by them (group, bytes), and closes a
group that is down to one row or whose texts have ended.  A digit is wide, 64 bytes
at first and eight times as many at each level up to 1 MiB, so a text of n bytes
needs about log(n) levels; a level's shuffle then carries nearly all that is left of
the texts that agree so far, which for short texts is close to grouping by the whole
text.  Equality is decided on the bytes themselves; no digest takes part.

Splitting is a count per (group, bytes) with map-side partial sums, then an
equi-join back.  The keys of groups that hold a good part of all rows are copied and
the rows dealt over the copies (``spread_join``), so no group is gathered in one task.
Both are merge joins at every size: the keys have no size bound, so they are never
broadcast.

Defined results: a null text counts as empty; empty texts are equal; among rows of
equal text and equal doc_id one row stays; a null doc_id sorts below every other;
an empty table gives an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, free_name, spread_join

FIRST_WIDTH, GROWTH, LAST_WIDTH = 64, 8, 1 << 20


def _bytes(text: Column, width: int | None = None) -> Column:
    """The normalised text as bytes, whole or as many code points as hold the first ``width`` bytes."""
    body = F.coalesce(text, F.lit(""))
    return ascii_lower(F.substring(body, 1, width) if width else body).cast("binary")


def _split(rows: DataFrame, text: Column, carried: list[str], keep_all: bool, first_width: int, growth: int, last_width: int) -> list[DataFrame]:
    """The settled rows of every level: carried columns, keep_id, group_size, kept; from rows of id and carried columns.

    ``text`` is formed anew from a row's columns, so that only one copy of it is shuffled.

    With ``keep_all`` unset, only the rows that stay are settled, and the others are gone after the level that tells.
    """
    work = Workspace(rows.sparkSession, "exact")
    rows = rows.withColumn("lead", F.substring(_bytes(text, first_width), 1, first_width))
    repeated = rows.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lead", "n", F.monotonically_increasing_id().alias("group"))
    repeated = work.write(repeated, "level-0-keys")
    joined = spread_join(rows, repeated, ["lead"], "n", "left")
    rest = F.when(F.col("group").isNotNull(), F.substring(_bytes(text), first_width + 1, 2**31 - 1))
    level = work.write(joined.select("id", *carried, "group", rest.alias("rest"), F.monotonically_increasing_id().alias("row")), "level-0")
    alone = [F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    done = [level.where("group is null").select(*carried, *alone)]
    width, k = first_width * growth, 1
    while not (open_rows := level.where("group is not null").select("id", *carried, "group", "rest", "row")).isEmpty():
        open_rows = open_rows.withColumn("lead", F.substring("rest", 1, width))
        keys = (
            open_rows.groupBy("group", "lead")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("last"))
            .where("n > 1")
            .select(
                "group", "lead", "n", F.col("n").alias("size"), "last",
                (F.length("lead") < width).alias("ended"),
                F.monotonically_increasing_id().alias("next"),
            )
        )
        keys = work.write(keys, f"level-{k}-keys")
        going = F.col("size").isNotNull() & ~F.col("ended")
        closed = F.col("size").isNotNull() & F.col("ended")
        level = spread_join(open_rows, keys, ["group", "lead"], "n", "left").select(
            "id",
            *carried,
            F.when(going, F.col("next")).alias("group"),
            F.when(going, F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
            "row",
            F.when(closed, F.col("last.id")).otherwise(F.col("id")).alias("keep_id"),
            F.when(closed, F.col("size")).otherwise(1).cast("long").alias("group_size"),
            F.when(closed, F.col("last.row") == F.col("row")).otherwise(True).alias("kept"),
        )
        level = work.write(level if keep_all else level.where("group is not null or kept"), f"level-{k}")
        done.append(level.where("group is null").select(*carried, "keep_id", "group_size", "kept"))
        width, k = min(width * growth, last_width), k + 1
    return done


def equal_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first_width: int = FIRST_WIDTH, growth: int = GROWTH, last_width: int = LAST_WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row
    with the largest doc_id stays.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.select("id", "text", F.col("id").alias("doc_id"), F.sha2(_bytes(F.col("text")), 256).alias("text_sha256"))
    found = _split(rows, F.col("text"), ["doc_id", "text_sha256"], True, first_width, growth, last_width)
    return reduce(DataFrame.unionByName, found).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_equal_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first_width: int = FIRST_WIDTH, growth: int = GROWTH, last_width: int = LAST_WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    The columns go along with each row through the levels, so no row is looked up again.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    found = _split(rows, F.col("whole").getField(text), ["whole"], False, first_width, growth, last_width)
    return reduce(DataFrame.unionByName, found).select("whole.*")
