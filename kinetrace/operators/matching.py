"""Greedy choices and chains as rounds of joins and window minima.

A choice that is made one after another (best first) is made here in rounds: a candidate that is the first one of
both its ends cannot be affected by any candidate before it, so all such candidates are taken at once, and what they
rule out goes.  The result is that of the sequential order, for all keys together, and no key is gathered in one task.
The number of rounds is that of the longest chain of candidates of which each waits for the one before.

Chains of pointers are followed by doubling: log2 of their length rounds.

Tables of a round are written below the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.sources.work import new_folder


class Rounds:
    """Written tables of an iteration; those of the round before last are not needed any more, but stay until the folder is cleaned."""

    def __init__(self, spark, name: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, name), 0

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}-{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def _first_of(rows: DataFrame, keys: list[str], ends: list[str], order: Column) -> DataFrame:
    """The rows that come first, by ``order``, among all rows of each of their ends."""
    out = rows.withColumn("_order", order)
    for n, end in enumerate(ends):
        out = out.withColumn(f"_first{n}", F.min("_order").over(Window.partitionBy(*keys, end)))
    return out.where(" and ".join(f"_order = _first{n}" for n in range(len(ends)))).drop("_order", *[f"_first{n}" for n in range(len(ends))])


def merged(items: DataFrame, links: DataFrame, apart: DataFrame, keys: list[str], log: Callable[[int, int], None] | None = None) -> DataFrame:
    """Constrained merging: keys, item, root (the least item of the cluster) of every row of ``items`` (keys, item).

    ``links`` (keys, a, b, score) are taken by falling score, then a, then b; one is refused if any pair of ``apart``
    (keys, a, b) lies across the two clusters.  In each round every link that is the best of both its clusters and is
    not refused merges them; pairs that must stay apart are carried up to the clusters.  ``log`` gets round and merges.
    """
    rounds = Rounds(items.sparkSession, "merged")
    roots = rounds.keep(items.select(*keys, "item", F.col("item").alias("root")), "roots")

    def ordered(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*keys, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), *more)

    order = F.struct((-F.col("score")).alias("s"), F.col("a"), F.col("b")).alias("order")
    live = rounds.keep(ordered(links.select(*keys, "a", "b", order), "order"), "links")
    walls = rounds.keep(ordered(apart).distinct(), "apart")
    n = 0
    while True:
        best = live.where("lo <> hi").groupBy(*keys, "lo", "hi").agg(F.min("order").alias("order"))
        best = rounds.keep(best.join(walls, [*keys, "lo", "hi"], "left_anti"), "live")
        ends = best.select(*keys, F.explode(F.array("lo", "hi")).alias("end"), "order").groupBy(*keys, "end").agg(F.min("order").alias("first"))
        low, high = (ends.select(*keys, F.col("end").alias(c), F.col("first").alias(f"first_{c}")) for c in ("lo", "hi"))
        taken = best.join(low, [*keys, "lo"]).join(high, [*keys, "hi"]).where("order = first_lo and order = first_hi")
        taken = rounds.keep(taken.select(*keys, F.col("hi").alias("from"), F.col("lo").alias("to")), "taken")
        merges = taken.count()
        if log:
            log(n, merges)
        if not merges:
            return roots

        def moved(rows: DataFrame, column: str) -> DataFrame:
            to = taken.select(*keys, F.col("from").alias(column), "to")
            return rows.join(to, [*keys, column], "left").withColumn(column, F.coalesce("to", column)).drop("to")

        again = lambda rows, *more: rows.select(*keys, F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), *more)
        roots = rounds.keep(moved(roots, "root").select(*keys, "item", "root"), "roots")
        live = again(moved(moved(best, "lo"), "hi"), "order")  # from written tables, so it need not be one
        walls = rounds.keep(again(moved(moved(walls, "lo"), "hi")).distinct(), "apart")
        n += 1


def chosen(pairs: DataFrame, keys: list[str], taker: str, taken: str, turn: list[str], cost: list[str]) -> DataFrame:
    """One-to-one choices: takers in the order of ``turn`` each take the cheapest, by ``cost``, that none before has taken.

    ``pairs`` has a row for each choice there is; ``turn`` with ``taker`` orders takers, ``cost`` with ``taken`` the choices.
    A round takes every pair that is its taker's cheapest and whose taker is the first one that still could take it.
    """
    rounds = Rounds(pairs.sparkSession, "chosen")
    live, found = rounds.keep(pairs, "pairs"), None
    mine = Window.partitionBy(*keys, taker).orderBy(*cost, taken)
    theirs = Window.partitionBy(*keys, taken).orderBy(*turn, taker)
    while True:
        ranked = live.withColumn("_mine", F.row_number().over(mine)).withColumn("_theirs", F.row_number().over(theirs))
        now = rounds.keep(ranked.where("_mine = 1 and _theirs = 1").drop("_mine", "_theirs"), "taken")
        if now.isEmpty():
            return now if found is None else found
        found = now if found is None else found.unionByName(now)
        live = live.join(now.select(*keys, taker), [*keys, taker], "left_anti").join(now.select(*keys, taken), [*keys, taken], "left_anti")
        live = rounds.keep(live, "pairs")


def ends_of_chains(pointers: DataFrame, keys: list[str], item: str, to: str) -> DataFrame:
    """keys, item, end: where each item's pointers lead, by doubling; an item without a pointer is no row and an end. Pointers have no cycles."""
    rounds = Rounds(pointers.sparkSession, "chains")
    hops = rounds.keep(pointers.select(*keys, F.col(item).alias("item"), F.col(to).alias("end")), "hops")
    while True:
        onward = hops.select(*keys, F.col("item").alias("end"), F.col("end").alias("further"))
        longer = rounds.keep(hops.join(onward, [*keys, "end"], "left"), "hops")
        hops = longer.select(*keys, "item", F.coalesce("further", "end").alias("end"))
        if longer.where("further is not null").isEmpty():
            return hops


def kept_apart(rows: DataFrame, keys: list[str], at: str, least: float, tie: list[str] | None = None) -> DataFrame:
    """Rows at least ``least`` in ``at`` after the last kept row of their key; the first is kept.

    Each row points to the first row that could follow it, found by one sort of rows and shifted rows.  The chain from
    the first row is marked by doubling: what is reached in fewer than 2^k hops and one jump of 2^k gives what is reached in
    fewer than 2^(k+1).  No Python, and no key is held whole.  The tables shrink well when written, so their files say
    little of their size: joins are by sorting, never by a copy through the driver.
    """
    spark = rows.sparkSession
    rounds = Rounds(spark, "thinned")
    order = [at, *(tie or [])]
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    numbered = rounds.keep(numbered, "rows")
    times = numbered.select(*keys, F.col(at).alias("_t"), "_i")
    asked = times.select(*keys, (F.col("_t") + least - 1e-9).alias("_t"), F.col("_i").alias("_from"))
    both = times.unionByName(asked, allowMissingColumns=True)
    # from the last to the first, rows before what asks for them at the same time: a frame that only grows
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc_nulls_last("_i")).rowsBetween(Window.unboundedPreceding, 0)
    jumps = both.withColumn("_to", F.last("_i", True).over(back)).where("_from is not null and _to is not null").select(*keys, F.col("_from").alias("_i"), "_to")
    jumps = rounds.keep(jumps, "jumps")
    reached = rounds.keep(numbered.where("_i = 1").select(*keys, "_i"), "reached")
    while not jumps.isEmpty():
        more = reached.join(jumps.hint("merge"), [*keys, "_i"]).select(*keys, F.col("_to").alias("_i"))
        reached = rounds.keep(reached.unionByName(more), "reached")
        onward = jumps.select(*keys, F.col("_i").alias("_to"), F.col("_to").alias("_next"))
        jumps = rounds.keep(jumps.join(onward.hint("merge"), [*keys, "_to"]).select(*keys, "_i", F.col("_next").alias("_to")), "jumps")
    return numbered.join(reached.hint("merge"), [*keys, "_i"], "left_semi").select(*rows.columns)
