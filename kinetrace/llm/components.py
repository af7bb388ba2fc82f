"""Connected components by alternating star steps, with every step an aggregate and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions, spread_join

#: Edges of a node that one task takes in any case; an edge is two numbers.
FEW = 20_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of long); root is the least node reachable.

    A step writes its edges to the shared folder, in files of about ``FEW`` edges.  Minima are partly formed before they are shuffled and joined back by
    ``spread_join``, so a node of very many edges is no single task's load.
    """
    edges = work.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    state, k = _state(edges), 0
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        large = spread_join(both.where("b > a"), least, ["a"], "n", least=FEW, total=state[0]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, lower, ["a"], "n", least=FEW, total=state[0]).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lower.select("a", F.col("low").alias("b")))
        files = min(partitions(edges.sparkSession), -(-2 * state[0] // FEW))  # a step has at most twice as many rows as the one before
        edges = work.write(small.where("a <> b").distinct().coalesce(files), f"{name}-{k + 1}")
        state, before, k = _state(edges), state, k + 1
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
