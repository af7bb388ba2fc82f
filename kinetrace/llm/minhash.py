"""Near-duplicate groups by min-max hashing with exact confirmation.

1. One pass over the texts makes a sketch: each permutation of the shingle hashes
   gives its minimum and its maximum, so a signature costs half as many hash
   evaluations as values.  Bands of values give bucket keys.  The number of bands
   makes the chance to miss a link at the threshold itself at most ``MISS``.
2. Equal shingle sets become one node.
3. In each bucket the node that shares most buckets is the hub.  Every other node is
   compared with its hub on full sets; links make components.
4. Buckets that still hold several components are searched for further links.  A pair
   is compared on full sets, once, unless a bound rules a link out: the size ratio, the
   triangle inequality of the Jaccard distance over the hub, the most shingles the two
   can have in common (inside the hub no more than the lesser of what each shares with
   it; outside it none that no other open node has), or a signature that agrees in far
   too few values (more than six standard deviations below the threshold).
So copies are never expanded into all their pairs, but no link between different
texts is given up other than by the stated chances.

Equal sets, buckets, hubs and components can hold a good part of all rows.  What is said
of them is formed by partial aggregates and joined back by ``spread_join``; the pairs of
a bucket are formed in square blocks of at most ``BLOCK`` nodes a side.  So none of them is
one task's load.  The full sets are formed anew from the texts of the documents that share
a bucket, which takes one shuffle of the texts.

Defined results: null and wordless texts have no shingles and link with nothing; a
row with a null doc_id links with nothing, is kept, and has a null component; rows
that share a doc_id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_slices, free_name, spread_join
from .components import FEW, components
from .shingles import shingle_sets

#: Chance that a pair at the threshold shares no bucket; most values of a signature.
MISS, MOST_VALUES = 1e-6, 128
BLOCK = 512


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band for a threshold in percent: the most selective rows that the signature has room for."""
    found = (math.ceil(math.log(MISS) / math.log(1 - percent / 100)), 1)
    for rows in range(2, 9):
        bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))
        if bands * rows > MOST_VALUES:
            break
        found = (bands, rows)
    return found


def signatures(shingles: np.ndarray, sizes: np.ndarray, values: int) -> np.ndarray:
    """One row of ``values`` for each non-empty set: minima, then maxima, of values / 2 permutations."""
    rng = np.random.default_rng(20)
    n = -(-values // 2)
    factors = rng.integers(0, 2**63, n, np.uint64) << np.uint64(1) | np.uint64(1)
    masks = rng.integers(0, 2**64, n, np.uint64)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), 2 * n), np.uint64)
    for k in range(n if len(starts) else 0):
        permuted = (shingles ^ masks[k]) * factors[k]
        out[:, k] = np.minimum.reduceat(permuted, starts)
        out[:, n + k] = np.maximum.reduceat(permuted, starts)
    return out[:, :values] if values % 2 == 0 else np.delete(out, n, 1)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A bucket key for each row and band; a band takes every ``bands``-th value, so minima and maxima mix."""
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for column in signature[:, b::bands].T:
            h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        keys[:, b] = h
    return keys


def _set_keys(shingles: np.ndarray, sizes: np.ndarray) -> list[str | None]:
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_hexdigest(shingles[e - n : e].data) if n else None for e, n in zip(ends.tolist(), sizes.tolist())]


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), signature (16 bits of each value), bands; from columns doc_id and text."""
    bands, rows = banding(percent)

    def run(batches):
        for batch, texts in arrow_slices(batches, "text"):
            shingles, sizes = shingle_sets(texts, width)
            signature = signatures(shingles, sizes, bands * rows)
            keys = band_keys(signature, bands).view(np.int64)
            some = np.flatnonzero(sizes)
            place = np.full(len(sizes), -1)
            place[some] = np.arange(len(some))
            take = pa.array(place, mask=place < 0)
            short = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * bands * rows), len(some), [None, pa.py_buffer(signature.astype("<u2").tobytes())]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(_set_keys(shingles, sizes), pa.string()), short.take(take), lists.take(take)], ["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key string, signature binary, bands array<long>")


def _full_sets(rows: DataFrame, width: int) -> DataFrame:
    """node, shingles of rows (node, set_key, text) whose text has that set."""

    def run(batches):
        for batch, texts in arrow_slices(batches, "text"):
            shingles, sizes = shingle_sets(texts, width)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(shingles.view(np.int64)))
            same = pa.array([a == b for a, b in zip(_set_keys(shingles, sizes), batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "shingles"]).filter(same)

    return rows.select("node", "set_key", "text").mapInArrow(run, "node long, shingles array<long>")


def _agreement(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, signature_a, signature_b) whose signatures agree in at least that share of values."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    return pairs.select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, sets: DataFrame, spread: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """a, b, common, total of pairs (a, b), a written table: sizes of intersection and union of the full sets.

    ``spread`` names the ends that can have very many pairs.
    """
    found, total = pairs, pairs.count()
    for end in ("a", "b"):
        if end not in spread:
            found = found.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}")), end)
            continue
        degree = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("degree"))
        found = spread_join(found, sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}")).join(degree, end), [end], "degree", total=total, counts=degree)
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    found = found.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("both"))
    return found.select("a", "b", "common", (F.col("both") - F.col("common")).alias("total"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * common shingles >= percent * all shingles of the two; component_id is the
    smallest doc_id reachable over links, and a document is kept if that is its own.
    """
    work = Workspace(docs.sparkSession, "minhash")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bands, rows = banding(percent)
    sketch = work.write(sketches(docs, width, percent), "sketch")

    named = sketch.where("set_key is not null and doc_id is not null")
    first = named.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "n_shingles", "signature", "bands"), "doc_id").alias("f"), F.count(F.lit(1)).alias("copies"))
    nodes = first.select(F.monotonically_increasing_id().alias("node"), "set_key", "copies", F.col("f.doc_id").alias("first_doc"), F.col("f.n_shingles").alias("n"), "f.signature", "f.bands")
    nodes = work.write(nodes, "nodes")
    by_id = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = not by_id.isEmpty()  # the same doc_id on several rows

    slots = nodes.select("node", F.explode("bands").alias("key"))
    shared = work.write(slots.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("n", F.col("size")), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = work.write(spread_join(slots, shared, ["key"], "n", total=total), "members")
    popular = members.groupBy("node").agg(F.sum("size").alias("weight"))
    ranked = members.join(popular, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("weight", -F.col("node"))).alias("top"), F.first("size").alias("n")).select("key", (-F.col("top.col2")).alias("hub"), "n")
    placed = work.write(spread_join(members, work.write(hubs, "hubs"), ["key"], "n", total=total).select("key", "node", "hub"), "placed")
    wanted = popular.select("node").join(nodes.select("node", "set_key", "first_doc"), "node")
    sets = _full_sets(wanted.join(docs, F.col("first_doc") == F.col("doc_id")), width)
    sets = work.write(sets.dropDuplicates(["node"]) if repeated else sets, "sets")

    pairs = work.write(placed.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "spoke-pairs")
    spokes = work.write(_compared(pairs, sets, spread=("b",)), "spokes")  # a node has no more hubs than buckets
    links = spokes.where(f"100 * common >= {percent} * total").select("a", "b")
    if repeated:  # documents under one id are one document
        ids = spread_join(named.select("doc_id", "set_key"), nodes.select("set_key", "node", "copies"), ["set_key"], "copies").select("doc_id", "node").distinct()
        ids = work.write(ids, "ids")
        low = ids.groupBy("doc_id").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n"))
        links = links.unionByName(spread_join(ids, low, ["doc_id"], "n").select(F.col("node").alias("a"), "b"))
    roots = components(links, work, "star")

    spread = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    unsettled = work.write(_several(work.write(spread, "spread"), work, "unsettled"), "unsettled")
    if not unsettled.isEmpty():
        more = _missed_links(unsettled, spokes, sets, nodes, work, percent, bands * rows)
        roots = components(links.unionByName(more), work, "all")

    named_roots = nodes.select("node", "set_key", "first_doc", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named_roots = work.write(named_roots, "roots")
    least = named_roots.groupBy("root").agg(F.min("first_doc").alias("component"), F.count(F.lit(1)).alias("n"))
    classes = work.write(spread_join(named_roots, least, ["root"], "n", least=FEW, total=named_roots.count()).select("set_key", "component", "copies"), "classes")
    own = sketch.select("doc_id", "n_shingles", "set_key")  # rows with a null id count as copies of their set too
    copies = own.where("set_key is not null").groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"))
    classes = classes.drop("copies").join(copies, "set_key") if not sketch.where("doc_id is null and set_key is not null").isEmpty() else classes
    found = spread_join(own.where("set_key is not null"), classes, ["set_key"], "copies", "left")
    found = found.select("doc_id", "n_shingles", "component").unionByName(own.where("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _several(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The rows (key, root, ...) of buckets that hold several components; ``rows`` is a written table."""
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    return spread_join(rows, work.write(several.select("key", "size"), f"{name}-keys"), ["key"], "size")


def _blocks(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Two sides whose join on (key, row, column) forms every pair of a key once or twice, at most ``block`` nodes a side.

    The nodes of a key are dealt into blocks; a pair of blocks (row <= column) is one cell of the join.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    counts = spread_join(rows, sizes.withColumn("k", F.ceil(F.col("size") / block).cast("int")), ["key"], "size", total=rows.count())
    own = counts.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    left = own.withColumn("column", F.explode(F.sequence("own", F.col("k") - 1))).withColumnRenamed("own", "row").drop("k")
    right = own.withColumn("row", F.explode(F.sequence(F.lit(0), "own"))).withColumnRenamed("own", "column").drop("k")
    return left, right


def _missed_links(unsettled: DataFrame, spokes: DataFrame, sets: DataFrame, nodes: DataFrame, work: Workspace, percent: int, values: int) -> DataFrame:
    """Links between different components that share a bucket."""
    open_nodes = unsettled.select("node").distinct()
    holders = open_nodes.join(sets, "node").select("node", F.explode("shingles").alias("shingle"))
    shared = holders.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("node")).where("n = 1")
    alone = shared.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    able = (
        open_nodes.join(nodes.select("node", "n", "signature", "bands"), "node")
        .join(alone, "node", "left")
        .select("node", "n", "signature", "bands", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
        .where(f"100 * most >= {percent} * n")
    )
    to_hub = spokes.select(F.col("a").alias("node"), F.col("b").alias("hub"), "common", (1 - F.col("common") / F.col("total")).alias("distance"))
    inside = F.coalesce("common", "n")  # the hub is inside itself
    rows = unsettled.join(able, "node").join(to_hub, ["node", "hub"], "left")
    rows = rows.select("key", "node", "root", "n", "signature", "bands", inside.alias("inside"), (F.col("most") - inside).alias("outside"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    rows = work.write(_several(work.write(rows, "able"), work, "open"), "open")
    x, y = (side.select("key", "row", "column", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n", "inside", "outside", "signature", "bands", "distance")]) for s, side in zip("xy", _blocks(rows, BLOCK)))
    most = F.least("inside_x", "inside_y") + F.greatest(F.lit(0), F.least("outside_x", "outside_y"))
    first_shared = F.try_element_at(F.filter(F.zip_with("bands_x", "bands_y", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull()), F.lit(1))
    may = (
        ((F.col("row") < F.col("column")) | (F.col("node_x") < F.col("node_y")))  # a block meets itself once
        & (F.col("root_x") != F.col("root_y"))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & (F.abs(F.col("distance_x") - F.col("distance_y")) <= 1 - percent / 100 + 1e-9)
        & (100 * most >= percent * (F.col("n_x") + F.col("n_y") - most))
        & (first_shared == F.col("key"))
    )
    pairs = x.join(y, ["key", "row", "column"]).where(may).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"), F.col("signature_x").alias("signature_a"), F.col("signature_y").alias("signature_b"))
    share = percent / 100
    close = work.write(_agreement(pairs, share - 6 * math.sqrt(share * (1 - share) / values)), "close")
    found = work.write(_compared(close, sets), "pairs")
    return found.where(f"100 * common >= {percent} * total").select("a", "b")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each group."""
    gone = near_duplicates(docs, width, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias(free_name(docs, "gone"))).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone[gone.columns[0]], "left_anti")
