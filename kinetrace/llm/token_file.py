"""Token-id files in word-aligned Simple-8b coding.

Format.  A file is a Parquet table; a row is a segment of whole documents in
ascending doc_id order:

    shard, segment     place of the segment; shards are in doc_id order
    first_id           ids of the shard before this segment
    doc_ids, counts    the documents of the segment and how many ids each has
    words              64-bit little-endian words
    block_words        little-endian uint32: index of the first word of each block, and the number of words
    escapes            little-endian uint64 values of 60 bits or more

The ids of a segment are cut into blocks of BLOCK ids; a block begins a new word, so
blocks can be decoded apart.  The low 4 bits of a word are its selector:

    selector  0       1       2     3     4     5     6     7     8    9    10    11    12    13    14    15
    ids       1       120     60    30    20    15    12    10    8    7    6     5     4     3     2     1
    bits      escape  0       1     2     3     4     5     6     7    8    10    12    15    20    30    60

Ids follow from bit 4 upward.  An escape word holds the index of its value in
``escapes``.  The last word of a block may have room beyond the block's end; it is
filled with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_slices, partitions
from .tokens import tokenizer, with_end

BLOCK, SEGMENT = 1024, 1 << 16
# Fixed values of the format: ids and bits for each selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SCHEMA = "shard int, segment int, first_id long, doc_ids array<long>, counts array<int>, n_ids long, words binary, block_words binary, escapes binary"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    bits = np.zeros(values.shape, np.uint8)
    for b in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        over = values >> np.uint64(b) > 0
        if not over.any():
            break
        bits[over] = b + 1
    return bits


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block and their total, escapes.  All blocks advance together."""
    values = np.asarray(values, np.uint64)
    n_blocks = -(-len(values) // block)
    pad = int(COUNTS.max())
    grid = np.zeros((n_blocks, block + pad), np.uint64)
    lengths = np.full(n_blocks, block)
    if n_blocks:
        lengths[-1] = len(values) - (n_blocks - 1) * block
        whole = len(values) // block
        grid[:whole, :block] = values[: whole * block].reshape(whole, block)
        if whole < n_blocks:
            grid[-1, : lengths[-1]] = values[whole * block :]
    width = block + pad
    flat = np.append(grid.ravel(), np.zeros(pad, np.uint64))
    bits = _widths(flat)
    # the densest selector whose ids all fit, for each position: maxima over windows of growing size
    best = np.where(bits > 60, 0, 15).astype(np.uint8)
    window, size = bits, 1
    for selector in range(14, 0, -1):
        n = int(COUNTS[selector])
        while 2 * size <= n:
            window = np.maximum(window[:-size], window[size:])
            size *= 2
        m = len(bits) - n + 1
        fits = np.maximum(window[:m], window[n - size : n - size + m]) <= BITS[selector]
        best[:m][fits] = selector
    at, step = np.arange(n_blocks) * width, COUNTS[best]
    ends, begin = at + lengths, np.zeros(len(flat), bool)
    while len(at):
        begin[at] = True
        at = at + step[at]
        alive = at < ends
        at, ends = at[alive], ends[alive]
    starts = np.flatnonzero(begin)
    selectors = best[starts]
    words = selectors.astype(np.uint64)
    for selector in np.unique(selectors).tolist():
        if selector > 1:
            where = np.flatnonzero(selectors == selector)
            source, packed = starts[where], words[where]
            for j in range(int(COUNTS[selector])):
                packed |= flat[source + j] << np.uint64(4 + j * int(BITS[selector]))
            words[where] = packed
    escaped = np.flatnonzero(selectors == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64) << np.uint64(4)
    offsets = np.searchsorted(starts, np.arange(n_blocks + 1) * width).astype(np.uint32)
    return words, offsets, flat[starts[escaped]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The inverse of ``encode``."""
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    selectors = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    blocks = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    at = before - before[offsets[:-1].astype(np.int64)][blocks] + blocks * block
    end = np.minimum((blocks + 1) * block, n_ids)
    for selector in np.unique(selectors).tolist():
        where = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[at[where]] = escapes[words[where] >> np.uint64(4)]
        elif selector > 1:
            mask = np.uint64((1 << int(BITS[selector])) - 1)
            for j in range(int(COUNTS[selector])):
                inside = where[at[where] + j < end[where]] if j else where
                out[at[inside] + j] = words[inside] >> np.uint64(4 + j * int(BITS[selector])) & mask
    return out


def _segments(parts: Iterator[tuple[list, np.ndarray, np.ndarray]], shard: int) -> Iterator[pa.RecordBatch]:
    """Cuts (doc_ids, ids, counts) of a shard into segments of whole documents."""
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("words", pa.binary()), ("block_words", pa.binary()), ("escapes", pa.binary())])
    segment = first = 0
    for doc_ids, ids, counts in parts:
        total = np.cumsum(counts)
        group = (total - counts) // SEGMENT
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(counts)]
        for a, b in zip(cuts, cuts[1:]):
            low, high = int(total[a] - counts[a]), int(total[b - 1])
            words, offsets, escapes = encode(ids[low:high])
            row = [shard, segment, first, doc_ids[a:b], counts[a:b].tolist(), high - low, words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), escapes.astype("<u8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
            segment, first = segment + 1, first + high - low


def write_token_file(docs: DataFrame, folder: str, path: str, end_id: int = 1, shards: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes all texts and writes them in ascending doc_id order (null ids first, ties by text).

    Spark deals the documents to shards by ranges of doc_id and sorts inside them, so the order is global
    though no task holds more than a shard.  Null text counts as empty.
    """

    def run(batches):
        def parts():
            for rows, texts in arrow_slices(batches, "text", 8 << 20):
                yield rows.column(0).to_pylist(), *with_end(*tokenizer(path).encode(texts), end_id)

        yield from _segments(parts(), TaskContext.get().partitionId())

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = shards or partitions(docs.sparkSession)
    rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(folder)


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per shard
    bases = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    names = ["doc_ids", "counts", "n_ids", "words", "block_words", "escapes", "start"]
    placed = files.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("first_id")).select(*names)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts, n_ids, words, offsets, escapes, start = (batch.column(i)[row] for i in range(7))
                ids = decode(*(np.frombuffer(x.as_buffer(), t) for x, t in ((words, "<u8"), (offsets, "<u4"), (escapes, "<u8"))), n_ids.as_py()).astype("<u4")
                counts = counts.values.to_numpy().astype(np.int64)
                ends = np.append(0, np.cumsum(counts))
                binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(start.as_py() + ends[:-1]), pa.array(counts), binary], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
