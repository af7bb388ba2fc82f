"""Best-fit packing of token pieces into sequences of fixed capacity.

The packing is planned on the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus size, and then applied to every piece by
its rank among the pieces of its length.  Rank within a length = pieces of that
length in earlier partitions + rank inside the partition, so no length, however
common, is gathered in one task.

Plan (large-item matching): pieces above one third of the capacity share a
sequence with at most one other such piece, matched greedily from the longest
down with the longest partner that fits; shorter pieces, longest first, go to the
tightest gap that holds them.  Equal sequences are handled as one run, so the plan
has a bounded number of rows too (each run loses at least half its gap whenever it
is touched again).

Defined results: null text counts as empty and gives the piece of its end id alone;
an empty table gives no rows; repeated doc_ids are packed like any other rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_slices
from .tokens import tokenizer, with_end

CAPACITY, END_ID = 4096, 1
#: Counts of pieces by length and partition, three numbers each, that are broadcast at most; beyond, the pieces are joined with them.
MOST_BASES = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, part int, rank long, ids array<int>"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of each document with the end id, cut where they exceed the capacity.

    ``part`` and ``rank`` place a piece among the pieces of its length.
    """

    def run(batches):
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for rows, texts in arrow_slices(batches, "text", 8 << 20):
            ids, counts = with_end(*tokenizer(path).encode(texts), end_id)
            ids = ids.astype("<u4")
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            at = (np.cumsum(counts) - counts)[doc] + start
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(sorted_length, sorted_length)
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [rows.column(0).take(pa.array(doc)), piece.astype(np.int32), start, length, np.full(len(doc), part, np.int32), rank]
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            names = ["doc_id", "piece", "start", "length", "part", "rank", "ids"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, copies per sequence, offset) and the number of sequences.

    Row i of a run: pieces first rank + r go to sequence first sequence + r // copies at offset + (r % copies) * length.
    """
    left = {int(n): int(c) for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of equal sequences: first, how many
    open_gaps: list[int] = []
    sequences = 0

    def place(length: int, count: int, first: int, copies: int, offset: int) -> None:
        rows.append((length, used[length], count, first, copies, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            k = bisect_left(large, min(length, capacity - length) + 1) - 1
            while k >= 0 and (not left[large[k]] or (large[k] == length and left[length] < 2)):
                k -= 1
            if k < 0:
                count = left[length]
                place(length, count, sequences, 1, 0)
                leave(capacity - length, sequences, count)
            elif (partner := large[k]) == length:
                count = left[length] // 2
                place(length, 2 * count, sequences, 2, 0)
                leave(capacity - 2 * length, sequences, count)
            else:
                count = min(left[length], left[partner])
                place(length, count, sequences, 1, 0)
                place(partner, count, sequences, 1, length)
                leave(capacity - length - partner, sequences, count)
            sequences += count
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            k = bisect_left(open_gaps, length)
            if k == len(open_gaps):
                gap, first, count = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += count
            else:
                gap = open_gaps[k]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[k]
            copies = gap // length
            full = min(count, left[length] // copies)
            if full:
                place(length, full * copies, first, copies, capacity - gap)
                leave(gap - copies * length, first, full)
            if full < count:
                if rest := min(left[length], copies - 1):
                    place(length, rest, first + full, copies, capacity - gap)
                    leave(gap - rest * length, first + full, 1)
                    full += 1
                leave(gap, first + full, count - full)
    return np.array(rows, np.int64).reshape(-1, 6), sequences


def digests(ids: pa.Array) -> pa.Array:
    """CRC-32 of each list of ids as little-endian 32-bit words."""
    raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
    ends = (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())


def pack(pieces: DataFrame, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Adds sequence_id, offset and the digest of the ids to rows that have ids, length, part and rank (see ``token_pieces``).

    ``pieces`` must be a written table, as it is read twice and its ranks must not change.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    few = counts.count() <= MOST_BASES  # then the pieces, which carry their ids, need not be shuffled
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast(rows)
    ranked = pieces.join(bases.hint("broadcast" if few else "merge"), ["length", "part"]).select(*[c for c in pieces.columns if c not in ("part", "rank")], (F.col("before") + F.col("rank")).alias("rank"))

    dropped = ["rank"] if with_ids else ["rank", "ids"]

    def assign(batches):
        rows = shared.value
        top = int((rows[:, 1] + rows[:, 2]).max(initial=1))
        keys = rows[:, 0] * top + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = rows[np.searchsorted(keys, length * top + rank, "right") - 1]
            r = rank - row[:, 1]
            crc = digests(batch.column(batch.schema.get_field_index("ids")))
            keep = batch.drop_columns(dropped)
            yield pa.RecordBatch.from_arrays([*keep.columns, crc, pa.array(row[:, 3] + r // row[:, 4]), pa.array(row[:, 5] + r % row[:, 4] * length)], [*keep.schema.names, "ids_crc32", "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name not in dropped]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["ids_crc32 long", "sequence_id long", "offset long"])
    return ranked.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    The ids go along to their place in any case, and the digests are of what arrives there.
    """
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.write(token_pieces(docs, path, capacity, end_id, doc_id, text), "pieces")
    order = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return pack(pieces, capacity, with_ids).select(*order)
