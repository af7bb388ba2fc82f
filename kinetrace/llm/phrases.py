"""Phrase collocation mining over vertically partitioned, depth-truncated suffix trees.

1. Encoding.  Texts are cut into slices of bounded size; a slice's pieces become local word
   numbers with its own word list, in one written table.  Words are counted from the lists;
   those that stand ``least`` times or more in their language get global numbers, and each
   slice gets the numbers of its own words by a join, so no vocabulary is broadcast.
2. Vertical partitioning.  Every position is a suffix, truncated to ``DEPTH`` words and at the
   end of its piece; an infrequent word ends it too, as no phrase with it can be frequent.
   Equal suffixes of a slice are one row with a count.  The rows are dealt into consecutive
   ranges of word prefixes of about equal size, ``BUDGET`` rows each, by sampled bounds.  A
   frequent prefix is so split by its further words, without a list of such prefixes.
3. Subtrees.  A range is sorted, which is the leaf order of its subtree; the depth at which a
   leaf branches off the one before gives the inner nodes, and their counts are the sums of
   their leaves' counts.  They are read in one pass that holds one path only.  A node that
   touches the bounds of its range may go on in the next one; such parts are summed after.
4. Scores.  A phrase's parts are phrases at least as frequent, so their counts are looked up
   among the nodes (``spread_join``, as very many phrases can share a part).

Numbers are 64-bit counts; the score's products are decimals of 38 digits.

Defined results: a null text counts as empty; a null language is ``und``; a language without
a candidate has no row; repeated rows count as often as they stand; an empty table gives
an empty result; other columns are not looked at.  More than 2^31 - 1 frequent words raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_slices, partitions, spread_join

DEPTH = 4
#: Suffix rows in one range: 24 bytes each, sorted by Spark, which spills.
BUDGET = 4 << 20
#: Text in one slice.
SLICE = 8 << 20
#: Separators of pieces become line feeds, those of words spaces; A-Z become lower case.
_NORMAL = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09" + bytes(range(65, 91)), b"\n" * 10 + b" " + bytes(range(97, 123)))


def encode_pieces(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Word numbers from 1 of all pieces, 0 between them, and the words by number."""
    body = b"\n " + b"\n".join(texts).translate(_NORMAL).replace(b"\n", b" \n ")
    words = pc.split_pattern(pa.array([body], pa.large_binary()), b" ").flatten()
    coded = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.uint32), coded.dictionary.slice(1)


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, lowest bytes first: the upper planes are nearly all zero and compress well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encoded_slices(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """slice, lang, ids (bytes), words, counts: the texts of one language in one slice of a partition."""
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    names = ["slice", "lang", "ids", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, texts in arrow_slices(batches, "text", SLICE):
            by_lang: dict[str, list[bytes]] = {}
            for name, body in zip(rows.column(0).to_pylist(), texts.cast(pa.large_binary()).to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(body)
            for name, bodies in by_lang.items():
                ids, words = encode_pieces(bodies)
                counts = np.bincount(ids, minlength=len(words) + 1)[1:]
                values = ([number], [name], [_planes(ids)], [words.cast(pa.large_string()).to_pylist()], [counts])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)
            number += 1

    columns = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return columns.mapInArrow(run, "slice long, lang string, ids binary, words array<string>, counts array<long>")


def numbered(words: DataFrame, work: Workspace) -> DataFrame:
    """The rows of ``words`` with dense numbers ``id`` from 1."""
    written = work.write(words, "frequent-words").select("*", F.monotonically_increasing_id().alias("place"))
    written = work.write(written, "placed-words").withColumn("part", F.shiftright("place", 33))
    sizes = written.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row for each file split
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    place = F.col("place") - F.shiftleft(F.col("part"), 33)
    out = written.join(F.broadcast(before), "part").withColumn("id", F.col("before") + place + 1)
    safe = F.when(F.col("id") < 2**31, F.col("id")).otherwise(F.raise_error(F.lit("more than 2^31 - 1 frequent words")).cast("long"))
    return out.withColumn("id", safe).drop("part", "place", "before")


def suffix_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of two to four words as (first two, last two, count), sorted and distinct; 0 in ``ids`` ends a suffix."""
    padded = np.concatenate([ids, np.zeros(DEPTH - 1, ids.dtype)]).astype(np.int64)
    n = len(ids)
    second = padded[1 : n + 1]
    at = np.flatnonzero((padded[:n] > 0) & (second > 0))
    head = padded[at] << 32 | padded[at + 1]
    third = padded[at + 2]
    tail = third << 32 | np.where(third > 0, padded[at + 3], 0)
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(head) != 0) | (np.diff(tail) != 0)]) if len(head) else np.zeros(0, int)
    return head[starts], tail[starts], np.diff(np.r_[starts, len(head)])


_SUFFIXES = "head long, tail long, n long"
_SUFFIX_NAMES = ["head", "tail", "n"]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix rows of slices given as ids, local and global word numbers."""
    for batch in batches:
        for row in range(batch.num_rows):
            data, local, known = (batch.column(i)[row] for i in range(3))
            ids = _from_planes(data.as_py())
            number = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
            number[local.values.to_numpy(zero_copy_only=False)] = known.values.to_numpy(zero_copy_only=False)
            columns = [pa.array(c) for c in suffix_counts(number[ids])]
            for a in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([c.slice(a, 1 << 17) for c in columns], names=_SUFFIX_NAMES)


class Subtree:
    """Reads node counts off the sorted leaves of one range; keeps the path of the last leaf only."""

    def __init__(self, least: int):
        self.least = least
        self.path: list[tuple[int, int] | None] = [None] * (DEPTH + 1)  # open node by depth
        self.total = [0] * (DEPTH + 1)
        self.first = [True] * (DEPTH + 1)  # whether the open node is the first of its depth

    def add(self, head: np.ndarray, tail: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes closed by these leaves: (first two words, last two, count) by depth."""
        out = []
        third = tail >> 32
        for depth, rest, real in ((2, np.zeros_like(tail), None), (3, third << 32, third > 0), (4, tail, (tail & 0xFFFFFFFF) > 0)):
            h, t, n = (head, rest, counts) if real is None else (head[real], rest[real], counts[real])
            if not len(h):
                continue
            starts = np.flatnonzero(np.r_[True, (np.diff(h) != 0) | (np.diff(t) != 0)])
            totals = np.add.reduceat(n, starts)
            h, t = h[starts], t[starts]
            if self.path[depth] == (int(h[0]), int(t[0])):
                totals[0] += self.total[depth]
            elif self.path[depth] is not None:
                h, t, totals = (np.r_[old, new] for old, new in zip((*self.path[depth], self.total[depth]), (h, t, totals), strict=True))
            self.path[depth], self.total[depth] = (int(h[-1]), int(t[-1])), int(totals[-1])
            h, t, totals = h[:-1], t[:-1], totals[:-1]  # the last one is open
            if len(h):
                tell = totals >= self.least
                tell[0] |= self.first[depth]  # may have begun in the range before
                self.first[depth] = False
                out.append((h[tell], t[tell], totals[tell]))
        return out

    def close(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The nodes of the last path, which may go on in the next range."""
        return [tuple(np.array([v]) for v in (*path, total)) for path, total in zip(self.path, self.total, strict=True) if path is not None]


def subtree_nodes(suffixes: DataFrame, ranges: int, least: int) -> DataFrame:
    """head, tail, a: the phrases of two to four words that stand ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Subtree(least)
        for batch in batches:
            for node in tree.add(*(c.to_numpy() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in node], names=_SUFFIX_NAMES)
        for node in tree.close():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in node], names=_SUFFIX_NAMES)

    leaves = suffixes.repartitionByRange(ranges, "head", "tail").sortWithinPartitions("head", "tail")
    return leaves.mapInArrow(run, _SUFFIXES).groupBy("head", "tail").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _word(k: int) -> Column:
    """Number of the k-th word, from 1; 0 if the phrase is shorter."""
    pair = F.col("head" if k <= 2 else "tail")
    return F.shiftright(pair, 32) if k % 2 else pair.bitwiseAND(F.lit(0xFFFFFFFF))


def _phrase(first: int, last: int) -> Column:
    """Key (head, tail) of the words from ``first`` to ``last`` of a phrase."""
    words = [_word(k) for k in range(first, last + 1)] + [F.lit(0).cast("long")] * (DEPTH - 1 - last + first)
    return F.struct((F.shiftleft(words[0], 32) + words[1]).alias("head"), (F.shiftleft(words[2], 32) + words[3]).alias("tail"))


def _parts(words: int) -> list[tuple[int, str, Column]]:
    """(first words, side, key) of every cut of a phrase of so many words."""
    return [(k, side, _phrase(1, k) if side == "l" else _phrase(k + 1, words)) for k in range(1, words) for side in "lr"]


def _length() -> Column:
    return F.when(_word(4) > 0, 4).when(_word(3) > 0, 3).otherwise(2)


def lowest_cuts(nodes: DataFrame, words: DataFrame, work: Workspace) -> DataFrame:
    """head, tail, a, l, r, score of every phrase of ``nodes``: its lowest-scoring cut."""

    def asked(n: int) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), key.alias("part")) for k, side, key in _parts(n)])

    requests = nodes.select("head", "tail", F.explode(F.when(_length() == 4, asked(4)).when(_length() == 3, asked(3)).otherwise(asked(2))).alias("q"))
    requests = work.write(requests.select(F.col("head").alias("of_head"), F.col("tail").alias("of_tail"), "q.k", "q.side", "q.part.head", "q.part.tail"), "parts")
    single = words.select(F.shiftleft("id", 32).alias("head"), F.lit(0).cast("long").alias("tail"), "f")
    counts = requests.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("asked"))
    known = single.unionByName(nodes.withColumnRenamed("a", "f")).join(counts.hint("merge"), ["head", "tail"])
    found = spread_join(requests, work.write(known, "part-counts"), ["head", "tail"], "asked")
    pick = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, DEPTH) for side in "lr"]
    wide = found.groupBy(F.col("of_head").alias("head"), F.col("of_tail").alias("tail")).agg(*pick)
    whole = "decimal(38,0)"

    def cut(k: int) -> Column:
        left, right = F.col(f"l{k}"), F.col(f"r{k}")
        score = F.call_function("div", F.lit(2_000_000).cast(whole) * F.col("a").cast(whole), left.cast(whole) + right.cast(whole))
        return F.when(left.isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))

    best = nodes.join(wide.hint("merge"), ["head", "tail"]).withColumn("cut", F.least(*map(cut, range(1, DEPTH))))
    return best.select("head", "tail", "a", "cut.l", "cut.r", "cut.score")


def drop_contained(phrases: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``phrases`` without those inside a longer one of ``nodes`` that stands ``percent`` of their times or more."""
    inner = {n: [(i, j) for i in range(1, n) for j in range(i + 1, n + 1) if j - i + 1 < n] for n in (3, 4)}
    subs = F.when(_length() == 4, F.array(*[_phrase(*s) for s in inner[4]])).otherwise(F.array(*[_phrase(*s) for s in inner[3]]))
    most = nodes.where(_length() > 2).select(F.explode(subs).alias("sub"), "a").groupBy("sub.head", "sub.tail").agg(F.max("a").alias("longer"))
    big = "decimal(38,0)"
    kept = F.col("longer").isNull() | (F.col("longer").cast(big) * 100 < F.col("a").cast(big) * percent)
    return phrases.join(most.hint("merge"), ["head", "tail"], "left").where(kept).drop("longer")


def first_by(df: DataFrame, group: str, order: list[Column], k: int, spread: Column) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank`` from 1; first those of each share of a group, then of these."""
    n = partitions(df.sparkSession)
    shares = df.withColumn("_share", F.pmod(spread, F.lit(n)))
    some = shares.withColumn("rank", F.row_number().over(Window.partitionBy(group, "_share").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k).drop("_share")


def spelled(phrases: DataFrame, words: DataFrame, work: Workspace) -> DataFrame:
    """``phrases`` with their words, joined by spaces, as ``phrase``."""
    ids = phrases.select("head", "tail", F.posexplode(F.filter(F.array(*map(_word, range(1, DEPTH + 1))), lambda w: w > 0)).alias("at", "id"))
    ids = work.write(ids, "phrase-words")
    asked = ids.groupBy("id").agg(F.count(F.lit(1)).alias("asked"))
    known = work.write(words.select("id", "word").join(asked.hint("merge"), "id"), "phrase-word-texts")
    texts = spread_join(ids, known, ["id"], "asked").groupBy("head", "tail").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return phrases.join(texts.hint("merge"), ["head", "tail"]).withColumn("phrase", F.array_join("w.word", " ")).drop("w")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, percent: int = 80, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to four words that stands ``a`` >= ``least`` times scores floor(2000000 * a / (l + r)) at its
    lowest cut into a first part (``l`` times) and a rest (``r``); n is the number of the language's words.
    Phrases inside a longer one that stands ``percent`` of their times are left out.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "phrases")
    slices = work.write(encoded_slices(docs, lang, text), "slices")
    totals = slices.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    lists = slices.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("slice", "lang", (F.col("at") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = lists.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = work.write(numbered(words, work), "words")
    size = words.agg(F.sum("f")).first()[0] or 0  # suffixes that begin with a frequent word
    known = lists.drop("n").join(words.select("lang", "word", "id").hint("merge"), ["lang", "word"])
    known = known.groupBy("slice", "lang").agg(F.collect_list("local").alias("local"), F.collect_list("id").alias("known"))
    suffixes = slices.select("slice", "lang", "ids").join(known.hint("merge"), ["slice", "lang"]).select("ids", "local", "known").mapInArrow(_suffixes, _SUFFIXES)
    nodes = work.write(subtree_nodes(suffixes, max(partitions(spark), -(-size // BUDGET)), least), "nodes")
    phrases = drop_contained(lowest_cuts(nodes, words, work), nodes, percent)
    langs = words.select(F.col("id").alias("first"), "lang", "word")
    phrases = phrases.withColumn("first", _word(1))
    asked = phrases.groupBy("first").agg(F.count(F.lit(1)).alias("asked"))
    owners = work.write(langs.join(asked.hint("merge"), "first").select("first", "lang", "asked"), "owners")
    phrases = work.write(spread_join(phrases, owners, ["first"], "asked").drop("first"), "phrases")
    # only those that are not behind the last place by score and count have to be spelled
    order = [F.desc("score"), F.desc("a")]
    last = first_by(phrases, "lang", order, most, F.xxhash64("head", "tail")).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    able = phrases.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    ranked = first_by(spelled(able, words, work), "lang", [*order, F.asc("phrase")], most, F.xxhash64("phrase"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
