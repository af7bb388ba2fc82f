"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into words, each a run of space marks with what follows up to the next
one; no piece crosses such a cut.  Distinct words of equal length (in code points)
advance together, one end position at a time: the hashes of all substrings that end
there are looked up in the sorted hashes of the pieces, candidate scores are formed for
all words and lengths at once, and a maximum over the lengths stores the backpointer.
Of equally good segmentations the one whose last piece is longest wins, at every position.

The segmentation is the one of greatest score sum (unigram semantics), whatever kind of
model the pieces come from: for a file trained by pair merging, whose scores are negated
ranks, ids can so differ from those that replaying the merges would give.  Characters
that no piece covers are spelt in byte pieces.

Defined results: null and empty texts have no ids; decoding restores a text exactly,
except that the space mark U+2581 inside a text becomes a space.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_texts, free_name, slices
from .sentencepiece_model import BYTE, NORMAL, USER_DEFINED, PieceModel

SPACE = "\u2581"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS, BATCH = 200_000, 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a word to a row."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _SALT
    return h ^ (h >> np.uint64(33))


class Segmenter:
    """Encodes and decodes with the pieces of a model file; remembers at most twice ``memo`` words."""

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        model = PieceModel.load(path)
        if not model.plain:
            raise ValueError("only models that take texts as they are can be used: no character map, no white-space folding")
        usable = [i for i, k in enumerate(model.kinds) if k in (NORMAL, USER_DEFINED)]
        if any(SPACE in model.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece crosses a word boundary")
        self.model, self.memo = model, memo
        self.byte_ids = np.full(256, -1)
        for i, kind in enumerate(model.kinds):
            if kind == BYTE:
                self.byte_ids[int(model.pieces[i][1:-1], 16)] = i
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == 2), 0)
        self.unknown_score = min((model.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(lambda i: len(model.pieces[i]), usable), default=1)
        hashes = np.array([self._hash(model.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usable)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.scores = np.array(model.scores)[self.ids]
        self.points = np.zeros((len(self.ids), self.longest), np.uint32)
        for row, i in enumerate(self.ids.tolist()):
            self.points[row, : len(model.pieces[i])] = _points([model.pieces[i]])
        spelt = [self._bytes(p, k) for p, k in zip(model.pieces, model.kinds)]
        self.spelling, self.sizes = np.frombuffer(b"".join(spelt), np.uint8), np.array(list(map(len, spelt)))
        self.places = np.cumsum(self.sizes) - self.sizes
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.probe = np.zeros(1 << 20, bool)  # by the hash's low bits: whether a key may be there
        self.probe[self.keys & np.uint64((1 << 20) - 1)] = True

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED) else b""

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in _points([piece])[0]:
            h = (h + np.uint64(c) + np.uint64(1)) * _BASE
        return _finish(h)[0]

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: a character without piece) and starts of the best pieces that end at each position, for words of one length."""
        n, length = points.shape
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        start, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int64)
        rows = np.arange(n)
        rolling = np.zeros((n, 0), np.uint64)
        for end in range(1, length + 1):
            # column k: hash of the substring from position first + k to here
            rolling = np.concatenate([rolling, np.zeros((n, 1), np.uint64)], 1)[:, -self.longest :]
            rolling = (rolling + points[:, end - 1 : end] + np.uint64(1)) * _BASE
            first = end - rolling.shape[1]
            hashes = _finish(rolling)
            maybe = np.nonzero(self.probe[hashes & np.uint64((1 << 20) - 1)])
            found = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            same = self.keys[found] == hashes[maybe]
            word, column, found = maybe[0][same], maybe[1][same], found[same]
            for offset in range(self.longest):  # equal hashes are confirmed on the characters
                inside = first + column + offset < end
                at = np.minimum(first + column + offset, length - 1)
                equal = (self.points[found, offset] == points[word, at]) | ~inside
                if not equal.all():
                    word, column, found = word[equal], column[equal], found[equal]
            score = np.full(hashes.shape, -np.inf)
            which = np.full(hashes.shape, -1, np.int64)
            score[word, column] = best[word, first + column] + self.scores[found]
            which[word, column] = self.ids[found]
            single = which[:, -1] < 0
            score[single, -1] = best[single, end - 1] + self.unknown_score
            choice = score.argmax(1)  # the first of equals: the longest piece
            best[:, end], start[:, end], piece[:, end] = score[rows, choice], first + choice, which[rows, choice]
        return piece, start

    def _segment(self, words: list[str]) -> None:
        """Learns the ids of words of one length."""
        points = _points(words)
        piece, start = self.viterbi(points)
        n, length = points.shape
        at, rows = np.full(n, length), np.arange(n)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            begin = start[rows, at]
            out.append((rows, piece[rows, at], points[rows, begin]))
            rows, at = rows[begin > 0], begin[begin > 0]
        steps = np.concatenate([np.full(len(r), k) for k, (r, _, _) in enumerate(out)])
        row, ids, point = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((-steps, row))
        row, ids, point = row[order], ids[order], point[order]
        if (ids < 0).any():
            spelt = [self._spell(c) if i < 0 else [i] for i, c in zip(ids.tolist(), point.tolist())]
            row = np.repeat(row, list(map(len, spelt)))
            ids = np.fromiter(chain.from_iterable(spelt), np.int64)
        cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
        raw = ids.astype("<i4").tobytes()
        for word, a, b in zip(words, cuts, cuts[1:]):
            self.young[word] = raw[4 * a : 4 * b]

    def _spell(self, point: int) -> list[int]:
        spelt = self.byte_ids[list(chr(point).encode())].tolist() if self.model.byte_fallback else [-1]
        return [self.unknown] if min(spelt) < 0 else spelt

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the count of each text."""
        full = pc.greater(pc.binary_length(texts), 0)
        marked = pc.replace_substring(texts, " ", SPACE)
        if self.model.add_dummy_prefix:
            marked = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), marked, pa.scalar("", pa.large_string())), marked)
        # a cut is set before each space mark that follows another character
        cut = pc.replace_substring_regex(marked, f"([^{SPACE}]){SPACE}", "\\1\x00" + SPACE)
        plain = pc.invert(pc.match_substring(texts, "\x00"))  # texts that hold the cut character are cut one by one below
        lists = pc.split_pattern(pc.if_else(plain, cut, ""), "\x00")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        flat, counts = self._lookup(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = words.indices.to_numpy(zero_copy_only=False)
        begins, each = np.cumsum(counts) - counts, counts[codes]
        before = np.cumsum(each) - each
        ids = flat[np.repeat(begins[codes] - before, each) + np.arange(int(each.sum()))]
        totals = np.diff(np.concatenate([[0], np.cumsum(each)])[offsets - offsets[0]])
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(odd):
            ends = np.concatenate([[0], np.cumsum(totals)])
            parts, at = [], 0
            for i in odd.tolist():
                found, _ = self._lookup_list(self._cut(marked[i].as_py()))
                parts += [ids[ends[at] : ends[i]], found]
                totals[i], at = len(found), i
            ids = np.concatenate([*parts, ids[ends[at] :]])
        return ids, totals

    @staticmethod
    def _cut(marked: str) -> list[str]:
        cuts = [0] + [i for i in range(1, len(marked)) if marked[i] == SPACE != marked[i - 1]] + [len(marked)]
        return [marked[a:b] for a, b in zip(cuts, cuts[1:])]

    def _lookup_list(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        distinct = list(dict.fromkeys(words))
        flat, counts = self._lookup(distinct)
        ends = np.cumsum(counts)
        place = {w: flat[e - c : e] for w, e, c in zip(distinct, ends.tolist(), counts.tolist())}
        return np.concatenate([place[w] for w in words]) if words else flat[:0], counts

    def _lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.young) > self.memo:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        fresh: dict[int, list[str]] = {}
        for word in words:
            if word not in young:
                if (known := old.get(word)) is not None:
                    young[word] = known
                else:
                    fresh.setdefault(len(word), []).append(word)
        for length, group in fresh.items():
            step = max(1, BATCH * 16 // max(16, length))
            for i in range(0, len(group), step):
                self._segment(group[i : i + step])
        found = [young[w] for w in words]
        return np.frombuffer(b"".join(found), "<i4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of ids one after another; control pieces are left out."""
        size = self.sizes[ids]
        before = np.cumsum(size) - size
        raw = self.spelling[np.repeat(self.places[ids] - before, size) + np.arange(int(size.sum()))].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        skip = self.model.add_dummy_prefix
        return [raw[a + (skip and raw[a : a + 1] == b" " and a < b) : b] for a, b in zip(ends, ends[1:])]


_LOADED: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    """One per worker process and model file."""
    if path not in _LOADED:
        _LOADED[path] = Segmenter(path)
    return _LOADED[path]


def piece_ids(text: Column, path: str) -> Column:
    """The ids of each text as an array column."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        texts, arrays = as_texts(column), []
        for a, b in slices(texts):
            ids, counts = segmenter(path).encode(texts.slice(a, b - a))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.concat_arrays(arrays) if arrays else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def piece_text(ids: Column, path: str) -> Column:
    """The text of each array of ids; null stays null."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        full = pc.fill_null(column, pa.scalar([], column.type))
        counts = pc.list_value_length(full).to_numpy(zero_copy_only=False)
        texts = segmenter(path).decode(full.flatten().to_numpy(zero_copy_only=False), counts)
        return pa.array([t.decode("utf-8", "replace") if known else None for t, known in zip(texts, column.is_valid().to_pylist())], pa.string())

    return decode(ids)


def piece_report(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), restored (decoding gives the text) of every whole text."""

    @F.arrow_udf("struct<n_pieces:long,ids_crc32:long,restored:boolean>")
    def report(column: pa.Array) -> pa.Array:
        texts, sizes, sums, same = as_texts(column), [], [], []
        for a, b in slices(texts):
            ids, counts = segmenter(path).encode(texts.slice(a, b - a))
            raw, ends = memoryview(ids.astype("<i4")).cast("B"), np.cumsum(counts)
            sizes += counts.tolist()
            wanted = pc.replace_substring(texts.slice(a, b - a), SPACE, " ").cast(pa.large_binary()).to_pylist()
            same += [x == y for x, y in zip(segmenter(path).decode(ids, counts), wanted)]
            sums += [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], ["n_pieces", "ids_crc32", "restored"])

    found = free_name(docs, "found")
    return docs.withColumn(found, report(F.col(text))).select(F.col(doc_id).alias("doc_id"), f"{found}.*")
