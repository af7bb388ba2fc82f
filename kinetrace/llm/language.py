"""Language of texts and of spans inside them: scripts narrow the candidates, Viterbi labels the words.

``fit`` takes a bounded sample of labelled texts (``SAMPLE`` rows of each language, those of
the least hash of their id; whole texts) and counts in Spark, for each language, the letter
sequences of one to four letters inside words, hashed to ``BUCKETS``, and the scripts of its words.
The model is a table of log probabilities, languages x buckets; it grows with the number of
languages, not with the corpus.

A text is a row of words: maximal runs of letters of one script, in pieces of ``WORD`` letters
at most (scripts without spaces).  A word's candidates are the languages that write its
script, all if none does; its score for a candidate is the sum of its sequences' log
probabilities.  Viterbi finds the labelling of greatest score sum, where each change of
language costs ``SWITCH``; neighbouring words of one label are a span.  The text's language
is the one whose spans hold the most letters (ties: the greater score sum, then the first by
name) and ``score`` is its share of all letters.

All texts of a slice advance together, one word a step; a text is never cut.

Defined results: null texts and texts without a letter are ``und`` with score 0, also all texts if
nothing can be learned; rows with a null id, language or text, or without a letter, teach
nothing; of several texts of one id and language the least teaches; repeated rows get
equal results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_slices, map_texts

#: Texts of each language that teach, at most.
SAMPLE = 1000
BUCKETS = 1 << 16
ORDERS = 4
WORD = 24
SWITCH = 12.0
#: Added to each count, so that no sequence is impossible.
SMOOTHING = 0.5
#: A language writes a script if this share of its words is in it.
WRITES = 0.01
#: Words x languages labelled at once: bounds the back pointers.
CELLS = 1 << 24

#: First and last code points of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x2FA1F),
)
NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]
_ORDERED = sorted(SCRIPTS, key=lambda s: s[1])
_FIRST = np.array([s[1] for s in _ORDERED])
_LAST = np.array([s[2] for s in _ORDERED])
_NAME = np.array([NAMES.index(s[0]) for s in _ORDERED])
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LATIN = regex.compile("[A-Za-zÀ-ɏ]+")


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script numbers of code points; marks and unknown letters are of the last script, "other"."""
    at = np.maximum(np.searchsorted(_FIRST, points, "right") - 1, 0)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]), _NAME[at], len(NAMES) - 1)


def _pieces(token: str) -> Iterator[str]:
    """The words of a token without white space."""
    for word in _LETTERS.findall(token):
        cuts = [0, len(word)]
        if not _LATIN.fullmatch(word):
            kinds = scripts_of(np.array([ord(c) for c in word]))
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(word)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for i in range(a, b, WORD):
                yield word[i : min(i + WORD, b)]


@dataclass
class Words:
    """The words of a slice: distinct ones, their letters and scripts, and those of each text in order."""

    distinct: list[str]
    script: np.ndarray
    letters: np.ndarray
    sequence: np.ndarray  # numbers of distinct words, all texts one after another
    bounds: np.ndarray


def words_of(texts: list[str]) -> Words:
    tokens: dict[str, int] = {}
    rows = [[tokens.setdefault(t, len(tokens)) for t in text.split()] for text in texts]
    number: dict[str, int] = {}
    inside = [[number.setdefault(w.lower(), len(number)) for w in _pieces(t)] for t in tokens]
    sizes = np.array([len(i) for i in inside], np.int64)
    flat = np.array([w for i in inside for w in i], np.int64)
    offsets = np.cumsum(sizes) - sizes
    used = np.array([t for row in rows for t in row], np.int64)
    many = sizes[used] if len(used) else used
    starts = np.cumsum(many) - many
    sequence = flat[np.repeat(offsets[used] - starts, many) + np.arange(int(many.sum()))] if len(flat) else flat
    per_text = np.array([len(r) for r in rows])
    bounds = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(per_text)])]
    distinct = list(number)
    script = scripts_of(np.array([ord(w[0]) for w in distinct], np.int64))
    return Words(distinct, script, np.array([len(w) for w in distinct], np.int64), sequence, bounds)


def sequences(distinct: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (word numbers, buckets) of the letter sequences of the words with their bounds, grouped by word."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in distinct).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = points == 2
    owner = np.cumsum(begins) - 1
    code = np.zeros(len(points), np.uint64)
    for n in range(1, ORDERS + 1):
        size = len(points) - n + 1
        if size <= 0:
            return
        code = code[:size] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        inside = owner[:size] == owner[n - 1 :]
        mixed = (code ^ code >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
        yield owner[:size][inside], (mixed[inside] % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    #: languages x buckets
    logs: np.ndarray
    #: scripts x languages: which languages a script leaves as candidates
    writes: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """distinct words x languages, -inf where the script rules a language out."""
        out = np.zeros((len(words.distinct), len(self.langs)))
        for owner, bucket in sequences(words.distinct):
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(owner, self.logs[j, bucket], len(words.distinct))
        out[~self.writes[words.script]] = -np.inf
        return out


def viterbi(scores: np.ndarray, words: Words, switch: float = SWITCH) -> np.ndarray:
    """Labels of all words: greatest sum of scores less ``switch`` for each change; ties keep the language, then take the first.

    A text whose words have no common candidate changes at the script's bounds, as it must.
    """
    lengths = np.diff(words.bounds)
    labels = np.zeros(len(words.sequence), np.int32)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = words.bounds[:-1][order], lengths[order]
    langs = scores.shape[1]
    a = 0
    while a < len(order) and lengths[a]:
        b = a + 1  # texts whose back pointers fit together
        while b < len(order) and (b - a + 1) * int(lengths[a]) * langs <= CELLS:
            b += 1
        first, size = starts[a:b], lengths[a:b]
        steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
        came = np.zeros((steps, b - a, langs), np.int16 if langs < 2**15 else np.int32)
        total = scores[words.sequence[first[: active[0]]]]
        end = np.zeros((b - a, langs))
        itself = np.arange(langs)
        for t in range(1, steps):
            m = active[t]
            if m < len(total):
                end[m : len(total)] = total[m:]
                total = total[:m]
            best = total.argmax(1)
            change = total[np.arange(m), best] - switch
            moved = change[:, None] > total
            came[t, :m] = np.where(moved, best[:, None], itself)
            total = np.where(moved, change[:, None], total) + scores[words.sequence[first[:m] + t]]
        end[: len(total)] = total
        now = end.argmax(1)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            labels[first[:m] + t] = now[:m]
            now[:m] = came[t, np.arange(m), now[:m]] if t else now[:m]
        a = b
    return labels


def predictions(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, Words, np.ndarray]:
    """Language and score of each text, its words and their labels."""
    words = words_of(texts)
    langs = model.langs if model else []
    if not langs or not len(words.sequence):
        return ["und"] * len(texts), np.zeros(len(texts)), words, np.zeros(len(words.sequence), int)
    scores = model.scores(words)
    labels = viterbi(scores, words)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    cell = owner * len(langs) + labels
    shape = (len(texts), len(langs))
    held = np.bincount(cell, words.letters[words.sequence], shape[0] * shape[1]).reshape(shape)
    sums = np.bincount(cell, scores[words.sequence, labels], shape[0] * shape[1]).reshape(shape)
    top = held == held.max(1, keepdims=True)
    best = np.where(top, sums, -np.inf).argmax(1)
    every = held.sum(1)
    names = [langs[i] if n else "und" for i, n in zip(best.tolist(), every.tolist(), strict=True)]
    return names, np.divide(held[np.arange(len(texts)), best], every, out=np.zeros(len(texts)), where=every > 0), words, labels


def _sample(labelled: DataFrame, size: int) -> DataFrame:
    """lang, text of at most ``size`` rows of each language, those of the least hash of their id; one for each id and language.

    Hashes are even, so rows behind twice the wanted share are left before any text is shuffled.  The counts are
    broadcast: they have a row for each language, as the model has.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    counts = labelled.groupBy("lang").agg(F.count_distinct("id").alias("n"))
    near = labelled.join(F.broadcast(counts), "lang").where(place * F.col("n") <= F.lit(1 << 40) * (2.0 * size + 100))
    single = near.groupBy("lang", "id").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))
    return single.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "text")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of ``labelled``: lang, id, text without nulls; None if it has no letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in arrow_slices(batches, "text"):
            langs, bodies = rows.column(0).to_pylist(), texts.to_pylist()
            for lang in sorted(set(langs)):
                words = words_of([t for name, t in zip(langs, bodies, strict=True) if name == lang])
                times = np.bincount(words.sequence, minlength=len(words.distinct))
                found = np.zeros(ORDERS * BUCKETS + len(NAMES))
                for n, (owner, bucket) in enumerate(sequences(words.distinct)):
                    found += np.bincount(bucket + n * BUCKETS, times[owner], len(found))
                found += np.bincount(words.script + ORDERS * BUCKETS, times, len(found))
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], names=["lang", "cell", "n"])

    cells = _sample(labelled, sample).mapInArrow(count, "lang string, cell long, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(cells["lang"]))
    if not langs:
        return None
    table = np.zeros((len(langs), ORDERS * BUCKETS + len(NAMES)))
    table[np.searchsorted(langs, cells["lang"]), cells["cell"]] = cells["n"]
    grams = table[:, : ORDERS * BUCKETS].reshape(len(langs), ORDERS, BUCKETS)
    kinds = int((grams.sum(0) > 0).sum(1).max())
    # orders share the buckets: a sequence's order is in its hash, and collisions are rare
    logs = np.log(grams.sum(1) + SMOOTHING) - np.log(grams.sum((1, 2)) / ORDERS + SMOOTHING * kinds)[:, None]
    scripts = table[:, ORDERS * BUCKETS :].T
    writes = scripts >= WRITES * scripts.sum(0)
    writes[~writes.any(1)] = True
    return Model(langs, logs.astype(np.float32), writes)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model | None:
    """The model of the rows of ``docs`` that teach: the checksum of their id modulo 4 is not 2."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("id"), "text").where("lang is not null and id is not null and text is not null")
    return fit(rows.where(~_held_out(F.col("id"))))


def language_spans(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span of one language: doc_id, span (from 0), lang, first_word, words, letters."""
    shared = _shared(docs, model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        known = shared()
        _, _, words, labels = predictions(known, texts.to_pylist())
        owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        begins = np.flatnonzero(np.r_[True, (np.diff(owner) > 0) | (np.diff(labels) != 0)]) if known and len(owner) else np.zeros(0, int)
        who = owner[begins]
        heads = np.flatnonzero(np.r_[True, np.diff(who) > 0]) if len(who) else np.zeros(0, int)
        number = np.arange(len(who)) - np.repeat(heads, np.diff(np.r_[heads, len(who)]))
        letters = np.add.reduceat(words.letters[words.sequence], begins) if len(begins) else begins
        names = [known.langs[i] for i in labels[begins].tolist()] if known else []
        columns = [rows.column(0).take(pa.array(who)), number, pa.array(names, pa.string()), begins - words.bounds[who], np.diff(np.r_[begins, len(owner)]) if len(begins) else begins, letters]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns], names=["doc_id", "span", "lang", "first_word", "words", "letters"])

    schema = f"doc_id {kind}, span long, lang string, first_word long, words long, letters long"
    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, schema)


def _shared(docs: DataFrame, model: Model | None):
    """The model inside tasks; broadcast, as its size is that of the languages times ``BUCKETS``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return functools.partial(getattr, sent, "value")


def language_report(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    shared = _shared(docs, model)

    def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        names, scores, _, _ = predictions(shared(), texts.to_pylist())
        return pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return map_texts(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
