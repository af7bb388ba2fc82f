"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
and at least max(``LEAST_WORDS``, ``TIMES`` * q) words, which no neighbouring word extends.

1. Splitting.  A run of period q has each of its words at least ``TIMES`` times.  So a word
   that stands less often in the current segment is in no run of it and splits the segment
   there; the pieces are counted again, until no segment changes.  A text without runs
   mostly falls apart in a few rounds.
2. Lag scan.  In a segment that is left, the lag q compares words q apart.  A run gives at
   least (TIMES - 1) * q equal pairs in a row, so it is enough to probe every so many-th
   pair: m words cost about m / 3 * log(m) probes over all lags, not m * m.  A probe that
   hits is extended to the maximal stretch.  A hit inside a known run whose period divides
   the lag gives that run again (by Fine and Wilf) and is left out; of equal stretches the
   least lag, which comes first, is the smallest period.

Both steps work on all texts of a slice at once; a text is never cut.  A hostile text could
make the recursion long: it ends early once it has counted ``MOST_PASSES`` times all words,
as the scan is exact on any segment.

Defined results: a null text counts as empty; a text without words has no runs; words are
separated by the six ASCII white-space characters; repeated rows each give their row; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, free_name, map_texts

TIMES, LEAST_WORDS = 4, 6
#: The splitting counts each word of a slice this often at most.
MOST_PASSES = 64
#: Probes formed at once.
PROBES = 1 << 19
#: Single steps by which hits are extended together; what is left after them is extended alone.
TOGETHER = 8
#: Runs of so many words are remembered to leave out hits of multiples of their period.
LONG_RUN = 64


def split_segments(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Segments (start, end) that can hold runs, in order; ``bounds`` are the ends of the texts in ``words``, with a leading 0."""
    at = np.arange(len(words))
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    vocabulary = int(words.max()) + 1 if len(words) else 1
    settled, work = [], MOST_PASSES * len(words)
    while len(at):
        work -= len(at)
        _, which, counts = np.unique(segment * vocabulary + words[at], return_inverse=True, return_counts=True)
        rare = counts[which] < TIMES
        open_ = np.zeros(int(segment[-1]) + 1, bool)
        open_[segment[rare]] = True  # segments that this round splits
        if work < 0:
            open_[:] = False
            rare[:] = False
        at, segment = at[~rare], segment[~rare]
        if not len(at):
            break
        begins = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(segment) > 0)])
        ends = np.r_[begins[1:], len(at)]
        wide = ends - begins >= LEAST_WORDS
        stable = wide & ~open_[segment[begins]]
        settled.append(np.stack([at[begins[stable]], at[ends[stable] - 1] + 1], 1))
        again = wide & open_[segment[begins]]
        sizes = (ends - begins)[again]
        keep = np.repeat(again, ends - begins)
        at, segment = at[keep], np.repeat(np.arange(len(sizes)), sizes)
    found = np.concatenate(settled) if settled else np.zeros((0, 2), int)
    return found[np.argsort(found[:, 0])]


def _probes(segments: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of probes (position, lag, segment start, segment end) with the lags rising from block to block and inside each."""
    sizes = segments[:, 1] - segments[:, 0]
    lag = 1
    widest = int(sizes.max()) // TIMES if len(sizes) else 0
    while lag <= widest:
        lags, owner, number, total = [], [], [], 0
        while lag <= widest and total < PROBES:
            fit = np.flatnonzero(sizes >= max(LEAST_WORDS, TIMES * lag))
            step = max((TIMES - 1) * lag, LEAST_WORDS - lag)
            many = -(-(sizes[fit] - lag) // step)
            lags.append(np.full(len(fit), lag))
            owner.append(fit)
            number.append(many)
            total += int(many.sum())
            lag += 1
        number, owner, lags = np.concatenate(number), np.concatenate(owner), np.concatenate(lags)
        turn = np.arange(total) - np.repeat(np.cumsum(number) - number, number)
        lags, owner = np.repeat(lags, number), np.repeat(owner, number)
        step = np.maximum((TIMES - 1) * lags, LEAST_WORDS - lags)
        low, high = segments[owner, 0], segments[owner, 1]
        yield low + turn * step, lags, low, high


def _stretch(words: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The maximal stretch of positions around ``at`` whose word equals the one ``lag`` later, compared in growing blocks."""
    end, size = at, 64
    while end + lag < high:
        stop = min(end + size, high - lag)
        unlike = np.flatnonzero(words[end:stop] != words[end + lag : stop + lag])
        if len(unlike):
            end += int(unlike[0])
            break
        end, size = stop, size * 2
    begin, size = at, 64
    while begin > low:
        stop = max(begin - size, low)
        unlike = np.flatnonzero(words[stop:begin] != words[stop + lag : begin + lag])
        if len(unlike):
            begin = stop + int(unlike[-1]) + 1
            break
        begin, size = stop, size * 2
    return begin, end


class _Known:
    """Long runs found so far, to tell which of them reaches furthest over a position."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []
        self.sorted = 0

    def covers(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Whether a known run, whose period divides the lag, holds a position and the one ``lag`` later."""
        if not self.runs:
            return np.zeros(len(at), bool)
        if self.sorted < len(self.runs):
            runs = np.array(sorted(self.runs))
            reach = np.maximum.accumulate(runs[:, 1])
            newest = np.maximum.accumulate(np.where(runs[:, 1] == reach, np.arange(len(runs)), 0))
            self.starts, self.ends, self.periods, self.sorted = runs[:, 0], reach, runs[newest, 2], len(runs)
        i = np.searchsorted(self.starts, at, "right") - 1
        j = np.maximum(i, 0)
        return (i >= 0) & (at + lag < self.ends[j]) & (lag % self.periods[j] == 0)


def scan_lags(words: np.ndarray, segments: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of the segments, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    known = _Known()
    for at, lag, low, high in _probes(segments):
        hit = np.flatnonzero((words[at] == words[at + lag]) & ~known.covers(at, lag))
        at, lag, low, high = at[hit], lag[hit], low[hit], high[hit]
        left, right = at.copy(), at.copy()
        more_left, more_right = np.ones(len(at), bool), np.ones(len(at), bool)
        for _ in range(TOGETHER):
            step = np.where(more_right & (right + 1 + lag < high), right + 1, right)
            more_right &= (step > right) & (words[step] == words[np.minimum(step + lag, len(words) - 1)])
            right = np.where(more_right, step, right)
            step = np.where(more_left & (left > low), left - 1, left)
            more_left &= (step < left) & (words[step] == words[step + lag])
            left = np.where(more_left, step, left)
        needed = np.maximum(LEAST_WORDS, TIMES * lag) - lag
        going = np.flatnonzero(more_left | more_right | (right - left + 1 >= needed))
        at, lag, low, high = at[going], lag[going], low[going], high[going]
        cuts = np.flatnonzero(np.r_[True, np.diff(lag) > 0, True]) if len(lag) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            q = int(lag[a])
            order = np.argsort(at[a:b], kind="stable") + a
            order = order[~known.covers(at[order], lag[order])]
            done = -1
            for i in order.tolist():
                x = int(at[i])
                if x < done:
                    continue
                begin, end = _stretch(words, x, q, int(low[i]), int(high[i]))
                done = end
                if end - begin + q >= max(LEAST_WORDS, TIMES * q) and (begin, end + q) not in found:
                    found[begin, end + q] = q
                    if end + q - begin >= LONG_RUN:
                        known.runs.append((begin, end + q, q))
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda run: (run[0], run[2]))


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, given as lists of words, by start, then period."""
    bounds = np.cumsum([0, *map(len, texts)])
    number: dict = {}
    words = np.fromiter((number.setdefault(w, len(number)) for text in texts for w in text), np.int64, int(bounds[-1]))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = scan_lags(words, split_segments(words, bounds))
    owners = np.searchsorted(bounds, [r[0] for r in found], "right") - 1
    for (begin, end, period), owner in zip(found, owners.tolist(), strict=True):
        runs[owner].append((begin - int(bounds[owner]), end - begin, period))
    return runs


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, int)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per run of every text: doc_id, start, length, period (words, from 0)."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, start long, length long, period long"

    def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        runs = find_runs([t.encode().split() for t in texts.to_pylist()])
        owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), *map(pa.array, flat.T)], names=["doc_id", "start", "length", "period"])

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, schema)


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``; a text with runs keeps the first period of each, its words joined by one space; others, null too, stay as they are."""
    place = docs.columns.index(text)
    names = [free_name(docs, f"c{i}") for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # names that differ in case only cannot clash

    def run(batches):
        for rows, texts in arrow_slices(batches, names[place]):
            split = [t.encode().split() for t in texts.to_pylist()]
            found = find_runs(split)
            new = [b" ".join(kept_words(w, r)).decode() if r else old for w, r, old in zip(split, found, rows.column(place).to_pylist(), strict=True)]
            yield rows.set_column(place, rows.schema.field(place), pa.array(new, rows.schema.field(place).type))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def looped(words: list, doc_id: int | None) -> list:
    """Every tenth document by checksum of its id, its words from some place on repeated: 3 to 10 turns, whole or not."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its runs' digests, after ``looped``; a null doc_id is never looped."""
    names = [f.split()[0] for f in REPORT.split(", ")]

    def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        ids = rows.column(0).to_pylist()
        split = [looped(t.encode().split(), i) for t, i in zip(texts.to_pylist(), ids, strict=True)]
        out = []
        for i, words, runs in zip(ids, split, find_runs(split), strict=True):
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            best = (start, length, period, 1000 * length // period if runs else None)
            out.append((i, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        columns = zip(*out, strict=True) if out else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), work, REPORT)
