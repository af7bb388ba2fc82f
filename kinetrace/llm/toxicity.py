"""Counterfactually regularised toxicity classifier.

Features are words and word beginnings (so compounds of a slur share what they begin
with).  ``fit``

1. takes a bounded sample of labelled documents, whole texts, one row for each id
   (``MOST_ROWS`` rows, those of the least hash of their id, and of them in that order as
   many as have ``MOST_CELLS`` feature values; so the fit is small at any corpus size),
2. counts in Spark in how many toxic and clean documents each feature stands, and keeps
   the ``MOST_FEATURES`` whose log odds differ most surely, and the identity terms seen,
3. fits a logistic regression to them on the driver, over sparse rows whose number and
   width are bounded by 1 and 2, minimising

       weighted log loss + L2 * |w|^2 + COUNTERFACTUAL * mean (logit(text) - logit(text'))^2

   where logit is the score before the logistic function and text' is a labelled text in
   which an identity term and another one of its group have changed places.  A group's
   mention alone so cannot move the score, which keeps neutral mentions from false positives.

A document's value of a feature is (occurrences / words) ** POWER.

Defined results: null and empty texts score as a text without any feature; without
labelled rows, or with one class only, every score is the smoothed share of toxic rows,
0 without rows; rows with a null id or label teach nothing; a doc_id with several
labels counts as toxic if any says so, one with several texts teaches the first of them in
order; repeated rows score alike; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_slices, as_texts, free_name, slices

MOST_ROWS, MOST_CELLS, MOST_FEATURES, LEAST_DOCS, LEAST_Z = 20_000, 8_000_000, 8_192, 4, 2.5
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Bytes of text whose features are formed at once; every word has several, so it is less than elsewhere.
SLICE = 1 << 20
L2, COUNTERFACTUAL, STEPS, RATE, POWER = 1e-5, 5.0, 400, 0.1, 0.3
#: Identity terms by group; terms of a group are swapped for each other.
IDENTITY = (
    "women men",
    "woman man girl boy",
    "black white asian latino arab",
    "muslim christian jewish hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists",
    "gay straight lesbian bisexual transgender",
    "immigrant citizen refugee foreigner",
    "immigrants citizens refugees foreigners",
    "disabled deaf blind autistic",
    "frauen männer juden muslime christen ausländer",
    "femmes hommes juifs musulmans chrétiens étrangers",
    "mujeres hombres judíos musulmanes cristianos extranjeros",
)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each word, the distinct words, words of each text; words are lower-case runs of letters and digits."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}\s]+", " ")
    lists = pc.ascii_split_whitespace(plain)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    counts = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]])
    encoded = words.filter(pa.array(full)).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, counts


def _named(distinct: pa.Array, terms: pa.Array) -> list[pa.Array]:
    """Feature names of distinct words: the word, then its beginnings (null where the word is no longer or an identity term)."""
    whole, part, nothing, none = (pa.scalar(x, pa.large_string()) for x in ("=", "~", "", None))
    lengths, known = pc.utf8_length(distinct), pc.is_in(distinct, value_set=terms)
    names = [pc.binary_join_element_wise(distinct, whole, nothing)]
    for n in BEGINNINGS:
        use = pc.and_not(pc.greater(lengths, n), known)
        names.append(pc.if_else(use, pc.binary_join_element_wise(pc.utf8_slice_codeunits(distinct, 0, n), part, nothing), none))
    return names


def sparse_rows(texts: pa.Array, vocabulary: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every known feature of the texts."""
    codes, distinct, counts = _words(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    cells = []
    for names in _named(distinct, terms):
        found = pc.fill_null(pc.index_in(names, value_set=vocabulary, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        each = found[codes]
        hit = np.flatnonzero(each >= 0)
        cells.append(owner[hit] * len(vocabulary) + each[hit])
    cell, n = np.unique(np.concatenate(cells), return_counts=True)
    rows, features = np.divmod(cell, max(1, len(vocabulary)))
    return rows, features, (n / counts[rows]) ** POWER


@dataclass(frozen=True)
class Model:
    """Sorted feature names with their weights."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    identity: tuple[str, ...] = IDENTITY

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts (0 to 1), rounded to nine digits."""
        out = np.full(len(texts), self.bias)
        if self.features:
            vocabulary, weights, terms = pa.array(self.features, pa.large_string()), np.array(self.weights), _terms(self.identity)
            for a, b in slices(texts, SLICE):
                rows, features, values = sparse_rows(texts.slice(a, b - a), vocabulary, terms)
                out[a:b] += np.bincount(rows, weights[features] * values, b - a)
        return np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 9)


def _terms(groups: tuple[str, ...]) -> pa.Array:
    return pa.array(sorted({t for g in groups for t in g.split()}), pa.large_string())


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most ``most_rows`` labelled documents; labels (doc_id, toxic) are broadcast under that bound."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = docs.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))


def fit(rows: DataFrame, most_features: int = MOST_FEATURES, identity: tuple[str, ...] = IDENTITY, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fits the model to ``rows`` (doc_id, text, toxic), of which there should be a bounded number; see ``sample``."""
    n_toxic, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < n_toxic < n:
        share = (n_toxic + 0.5) / (n + 1) if n else 1e-13
        return Model((), (), float(np.log(share / (1 - share))), identity)
    terms = _terms(identity)

    def count(batches):
        for batch, texts in arrow_slices(batches, "text"):
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy().astype(np.int64)
            codes, distinct, counts = _words(texts)
            owner = np.repeat(np.arange(len(counts)), counts)
            for names in _named(distinct, terms):
                encoded = names.dictionary_encode()
                feature = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False)[codes]
                size = max(1, len(encoded.dictionary))
                cell = np.unique(owner[feature >= 0] * size + feature[feature >= 0])
                doc, feature = np.divmod(cell, size)
                in_all = np.bincount(feature, minlength=size)[: len(encoded.dictionary)]
                in_toxic = np.bincount(feature, toxic[doc], size)[: len(encoded.dictionary)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([encoded.dictionary.cast(pa.string()), pa.array(in_all), pa.array(in_toxic)], ["feature", "n", "n_toxic"])

    counts = rows.select("toxic", "text").mapInArrow(count, "feature string, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t"))
    t, c = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / c) - F.log(F.lit(n_toxic + 0.5) / F.lit(n - n_toxic + 0.5))
    strong = counts.where(f"n >= {LEAST_DOCS}").withColumn("z", odds / F.sqrt(1 / t + 1 / c)).where(f"abs(z) >= {LEAST_Z}")
    top = strong.orderBy(F.abs("z").desc(), "feature").limit(most_features).select("feature")
    mentioned = counts.where(F.col("feature").isin([f"{term}=" for term in terms.to_pylist()])).select("feature")
    names = sorted({r[0] for r in top.unionByName(mentioned).collect()})
    vocabulary = pa.array(names, pa.large_string())

    def vectors(batches):
        for batch, texts in arrow_slices(batches, "text", SLICE):
            row, feature, value = sparse_rows(texts, vocabulary, terms)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "toxic", "features", "values"])

    found = rows.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, features array<long>, values array<double>")
    found = Workspace(rows.sparkSession, "toxicity").write(found, "vectors")
    upto = F.sum(F.size("features")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # a row for each row of the sample
    chosen = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= MOST_CELLS).select("doc_id")
    found = found.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "features", "values").toArrow()
    found = found.sort_by("doc_id").combine_chunks()
    lists = found["features"].combine_chunks()
    row = np.repeat(np.arange(len(found)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    feature, value = lists.flatten().to_numpy(), found["values"].combine_chunks().flatten().to_numpy()
    weights, bias = _descend(row, feature, value, found["toxic"].to_numpy().astype(float), len(names), _swaps(row, feature, value, names, identity), counterfactual)
    return Model(tuple(names), tuple(weights.tolist()), bias, identity)


def _swaps(row: np.ndarray, feature: np.ndarray, value: np.ndarray, names: list[str], identity: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences between texts and their swapped forms, as sparse rows: each mentioned term changes places with every other of its group.

    So a text that has both terms has each one's value at the other's place; two terms of a text are one swap.
    """
    place = {name: i for i, name in enumerate(names)}
    others: dict[int, list[int]] = {}
    for group in identity:
        known = [place[f"{t}="] for t in group.split() if f"{t}=" in place]
        absent = len(known) < len(group.split())
        for i in known:
            others.setdefault(i, []).extend([j for j in known if j != i] + [-1] * absent)  # -1: a term never seen, of weight 0
    told = np.isin(feature, list(others))
    said = {(r, f): v for r, f, v in zip(row[told].tolist(), feature[told].tolist(), value[told].tolist())}
    pair, at, size = [], [], []
    k = 0
    for (r, f), v in said.items():
        for other in others[f]:
            there = said.get((r, other), 0.0)
            if there and other < f:
                continue
            pair += [k] * (1 + (other >= 0))
            at += [f, other] if other >= 0 else [f]
            size += [v - there, there - v] if other >= 0 else [v]
            k += 1
    return np.array(pair, np.int64), np.array(at, np.int64), np.array(size, float)


def _descend(row, feature, value, toxic, width: int, swaps, counterfactual: float) -> tuple[np.ndarray, float]:
    """Adam on the regularised loss; classes weigh alike up to a square root, so rare toxic rows count more."""
    n = len(toxic)
    weight = np.where(toxic > 0, np.sqrt((n - toxic.sum()) / toxic.sum()), 1.0)
    weight /= weight.sum()
    pair, at, size = swaps
    n_pairs = int(pair.max(initial=-1)) + 1
    w, b = np.zeros(width), float(np.log(toxic.sum() / (n - toxic.sum())))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[feature] * value, n), -30, 30)))
        error = weight * (p - toxic)
        gradient = np.append(np.bincount(feature, error[row] * value, width) + 2 * L2 * w, error.sum())
        if n_pairs:
            gap = np.bincount(pair, w[at] * size, n_pairs)
            gradient[:-1] += np.bincount(at, 2 * counterfactual * gap[pair] * size / n_pairs, width)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def toxicity(text: Column, model: Model) -> Column:
    """The score of each text as a column."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(as_texts(column)))

    return score(text)


def held_out(doc_id: Column) -> Column:
    """One in five documents, by the checksum of the id as text; never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_to(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits to the documents of ``docs`` that ``labels`` (doc_id, toxic) marks and that are not held out."""
    learnt = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    rows = sample(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), learnt)
    return fit(Workspace(docs.sparkSession, "toxicity").write(rows, "sample"))


def toxicity_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = toxicity(F.col(text), fit_to(docs, labels, doc_id, text))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    score = free_name(docs, "score")
    return docs.withColumn(score, toxicity(F.col(text), fit_to(docs, labels, doc_id, text))).where(F.col(score) < 0.5).drop(score)
