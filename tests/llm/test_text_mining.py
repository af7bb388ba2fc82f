"""Phrases, periodic runs and languages: brute force, odd rows, held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import language, periodic, phrases
from kinetrace.llm.queries import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, head string, id int, word int, `rank` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "h", 1, 2, 3) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 12)):
        some = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 7))]
        words += some * rng.choice([1, 1, 2, 4, 5, 9])
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    found = 0
    for _ in range(1500):
        texts = [repetitive(rng) for _ in range(3)]
        want = [brute_runs(t) for t in texts]
        assert periodic.find_runs(texts) == want
        found += sum(map(len, want))
    assert found > 2000


def test_runs_of_hostile_texts_are_quick():
    fibonacci, last = "ab", "a"
    while len(fibonacci) < 60_000:
        fibonacci, last = fibonacci + last, fibonacci
    begun = time.process_time()
    assert periodic.find_runs([["a"] * 200_000]) == [[(0, 200_000, 1)]]
    assert periodic.find_runs([[str(i) for i in range(3000)] * 40]) == [[(0, 120_000, 3000)]]
    assert periodic.find_runs([[str(i) for i in range(100_000)]]) == [[]]
    periodic.find_runs([list(fibonacci)])
    assert time.process_time() - begun < 20


def test_a_segment_splits_where_words_are_rare():
    words = "x a b a b a b a b y a b z".split()
    ids = np.array([words.index(w) for w in words])
    assert periodic.split_segments(ids, np.array([0, len(ids)])).tolist() == [[1, 9]]


def test_run_report_and_collapse(spark, nothing):
    rng = random.Random(8)
    rows = [(i, " \t\n".join(repetitive(rng)), None) for i in range(150)]
    rows += [(7, rows[7][1], None), (None, "a b " * 6, None), (500, None, None), (501, "", None), (502, " \x0b ", None), (503, "é " * 9, "fr")]
    docs = frame(spark, rows)
    want = Counter()
    for i, text, _ in rows:
        words = (text or "").encode().split()
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
        runs = brute_runs(words)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for x, w in enumerate(words) if x not in gone)
        want[i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, periodic.run_report(docs).collect())) == want
    collapsed = periodic.collapse_runs(docs)
    assert collapsed.columns == docs.columns
    texts = [r.text for r in collapsed.collect() if r.doc_id in (503, 500, None)]
    assert sorted(map(str, texts)) == ["None", "a b", "é"]
    listed = {(r.doc_id, r.start, r.length, r.period) for r in periodic.periodic_runs(docs).collect()}
    assert (503, 0, 9, 1) in listed and (None, 0, 12, 2) in listed
    for f in (periodic.run_report, periodic.periodic_runs, periodic.collapse_runs):
        assert f(nothing).count() == 0


def brute_phrases(rows, least, percent, most):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i : i + n])] += 1
    out = defaultdict(list)
    longer = defaultdict(int)
    good = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    for (lang, w), a in good.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], a)
    for (lang, w), a in good.items():
        if 100 * longer[lang, w] >= percent * a:
            continue
        cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return {(lang, i, g.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, g, left, right) in enumerate(sorted(found)[:most], 1)}


@pytest.fixture(scope="module")
def told():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)] + ["ÉTÉ", "A\x01b", "a", "A"]
    rows = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 80)))
        rows.append((i, rng.choice(["", "New York City hall. "]) * rng.randint(0, 3) + text, rng.choice(["en", "en", "fr", None])))
    return [*rows, rows[5], rows[5], (None, None, "en"), (900, "", "fr"), (901, " ... ", None), (902, "w1 w2 w3 w4 " * 400, "de")]


@pytest.mark.parametrize("most", [2000, 7])
def test_phrases_equal_brute_force(spark, told, most, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 2000)  # many slices
    monkeypatch.setattr(phrases, "BUDGET", 500)  # many ranges
    got = phrases.collocations(frame(spark, told), least=6, most=most).collect()
    want = brute_phrases(told, 6, 80, most)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 15


def test_phrases_of_nothing(spark, nothing):
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_subtree_over_batches_and_ranges_equals_sums():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5, 4000)
    head, tail, n = phrases.suffix_counts(ids)
    want = Counter()
    for i in range(len(ids)):
        for k in (2, 3, 4):
            some = ids[i : i + k]
            if len(some) == k and some.all():
                want[tuple(some.tolist())] += 1
    got = Counter()
    cuts = np.unique(rng.integers(0, len(head), 20))
    for part in np.split(np.arange(len(head)), cuts):  # ranges
        tree = phrases.Subtree(least=50)
        nodes = [x for some in np.array_split(part, 3) for x in tree.add(head[some], tail[some], n[some])] + tree.close()
        for h, t, c in nodes:
            for a, b, m in zip(h.tolist(), t.tolist(), c.tolist()):
                got[tuple(x for x in (a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF) if x)] += m
    assert {w: m for w, m in got.items() if m >= 50} == {w: m for w, m in want.items() if m >= 50}


def brute_labels(scores, switch):
    """The greatest sum over all labellings, by plain dynamic programming."""
    best = [float(x) for x in scores[0]]
    for row in scores[1:]:
        best = [max(b - (switch if j != i else 0) for j, b in enumerate(best)) + row[i] for i in range(len(row))]
    return max(best)


def test_viterbi_equals_plain_dynamic_programming():
    rng = np.random.default_rng(5)
    scores = rng.normal(0, 5, (40, 3))
    scores[rng.random(scores.shape) < 0.2] = -np.inf
    scores[np.isinf(scores).all(1), 0] = 0
    lengths = rng.integers(0, 30, 50)
    sequence = rng.integers(0, 40, int(lengths.sum()))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    words = language.Words([str(i) for i in range(40)], np.zeros(40, int), np.ones(40, int), sequence, bounds)
    for cells in (1 << 24, 60):  # at once, and in parts
        before, language.CELLS = language.CELLS, cells
        labels = language.viterbi(scores, words, 4.0)
        language.CELLS = before
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a < b:
                mine, rows = labels[a:b], scores[sequence[a:b]]
                total = rows[np.arange(b - a), mine].sum() - 4.0 * (np.diff(mine) != 0).sum()
                assert total == pytest.approx(brute_labels(rows, 4.0))


def test_words_have_one_script_and_bounded_length():
    words = language.words_of(["Straße, l'été (don't) 42 ABC漢字kana かな", "", "x" * 60, "12 _ ²"])
    own = [[words.distinct[i] for i in words.sequence[a:b]] for a, b in zip(words.bounds[:-1], words.bounds[1:])]
    assert own[0] == ["straße", "l", "été", "don", "t", "abc", "漢字", "kana", "かな"] and own[1] == own[3] == []
    assert [len(w) for w in own[2]] == [24, 24, 12]


LANGS = {"en": "the cat sat with this thing and that other one where they think", "fr": "le chat est avec cette chose et que les autres ou ils pensent", "el": "η γάτα κάθισε με αυτό το πράγμα και το άλλο", "ru": "кот сидел с этой вещью и другой где они думают"}


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(sorted(LANGS) * 40)]


def test_language_of_texts_and_spans(spark, labelled, nothing):
    docs = frame(spark, [*labelled, (1000, "teaches nothing", None), (None, "neither does this", "xx"), (1001, None, "en"), (1002, "42 !", "zz"), labelled[0]])
    model = language.fit_documents(docs)
    assert model.langs == sorted(LANGS)
    mixed = " ".join(" ".join(LANGS[x].split()[:9]) for x in ("en", "fr", "ru", "en"))
    asked = frame(spark, [(1, mixed, None), (2, None, "en"), (3, "7 -", "fr"), (4, "", None), (None, "Кот и кот", None), (6, "ՀԱՅ", None), (7, "ὁ ἄλλος"[:3] + " γάτα", None)])
    got = {r.doc_id: r for r in language.language_report(asked, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None, 7)] == ["en", "und", "und", "und", "ru", "el"]
    assert got[2].score == 0 and 0.4 < got[1].score < 0.6 and got[None].score == 1 and got[6].lang_pred in LANGS and got[None].held_out is False
    spans = sorted(tuple(r) for r in language.language_spans(asked, model).where("doc_id = 1").collect())
    assert [(s[1], s[2], s[3], s[4]) for s in spans] == [(0, "en", 0, 9), (1, "fr", 9, 9), (2, "ru", 18, 9), (3, "en", 27, 9)]
    assert language.language_report(nothing, model).count() == 0 and language.language_spans(nothing, model).count() == 0
    assert language.fit_documents(nothing) is None
    alone = language.language_report(asked, None).collect()
    assert {r.lang_pred for r in alone} == {"und"} and language.language_spans(asked, None).count() == 0


def test_language_learns_only_from_its_share(spark, labelled):
    """Rows that are held out may say anything."""
    told = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in labelled]
    docs = frame(spark, told)
    assert language.fit_documents(docs).langs == sorted(LANGS)
    held = {r.doc_id for r in language.language_report(docs, None).collect() if r.held_out}
    assert held == {i for i, _, _ in told if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_sample_is_bounded(spark, labelled):
    rows = [(i, t, lang) for i, t, lang in labelled] * 3
    docs = frame(spark, rows).select("lang", F.col("doc_id").alias("id"), "text")
    kept = language._sample(docs, 10).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in kept} == dict.fromkeys(LANGS, 10)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries()["op13_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, every = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert every > 200 and right / every > 0.98


def test_salts_do_not_depend_on_where_rows_are(spark):
    """The same rows in other partitions and another order get the same salts, and they are spread evenly."""
    from kinetrace.llm.common import salt

    rows = spark.range(3000).select("id", F.lit(7).alias("k"), F.array("id").alias("a"), F.create_map(F.lit("m"), F.col("id")).alias("m"), F.struct("id").alias("s"))
    found = [{r["id"]: r.salt for r in some.select("id", salt(some, ["k"], F.lit(6)).alias("salt")).collect()} for some in (rows, rows.repartition(7, "id"), rows.orderBy(F.desc("id")).coalesce(2))]
    assert found[0] == found[1] == found[2] and min(Counter(found[0].values()).values()) > 400 and set(found[0].values()) == set(range(6))
