"""Every operator on small tables with nulls, ties, repeated rows, long texts and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_units import contract_spans
from tokenizers import Tokenizer

import corpus_pipeline
from kinetrace.llm import chat, exact, html_extract, media, minhash, packing, pieces, pii, token_file, toxicity
from kinetrace.llm.common import Workspace, spread_join
from kinetrace.llm.queries import oracle_sql, queries, vocabulary

SF = "/root/testdata/sf0.001"
WORD = "word_bpe_49k.json"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, score string, `group` int, found int, lead int"


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = ["Same text", "same TEXT", "É", "é", "", None, " \n\t", "one", "one two", "x" * 5000, "x" * 5000 + "y", "word " * 3000]
    for k in range(14):  # a chain and a cloud of near copies
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(9)}"
        out.append(" ".join(copy))
    out += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(10)]
    return out


@pytest.fixture(scope="module")
def rows():
    ids = list(enumerate(texts()))
    return [*ids, (None, "same text"), (None, None), (3, "é"), (7, "another text of seven"), (7, "one"), (7, "one")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "b", "s", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, nothing, rows):
    got = exact.equal_texts(docs, first_width=2, growth=2, last_width=64).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None) and (not r.kept or r.doc_id == r.keep_id)
    kept = exact.drop_equal_texts(docs, first_width=16, growth=4)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.equal_texts(nothing).count() == 0 and exact.drop_equal_texts(nothing).count() == 0


def test_spread_join_deals_hot_keys(spark):
    """Half of the rows under one key, a third of the rest under another; the result is whole and no task has much more than the others."""
    n = 40_000
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 3 == 0, 8).otherwise(F.col("id"))
    rows = spark.range(n).select("id", key.cast("long").alias("k"), F.lit("x").alias("n"))
    keys = Workspace(spark, "t").write(rows.where("k <> 11").groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("top")), "keys")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = spread_join(rows, keys, ["k"], "size", "left")
        assert sorted(got.columns) == ["id", "k", "n", "top"]
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == n and sizes[-1] <= 4 * sizes[len(sizes) // 2]
        assert got.exceptAll(rows.join(keys.drop("size"), "k", "left").select(*got.columns)).isEmpty()
        assert spread_join(rows.limit(0), keys.limit(0), ["k"], "size").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(rows, width, percent):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, width))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80), (1, 60)])
def test_near_duplicates(docs, nothing, rows, width, percent):
    want = components(rows, width, percent)
    got = minhash.near_duplicates(docs, width, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, width)) for _, t in rows)
    if width == 5:
        kept = minhash.drop_near_duplicates(docs)
        assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
        assert minhash.near_duplicates(nothing).count() == 0


def test_blocks_form_every_pair_once(spark):
    rows = spark.createDataFrame([(k, n) for k, size in ((1, 1), (2, 9), (3, 40)) for n in range(size)], "key long, node long")
    left, right = minhash._blocks(rows, 4)
    x, y = left.withColumnRenamed("node", "a"), right.withColumnRenamed("node", "b")
    got = x.join(y, ["key", "row", "column"]).where("row < column or a < b").where("a <> b").select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    assert sorted(map(tuple, got.collect())) == [(k, a, b) for k, size in ((1, 1), (2, 9), (3, 40)) for a in range(size) for b in range(a + 1, size)]


def test_toxicity(spark, docs, nothing):
    rng = random.Random(6)
    sample = [(i, " ".join(["idiot"] * (i % 3 == 0) + [f"w{rng.randrange(50)}" for _ in range(20)])) for i in range(600)]
    table = spark.createDataFrame(sample, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i, _ in sample] + [(None, 1, "x"), (1, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_report(table, labels).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    model = toxicity.fit_to(table, labels)
    scored = docs.withColumn("toxic", toxicity.toxicity(F.col("text"), model))
    assert scored.where("toxic is null").isEmpty()
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    many = table.unionByName(table.where("doc_id = 3").withColumn("text", F.lit("zz another text")).crossJoin(spark.range(500).select()))
    assert toxicity.sample(many, labels).groupBy("doc_id").count().where("count > 1").isEmpty()
    one = toxicity.toxicity_report(table, labels.where("toxic = 0")).agg(F.max("score").alias("m")).first().m
    none = toxicity.toxicity_report(table, labels.limit(0)).agg(F.max("score").alias("m")).first().m
    assert one < 0.5 and none < 1e-6
    assert toxicity.toxicity_report(nothing, labels).count() == 0


def test_learns_nothing_from_held_out_rows(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    table = spark.createDataFrame([(i, f"slur{i % 2} here") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 if i in held else i % 2 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_report(table, labels).collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(400))


def test_pieces(docs, nothing, rows):
    path = vocabulary("piece_bpe_32k.model")
    got = pieces.piece_report(docs, path).collect()
    assert len(got) == len(rows) and all(r.restored for r in got)
    ids = docs.select("text", pieces.piece_ids(F.col("text"), path).alias("ids"))
    back = ids.select("text", pieces.piece_text(F.col("ids"), path).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
    assert pieces.piece_report(nothing, path).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "<article><p>A &amp; b.</p><p>C</p></article><footer>no</footer>", "u", "mine"), (2, None, None, None), (3, "", "u", "t"), (4, "<article>x</article>", None, None), (4, "<article>x</article>", None, None)], "page_id long, html string, url string, text string")
    got = sorted((r.page_id, r.text_) for r in html_extract.extract_pages(pages).collect())
    assert got == [(1, "A & b.\nC"), (2, ""), (3, ""), (4, "x"), (4, "x")]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_media(spark, docs, nothing, rows):
    got = media.media_report(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for _, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[hashlib.sha256(padded).hexdigest()] = (len(raw), len(padded), zlib.crc32(padded[-64:]))
    assert all(want[r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32) for r in got)
    assert len({r.payload_sha256 for r in got}) == len({r.media_sha256 for r in got})
    assert all(r.codec == "raw " and r.duration_s == r.payload_bytes / media.RATE and [k.end - k.begin for k in r.keyframes] == [64] * -(-r.payload_bytes // 1024) for r in got)
    deep = b""
    for _ in range(1500):
        deep = (len(deep) + 8).to_bytes(4, "big") + b"udta" + deep
    stored = spark.createDataFrame([(1, bytearray(media.mux(bytes(128))), "x"), (2, bytearray(b"junk"), "x"), (3, None, "x"), (4, bytearray(deep), "x"), (5, bytearray(), "x")], "id int, media binary, codec string")
    found = {r.id: (r.codec_, r.duration_s, r.keyframes) for r in media.media_columns(stored, "media").collect()}
    assert found[1][0] == "raw " and found[1][1] == 128 / media.RATE and len(found[1][2]) == 1 and found[2] == found[3] == found[4] == found[5] == (None, None, None)
    assert media.media_report(nothing).count() == 0


def test_personal_data(spark, nothing):
    table = spark.createDataFrame([(1, "a@b.co +1 555 0100 99", 21), (2, None, None), (3, "", 0), (4, "é 1.2.3.4", 9)], "doc_id long, text string, found long")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.personal_data_report(table).collect()}
    assert got == {1: (1, 0, 0, 1, "email:0:6,phone:7:21"), 2: (0, 0, 0, 0, ""), 3: (0, 0, 0, 0, ""), 4: (0, 1, 0, 0, "ip:2:9")}
    clean = {r.doc_id: (r.text, r.found) for r in pii.redact(table, length="found").collect()}
    assert clean == {1: ("[EMAIL] [PHONE]", 15), 2: (None, None), 3: ("", 0), 4: ("é [IP]", 6)}
    assert pii.personal_data_report(nothing).count() == 0


def test_chat(spark):
    rng = random.Random(8)
    marks = ["</s>", "[INST]", "[/OUT]", "&amp;", "&lt;s>", "[ROLE=x]", "word", "é\n", "<s", "[SY", "]"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "to]ol", None]) if t else "system", "".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) or None, 1) for c in range(12) for t in range(rng.randint(1, 14))]
    turns += [(50, None, "user", None, 1), (50, 1, "assistant", "a", 1), (50, 1, "assistant", "a", 1), (None, 0, "user", "x", 1)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, window int")
    windows = chat.chat_windows(table, span_tokens=120, history_tokens=60)
    by = defaultdict(list)
    for c, t, role, text, _ in turns:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    for r in chat.chat_report(windows).collect():
        said = sorted(by[r.conv_id])
        wanted = "".join(x[2] for x in said if x[1] == "assistant")
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{x[1]}\n{x[2]}\n" for x in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(wanted), hashlib.sha256(wanted.encode()).hexdigest())
    found = windows.collect()
    several = {w.conv_id for w in found if w.window > 1}
    assert several
    for w in found:
        assert w.formatted.startswith("<s>") and w.formatted.endswith("</s>") and w.formatted.count("<s>") == 1 == w.formatted.count("</s>")
        if w.window > 1:  # the system turn is kept, history repeats
            assert w.formatted.startswith("<s>[SYS]") and w.n_repeated >= 1
    assert chat.chat_report(chat.chat_windows(table.limit(0))).count() == 0


def test_token_file(spark, docs, nothing, rows):
    tool = Tokenizer.from_file(vocabulary(WORD))
    folder = Workspace(spark, "t").path("ids")
    token_file.write_token_file(docs, folder, vocabulary(WORD))
    got = sorted(token_file.read_token_file(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())), strict=True):
        ids = [*tool.encode(t, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(ids), b"".join(x.to_bytes(4, "little") for x in ids))
        at += len(ids)
    empty = Workspace(spark, "t").path("none")
    token_file.write_token_file(nothing, empty, vocabulary(WORD))
    assert token_file.read_token_file(spark, empty).count() == 0


@pytest.mark.parametrize("most_bases", [packing.MOST_BASES, 0])
def test_packing(docs, nothing, rows, monkeypatch, most_bases):
    monkeypatch.setattr(packing, "MOST_BASES", most_bases)
    tool = Tokenizer.from_file(vocabulary(WORD))
    got = packing.pack_documents(docs, vocabulary(WORD), capacity=64, with_ids=True).collect()
    want = defaultdict(int)
    for i, t in rows:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[i, k // 64, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), tuple(part)] += 1
    found = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        found[r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found == want
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.1 * total / 64 + 1
    assert packing.pack_documents(nothing, vocabulary(WORD)).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, Workspace(spark, "p").write(stage(spark, kept, SF), name)
        was = [(r.doc_id, r.text) for r in before.collect()]
        if name == "packing":
            assert {r.doc_id for r in kept.collect()} == {i for i, _ in was}
            continue
        now = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit_to(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            import pyarrow as pa

            scores = model.score(pa.array([t for _, t in was], pa.large_string()))
            assert now.keys() == {i for (i, _), s in zip(was, scores) if s < 0.5}
        elif name == "exact_dedup":
            last = {}
            for i, t in was:
                last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), i))
            assert now.keys() == set(last.values())
        elif name == "near_dedup":
            assert now.keys() == {i for i, c in components(was, 5, 80).items() if i == c}
        else:
            assert now.keys() == {i for i, _ in was}
            for i, t in was:
                assert contract_spans(now[i]) == []  # nothing of the base kinds is left
                if contract_spans(t):
                    assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", now[i])
                elif not re.search(r"[0-9]{3}|[A-Z0-9]{10}", t):  # nothing that the other kinds could be
                    assert now[i] == t


def test_pipeline_ends_with_packed_ids(spark):
    tool = Tokenizer.from_file(vocabulary(WORD))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(corpus_pipeline.packing(spark, docs, SF).collect(), key=lambda r: (r.doc_id, r.start))
    ids = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        ids[r.doc_id] += r.ids
    assert ids == {r.doc_id: [*tool.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}


def test_queries_have_fixed_names(spark):
    names = sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(names)


def test_queries_equal_their_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        got, want = queries()[name](spark, SF).toPandas(), c.sql(sql).df()
        assert set(got.columns) == set(want.columns)
        as_rows = lambda d: sorted(tuple(map(str, x)) for x in d[sorted(d.columns)].itertuples(index=False))
        assert as_rows(got) == as_rows(want), name
