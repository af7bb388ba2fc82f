"""Helpers against brute force, without Spark."""

import random
import re
import struct
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinetrace.llm import chat, html_extract, media, minhash, packing, pii, shingles, token_file, toxicity
from kinetrace.llm.queries import vocabulary
from kinetrace.llm.tokens import BatchTokenizer

ODD = ["", "   ", "don't  stop'll #'s x", "é a̸ ≮", "<|endoftext|> hi", "ABC12def $$$#x ÀÉß İı Σας 漢字", "a\x00b \x1f x\x85y\xa0z", "naïve—x “q”", "word " * 3000]

LIBRARY = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))  # as it is, with its own settings


def large(texts):
    return pa.array(texts, pa.large_string())


def test_batch_tokenizer_equals_the_library():
    tool = BatchTokenizer(vocabulary("word_bpe_49k.json"), memo=3)  # so small that words are forgotten
    for _ in range(2):
        ids, counts = tool.encode(large([*ODD, None]))
        ends = np.cumsum(counts)
        for text, end, n in zip([*ODD, ""], ends, counts):
            assert ids[end - n : end].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_batch_tokenizer_lower_cases_as_the_library():
    tool = BatchTokenizer(vocabulary("word_bpe_49k.json"))
    texts = ["İstanbul", "see İSTANBUL, İ. istanbul", *(f"{chr(c)}stanbul a{chr(c)}b" for c in range(0xC0, 0x250))]
    ids, counts = tool.encode(large(texts))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert ids[end - n : end].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_batch_tokenizer_on_random_texts_of_all_planes():
    rng = random.Random(11)
    added = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "</w>", "İ", "'ll", "'S"]
    ranges = [(0, 0x7F), (0, 0x7F), (0x20, 0x250), (0x250, 0x3000), (0x3000, 0xD7FF), (0xE000, 0xFFFF), (0x10000, 0x10FFFF)]

    def piece():
        if rng.random() < 0.15:
            return rng.choice(added)
        low, high = rng.choice(ranges)
        return "".join(chr(rng.randint(low, high)) for _ in range(rng.randint(1, 6)))

    texts = ["".join(piece() + rng.choice(["", "", " ", "\n", "\t ", "\u3000"]) for _ in range(rng.randint(0, 12))) for _ in range(10_000)]
    tool = BatchTokenizer(vocabulary("word_bpe_49k.json"))
    ids, counts = tool.encode(large(texts))
    ends = np.cumsum(counts)
    wrong = [text for text, end, n, found in zip(texts, ends, counts, LIBRARY.encode_batch(texts, add_special_tokens=False)) if ids[end - n : end].tolist() != found.ids]
    assert not wrong


@pytest.mark.parametrize("top", [1, 2, 300, 2**16, 2**60, 2**64])
@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_simple8b_round_trip(top, size):
    rng = np.random.default_rng(size)
    values = rng.integers(0, top, size, np.uint64, endpoint=top < 2**64) if top < 2**64 else rng.integers(0, 2**64, size, np.uint64)
    values[: size // 3] = 0
    words, offsets, escapes = token_file.encode(values, block=64)
    assert (token_file.decode(words, offsets, escapes, size, block=64) == values).all()
    for k in range(len(offsets) - 1):  # blocks decode apart
        part = words[offsets[k] : offsets[k + 1]]
        n = min(64, size - 64 * k)
        assert (token_file.decode(part, np.array([0, len(part)]), escapes, n, block=64) == values[64 * k : 64 * k + n]).all()


def test_simple8b_packs_greedily():
    words, _, _ = token_file.encode(np.arange(240) % 2)
    assert len(words) == 4
    assert len(token_file.encode(np.zeros(240))[0]) == 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 97, 4096])
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), min(capacity, 60))}
    rows, sequences = packing.plan(histogram, capacity)
    used: dict[int, list] = {}
    for length, n in histogram.items():
        seen = set()
        for _, first, count, sequence, copies, offset in rows[rows[:, 0] == length].tolist():
            for r in range(count):
                seen.add(first + r)
                at = offset + r % copies * length
                used.setdefault(sequence + r // copies, []).append((at, at + length, length))
        assert seen == set(range(n))
    assert set(used) == set(range(sequences))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert sum(3 * s[2] > capacity for s in spans) <= 2
    total = sum(k * v for k, v in histogram.items())
    assert sequences <= 1.25 * -(-total // capacity) + sum(v for k, v in histogram.items() if 3 * k > capacity)


def test_shingle_sets_and_signatures_against_brute_force():
    texts = ["a b c d a b c", "A  b\tc\nd", "one two", "", " \n", "x"]
    found, sizes = shingles.shingle_sets(large(texts), 3)
    assert sizes.tolist() == [4, 2, 1, 0, 0, 1]
    assert set(found[4:6]) <= set(found[:4])
    signature = minhash.signatures(found, sizes, 8)
    assert signature.shape == (4, 8)
    assert (signature[:, 4:] >= signature[:, :4]).all()


def test_banding_misses_less_than_one_in_a_million():
    for percent in (70, 80, 85, 95):
        bands, rows = minhash.banding(percent)
        assert bands * rows <= minhash.MOST_VALUES and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS


def test_spans_of_personal_data():
    text = "mail a.b@c-d.org, x@y@z.de.; ip 1.2.3.4.5 300.1.1.1; card 4111 1111 1111 1111 4111-1111-1111-1112 phone +1 (555) 010-9999 iban GB82 WEST 1234 5698 7654 32 ssn 078-05-1120"
    found = [(k, text[a:b]) for k, a, b, _ in pii.spans(text)]
    assert found == [("email", "a.b@c-d.org"), ("email", "y@z.de"), ("ip", "1.2.3.4"), ("phone", "+1 (555) 010-9999"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("id", "078-05-1120")]
    assert ("card", "4111 1111 1111 1111") in [(k, t[a:b]) for t in ["card 4111 1111 1111 1111."] for k, a, b, _ in pii.spans(t)]
    assert "@" not in pii.redacted(text, pii.spans(text)) .replace("x@", "")


def test_emails_equal_the_plain_pattern():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("a.@-_ b1%") for _ in range(rng.randint(0, 25)))
        assert list(pii._emails(text)) == [m.span() for m in pii._PATTERN["email"].finditer(text)]


def contract_spans(text):
    """The four base kinds as stated, with plain patterns and plain sums."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_the_contract():
    rng = random.Random(4)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.1", "256.1.1.1", "+1 (555) 010-99", "a.b@c.de", "0", "7", "12", ".", "-", " ", "+", "(", ")", "@", "x", "é", "\n", "1.2.3.4.5.6.7.8", "00255.1.1.1"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [f"{k}:{a}:{b}" for k, a, b, _ in pii.spans(text) if k in pii.BASE] == contract_spans(text)


def test_context_words_adjust_the_score():
    hidden = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert [(k, s) for k, _, _, s in pii.spans(f'token = "{hidden}"')] == [("secret", pytest.approx(0.65))]
    assert pii.spans(f"commit {hidden}") == []
    assert pii.spans("host 10.0.0.1")[0][3] > pii.spans("see 10.0.0.1")[0][3]


@pytest.mark.parametrize("text", ["7" * 5_000_000, "1." * 500_000, "+1" + "(" * 3_000_000, "1 " * 2_000_000, "a@" * 1_000_000, "A1" * 2_000_000, "9" * 20 + "." + "9" * 3_000_000], ids=lambda t: t[:4])
def test_long_texts_take_time_in_proportion(text):
    begin = time.process_time()
    pii.spans(text)
    assert time.process_time() - begin < 10


def test_container_round_trip_and_refusal():
    for size in (64, 64 * 16, 64 * 33):
        payload = bytes(range(256)) * (size // 64) * 4
        payload = payload[:size]
        data = media.mux(payload)
        found = media.describe(data)
        assert b"".join(data[a:b] for a, b in found["ranges"]) == payload
        assert found["codec"] == "raw " and found["duration"] == size
        assert [data[a:b] for a, b in found["keyframes"]] == [payload[i : i + 64] for i in range(0, size, 64 * 16)]
    with pytest.raises(ValueError):
        media.describe(b"\0\0\1\0ftypxxxx")


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def two_tracks():
    """A hand-made file: video of five uneven samples in two chunks, two keyframes; then sound of three samples, all keyframes."""

    def trak(codec, scale, stts, stsc, sizes, stss, stco):
        table = lambda kind, rows: box(kind, struct.pack(">II", 0, len(rows)), *[struct.pack(f">{len(r)}I", *r) for r in rows])
        stsd = box(b"stsd", struct.pack(">II", 0, 1), box(codec, bytes(28)))
        stsz = box(b"stsz", struct.pack(">III", 0, 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes))
        parts = [stsd, table(b"stts", stts), table(b"stsc", stsc), stsz, table(b"stco", [(x,) for x in stco])]
        stbl = box(b"stbl", *parts, *([table(b"stss", [(x,) for x in stss])] if stss else []))
        mdhd = box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, scale, 0, 0))
        return box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl)))

    video = trak(b"avc1", 1000, [(2, 40), (3, 20)], [(1, 3, 1), (2, 2, 1)], [10, 20, 30, 5, 6], [1, 4], [100, 300])
    sound = trak(b"mp4a", 8000, [(3, 1024)], [(1, 1, 1)], [7, 8, 9], None, [200, 210, 220])
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", box(b"mvhd", bytes(100)), video, sound) + box(b"mdat", bytes(400))


def test_tracks_have_their_own_tables():
    video, sound = media.tracks(two_tracks())
    assert (video["codec"], video["timescale"], video["duration"], video["samples"]) == ("avc1", 1000, 140, 5)
    assert video["ranges"] == [(100, 160), (300, 311)] and video["keyframes"] == [(100, 110), (300, 305)] and video["key_times"] == [0, 100]
    assert (sound["codec"], sound["duration"], sound["keyframes"], sound["key_times"]) == ("mp4a", 3072, [(200, 207), (210, 218), (220, 229)], [0, 1024, 2048])


def test_deep_and_forged_boxes():
    deep = b""
    for _ in range(3000):
        deep = box(b"udta", deep)
    assert sum(1 for _ in media.boxes(deep)) == 3000
    assert len(media.tracks(two_tracks() + deep)) == 2
    good = media.mux(bytes(640))
    at = good.index(b"stsz")
    forged = [good[: at + 12] + struct.pack(">I", n) + good[at + 16 :] for n in (11, 2_000_000, 2**32 - 1)]
    at = good.index(b"stts")
    forged += [good[: at + 8] + struct.pack(">I", 2**32 - 1) + good[at + 12 :], good[: at + 12] + struct.pack(">I", 2**32 - 1) + good[at + 16 :]]
    at = good.index(b"stco")
    forged.append(good[: at + 12] + struct.pack(">I", 2**31) + good[at + 16 :])
    for data in forged:
        tracemalloc.start()
        with pytest.raises(ValueError):
            media.tracks(data)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
        tracemalloc.stop()


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head><body class="blog">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice">We use cookies, a lot of them, really.</div>
<div class="ad">Buy now, buy more, buy a lot of this.</div><article><h1>Title &amp; more</h1><p>First  <b>bold</b>text, with a stop. And more words here.<p>Ok.
<aside>Side, side.</aside><ul><li>one<li>two</ul><form><input value="x">Send</form><div class="comments"><p>I like this, really, a lot.</p></div></article>
<!-- gone --><footer>&copy; x. All rights, reserved.</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst boldtext, with a stop. And more words here.\nOk.\none\ntwo"
    divs = "<div id='header'>Site name</div><div class='post'><div class='post-header'><h1>Title</h1></div><div class='post-body'><p>Long text, with words, and more words.</p><p>Short.</p></div></div><div class='sidebar'>Links, many.</div>"
    assert html_extract.main_text(divs) == "Title\nLong text, with words, and more words.\nShort."
    assert html_extract.main_text("") == ""
    assert html_extract.main_text("just a text, no mark up") == "just a text, no mark up"
    assert html_extract.main_text("<p>cut off <b") == "cut off"
    assert html_extract.main_text("<nav>only a menu</nav>") == ""


LONG = "A first sentence, with some words in it; then more of them, and a stop. "
NEUTRAL = f"""<body><div class="q1"><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">About</a></div><div class="q2"><span>Log in</span> <span>Contact us</span></div>
<h1>Head line</h1><div class="k3"><p>{LONG * 3}</p><p>Short.</p><h2>Middle</h2><p>{LONG * 4}</p><ul><li>one<li>two</ul><p>{LONG * 2}</p></div>
<div class="q4"><a href="/s">Share</a> <a href="/t">Terms</a></div><div class="q5">Copyright 2020</div></body>"""
WANTED = ["Head line", (LONG * 3).strip(), "Short.", "Middle", (LONG * 4).strip(), "one", "two", (LONG * 2).strip()]


def test_ratios_choose_the_nodes_without_an_article_element(monkeypatch):
    assert html_extract.main_text(NEUTRAL).split("\n") == WANTED
    flat = f"<body><a>Home</a> <a>News</a> <a>About</a> <a>Contact us</a><p>{LONG * 4}</p><p>{LONG * 5}</p><a>Share</a> <a>Terms</a> <a>Privacy</a></body>"
    assert html_extract.main_text(flat).split("\n") == [(LONG * 4).strip(), (LONG * 5).strip()]
    monkeypatch.setattr(html_extract, "content_paths", lambda paths, lengths, marks: np.ones(len(paths), bool))
    assert "Home News About" in html_extract.main_text(NEUTRAL) and "Share Terms" in html_extract.main_text(flat)


def test_content_paths_against_plain_sums():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        paths, lengths, marks = rng.integers(0, 6, n), rng.integers(1, 300, n).astype(float), rng.integers(0, 9, n).astype(float)
        mean = lambda values, p: sum(values[paths == p]) / sum(paths == p)
        ratios = [[mean(v, p) for p in paths] for v in (lengths, marks)]

        def smooth(v):
            near = [[(np.exp(-(d**2) / 2), v[i + d]) for d in range(-2, 3) if 0 <= i + d < n] for i in range(n)]
            return [sum(w * x for w, x in k) / sum(w for w, _ in k) for k in near]

        fused = np.array([a * (1 + b) for a, b in zip(*map(smooth, ratios))])
        score = np.array([np.sqrt(mean(lengths, p) * (1 + mean(marks, p)) * mean(fused, p)) for p in paths])
        limit = min(html_extract.LEAST * score.std(), score.max())
        clear = np.abs(score - limit) > 1e-9 * limit
        assert (html_extract.content_paths(paths, lengths, marks) == (score >= limit))[clear].all()


def test_parts_of_an_article_are_kept_together():
    halves = f"<body><div class=a><div class=x><p>{LONG * 6}</p></div><div class=x><p>{LONG * 4}</p></div></div></body>"
    assert html_extract.main_text(halves).split("\n") == [(LONG * 6).strip(), (LONG * 4).strip()]
    sections = f"<main><section><p>{LONG * 6}</p></section><section><p>{LONG * 3}</p></section></main>"
    assert html_extract.main_text(sections).split("\n") == [(LONG * 6).strip(), (LONG * 3).strip()]
    several = f"<article><p>{LONG * 6}</p></article><article><p>{LONG * 4}</p></article><article><p>Teaser, short.</p></article>"
    assert html_extract.main_text(several).split("\n") == [(LONG * 6).strip(), (LONG * 4).strip()]


def test_attributes_are_read_by_name():
    kept = '<article><p><a href="/hidden-gems" title="Hidden costs" data-class="menu">One</a> <a href="?id=comments">two</a></p></article>'
    assert html_extract.main_text(kept) == "One two"
    assert html_extract.main_text("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>") == "yes"
    assert html_extract.main_text("<article><svg/><p>after</p><svg-icon>x</svg-icon></article>") == "after\nx"
    assert html_extract.main_text("<article><svg viewBox='0'><text>no</text></svg><p>yes</p></article>") == "yes"


@pytest.mark.parametrize("page", ["<div class=x>a" * 20_000, "<span>" * 50_000 + "<p>x" * 20_000, "<div>" * 50_000 + "</x>" * 50_000, "<p><span>" * 30_000, "<a " * 200_000, "<li>a" * 50_000], ids=lambda t: t[:7])
def test_deep_and_long_markup_takes_time_in_proportion(page):
    begin = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - begin < 10
    tracemalloc.start()
    html_extract.main_text(page[: len(page) // 8])
    assert tracemalloc.get_traced_memory()[1] < 60 * len(page)
    tracemalloc.stop()


def test_swaps_and_penalty():
    rng = np.random.default_rng(0)
    texts, toxic = [], []
    for i in range(400):  # the mention of one group goes along with the label, as in a biased sample
        bad = i % 2
        words = [f"w{rng.integers(30)}" for _ in range(12)] + (["idiot"] if bad and rng.random() < 0.7 else [])
        words += ["muslim"] if rng.random() < (0.8 if bad else 0.1) else ["christian"]
        texts.append(" ".join(words))
        toxic.append(bad)
    names = sorted(["idiot=", "muslim=", "christian=", *[f"w{i}=" for i in range(30)]])
    terms = toxicity._terms(toxicity.IDENTITY)
    row, feature, value = toxicity.sparse_rows(large(texts), large(names), terms)
    swaps = toxicity._swaps(row, feature, value, names, toxicity.IDENTITY)
    found = {}
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        w, b = toxicity._descend(row, feature, value, np.array(toxic, float), len(names), swaps, strength)
        model = toxicity.Model(tuple(names), tuple(w.tolist()), b)
        found[strength] = model.score(large(["the muslim read w1 w2 w3", "the christian read w1 w2 w3", "you idiot muslim"]))
    plain, fair = found.values()
    assert abs(fair[0] - fair[1]) < 0.2 * abs(plain[0] - plain[1])
    assert fair[2] > 0.5


def test_toxicity_fit_against_plain_sums():
    """Features by counting words one by one; the fitted weights are a minimum of the loss as the module states it."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["idiot", "idiots", "w1", "w2", "muslim", "christian", "jewish"]) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    toxic = [int("idiot" in t or rng.random() < 0.1) for t in texts]
    names = sorted(["idiot=", "idiots=", "idi~", "w1=", "w2=", "muslim=", "christian=", "jewish="])
    row, feature, value = toxicity.sparse_rows(large(texts), large(names), toxicity._terms(toxicity.IDENTITY))
    cells = {}
    for i, text in enumerate(texts):
        for word in text.split():
            for name in [f"{word}=", *(["idi~"] if word.startswith("idi") and len(word) > 3 else [])]:
                if name in names:
                    cells[i, name] = cells.get((i, name), 0) + 1
    want = {(i, n): (c / len(texts[i].split())) ** toxicity.POWER for (i, n), c in cells.items()}
    assert {(r, names[f]): pytest.approx(v) for r, f, v in zip(row.tolist(), feature.tolist(), value.tolist())} == want

    group = "muslim= christian= jewish=".split()
    swapped = []  # (text, first, second) for every swap of a mentioned term; terms of the group that no text has have weight 0
    for i, text in enumerate(texts):
        said = [g for g in group if f"{g[:-1]}" in text.split()]
        swapped += [(i, a, b) for a in said for b in [*group, None] if b != a and not (b in said and b < a)]

    def loss(w, b):
        logit = [b + sum(w[names.index(n)] * want[i, n] for n in names if (i, n) in want) for i in range(len(texts))]
        weight = [np.sqrt((len(toxic) - sum(toxic)) / sum(toxic)) if y else 1.0 for y in toxic]
        fit = sum(k * np.log1p(np.exp(-z if y else z)) for k, z, y in zip(weight, logit, toxic)) / sum(weight)
        gaps = [((want.get((i, a), 0) - want.get((i, b), 0)) * (w[names.index(a)] - (w[names.index(b)] if b else 0))) ** 2 for i, a, b in swapped]
        return fit + toxicity.L2 * sum(x * x for x in w) + toxicity.COUNTERFACTUAL * sum(gaps) / len(gaps)

    swaps = toxicity._swaps(row, feature, value, names, toxicity.IDENTITY)
    assert int(swaps[0].max()) + 1 == len(swapped)
    w, b = toxicity._descend(row, feature, value, np.array(toxic, float), len(names), swaps, toxicity.COUNTERFACTUAL)
    best, steps = loss(w, b), np.random.default_rng(1)
    for _ in range(40):
        assert loss(w + steps.normal(0, 0.3, len(w)), b + steps.normal(0, 0.3)) > best - 1e-3


def test_tokens_of_pieces_restore_and_equal_the_library():
    spm = pytest.importorskip("sentencepiece")
    from kinetrace.llm.pieces import Segmenter

    path = vocabulary("piece_bpe_32k.model")
    tool = Segmenter(path, memo=5)
    texts = ["", "the thing and the other, oftion éè", "  two  spaces ", "漢字 ひら́ \U0001f642", "x\ny\tz", "a\x00b  c\x00", "thnd " * 500]
    ids, counts = tool.encode(large(texts))
    assert [t.decode() for t in tool.decode(ids, counts)] == texts
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the library's own best path over the same pieces
    library = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    words = ["the", "thing,", "oftion", "mentaux", "éèquelle", "Zürich", "Hello", "running", "international", "x1y2"]
    ids, counts = tool.encode(large(words))
    ends = np.cumsum(counts)
    for word, end, n in zip(words, ends, counts):
        got, best = ids[end - n : end].tolist(), library.encode(word)
        assert got == best or sum(tool.model.scores[i] for i in got) >= sum(tool.model.scores[i] for i in best)


def test_viterbi_equals_plain_dynamic_programming():
    from kinetrace.llm.pieces import Segmenter

    tool = Segmenter(vocabulary("piece_bpe_32k.model"))
    score = {tool.model.pieces[i]: tool.model.scores[i] for i in tool.ids.tolist()}
    rng = random.Random(3)
    for _ in range(60):
        word = "▁" + "".join(rng.choice("etaonhrdi,.Xé漢") for _ in range(rng.randint(1, 12)))
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + score[word[s:end]], best[s][1] + [word[s:end]]) for s in range(end) if word[s:end] in score]
            if word[end - 1] not in score:
                options.append((best[end - 1][0] + tool.unknown_score, best[end - 1][1] + [word[end - 1]]))
            best.append(max(options, key=lambda o: o[0]))
        ids, _ = tool._lookup([word])
        want = [i for p in best[-1][1] for i in ([tool.model.pieces.index(p)] if p in score else tool._spell(ord(p)))]
        assert ids.tolist() == want


def test_marks_are_known():
    assert set(chat._MARKS) == {"system", "user", "assistant"}
