"""Rounds of joins against the loops that they replace."""

import random

import pytest

from kinetrace.operators import kernels
from kinetrace.operators import matching as m


def test_constrained_merging_equals_the_sequential_order(spark):
    rng = random.Random(4)
    items, links, apart, want = [], [], [], {}
    for site in range(12):
        n = rng.randint(1, 14)
        items += [(site, i) for i in range(n)]
        mine = [(rng.choice([0.5, 1.0, rng.random()]), *rng.sample(range(n), 2)) for _ in range(rng.randint(0, 25)) if n > 1]  # ties too
        walls = {frozenset(rng.sample(range(n), 2)) for _ in range(rng.randint(0, 8)) if n > 1}
        links += [(site, a, b, s) for s, a, b in mine]
        apart += [(site, *p) for p in map(tuple, walls)]
        want |= {(site, i): r for i, r in enumerate(kernels.merged(n, mine, walls))}
    log = []
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = m.merged(frame(items, "site int, item int"), frame(links, "site int, a int, b int, score double"), frame(apart, "site int, a int, b int"), ["site"], lambda *x: log.append(x))
    assert {(r.site, r.item): r.root for r in got.collect()} == want
    assert len(log) > 2 and log[-1][1] == 0 and sum(x[1] for x in log) == len(items) - len({(s, r) for (s, _), r in want.items()})


def test_merging_without_links(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b")], "site int, item string")
    none = spark.createDataFrame([], "site int, a string, b string, score double")
    assert sorted(tuple(r) for r in m.merged(items, none, none.drop("score"), ["site"]).collect()) == [(1, "a", "a"), (1, "b", "b")]


def test_choices_equal_the_loop(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for video in range(10):
        pairs = {(rng.randrange(9), rng.randrange(9)): rng.choice([1.0, 2.0, 3.0]) for _ in range(rng.randint(0, 30))}
        starts = {n: rng.randrange(4) for n in range(9)}
        mine = [(video, t, n, starts[n], c) for (t, n), c in pairs.items()]
        rows += mine
        used, done = set(), set()
        for _, t, n, _, _ in sorted(mine, key=lambda r: (r[3], r[2], r[4], r[1])):
            if n not in done and t not in used:
                used.add(t)
                done.add(n)
                want.add((video, t, n))
    frame = spark.createDataFrame(rows, "video int, track int, next int, start int, cost double")
    got = m.chosen(frame, ["video"], "next", "track", ["start"], ["cost"])
    assert {(r.video, r.track, r.next) for r in got.collect()} == want
    assert m.chosen(frame.where("false"), ["video"], "next", "track", ["start"], ["cost"]).count() == 0


def test_chains_end_where_pointers_lead(spark):
    rng = random.Random(2)
    pointers = [(key, i, rng.randrange(i)) for key in range(3) for i in range(1, 60) if rng.random() < 0.8]
    to = {(k, i): j for k, i, j in pointers}

    def end(k, i):
        while (k, i) in to:
            i = to[k, i]
        return i

    got = m.ends_of_chains(spark.createDataFrame(pointers, "k int, i int, j int"), ["k"], "i", "j").collect()
    assert {(r.k, r["item"]): r.end for r in got} == {(k, i): end(k, i) for k, i, _ in pointers}
    assert m.ends_of_chains(spark.createDataFrame([], "k int, i int, j int"), ["k"], "i", "j").count() == 0


@pytest.mark.parametrize("least", [0.5, 3.0])
def test_rows_kept_apart_equal_the_loop(spark, least):
    rng = random.Random(7)
    rows = [(key, i, round(rng.random() * 40 * (key + 1), rng.choice([0, 1, 2])), "x") for key in range(6) for i in range([0, 1, 2, 30, 60, 200][key])]
    want = set()
    for key in range(6):
        last = None
        for k, i, t, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if last is None or t - last >= least - 1e-9:
                want.add((k, i))
                last = t
    got = m.kept_apart(spark.createDataFrame(rows, "k int, i int, t double, more string"), ["k"], "t", least, ["i"])
    assert got.columns == ["k", "i", "t", "more"] and {(r.k, r.i) for r in got.collect()} == want
