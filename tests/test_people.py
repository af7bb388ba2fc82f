"""People of made-up rooms, one site each, resolved together."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import kernels, people
from kinetrace.operators.identity import Settings
from kinetrace.plans.world import best_links

TICK = 0.2
SCHEMA = "site string, tick long, key string, camera string, x double, y double, sigma double, edge boolean, look array<double>"
RED, BLUE = [1.0, 0.1, 0.0], [0.0, 0.1, 1.0]


def line(t):
    return 1 + 0.5 * t, 2.0


def at(x, y):
    return lambda t: (x, y)


#: Tracks (camera, name, from s, to s, path, cut by the edge, look if any) of each room.
ROOMS = {
    "two cameras": [("cam1", "a", 0, 12, line, False), ("cam2", "b", 0, 12, line, False)],
    "hand-off": [("cam1", "a", 0, 10, line, False), ("cam2", "b", 7, 18, line, False)],
    "occlusion": [("cam1", "a", 0, 10, at(4, 4), False, BLUE), ("cam1", "b", 12, 20, at(4, 4), False, BLUE)],
    "other clothes": [("cam1", "a", 0, 10, at(4, 4), False, BLUE), ("cam1", "b", 10.4, 20, at(4, 4), False, RED)],
    "no looks": [("cam1", "a", 0, 10, at(4, 4), False), ("cam1", "b", 10.6, 20, at(4, 4), False)],
    "unclear": [("cam1", "a", 0, 10, at(4, 4), False), ("cam1", "b", 12, 20, at(4, 4), False)],
    "seated": [("cam1", "a", 0, 30, at(5, 5), False, BLUE), ("cam2", "b", 0, 30, at(5.9, 5), False, RED)],
    "thrice": [("cam1", n, 7 * i, 7 * i + 5, at(4, 4), False, BLUE) for i, n in enumerate("abc")],
    "neighbours": [(c, n + c[-1], 0, 12, at(4 + 0.6 * (n == "b"), 4), False) for c in ("cam1", "cam2") for n in "ab"],
    "teleport": [("cam1", "a", 0, 5, at(0, 0), False), ("cam1", "b", 5.4, 12, at(13, 0), False)],
    "crossing": [(c, n + c[-1], 0, 12, (lambda t: (0.6 * t, 3.0)) if n == "a" else (lambda t: (7.2 - 0.6 * t, 3.6)), False) for c in ("cam1", "cam2") for n in "ab"],
    "edge": [("cam1", "a", 0, 12, at(4, 4), True), ("cam2", "b", 0, 12, at(4, 4), False)],
    "seen there": [("cam1", "a", 0, 6, at(4, 4), False), ("cam2", "b", 0, 20, at(4, 4), False), ("cam1", "c", 12, 20, at(4, 4), False)],
    "drift": [("cam1", "a", 0, 12, at(4, 4), False), ("cam2", "b", 0, 12, lambda t: (4 + max(0, t - 6) * 0.6, 4), False)],
    "parted": [("cam1", "a", 0, 30, at(4, 4), False), ("cam2", "b", 0, 30, lambda t: (4 + max(0, t - 6) * 0.6, 4), False)],
    "long gone": [("cam1", "a", 0, 5, at(4, 4), False), ("cam1", "b", 60, 66, at(4, 4), False)],
    "exit": [("cam1", "a", 0, 4, line, False), ("cam1", "z", 0, 20, at(50, 50), False)],
}


@pytest.fixture(scope="module")
def seen(spark):
    rows = [
        (room, round(t / TICK), name, camera, *(float(c) + 0.03 * math.sin(2.6 * t / TICK + n + k) for k, c in enumerate(path(t))), 0.2, edge, more[0] if more else None)
        for room, tracks in ROOMS.items() for n, (camera, name, t0, t1, path, edge, *more) in enumerate(tracks) for t in [t0 + i * TICK for i in range(round((t1 - t0) / TICK))]
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def resolved(seen):
    log = []
    who, known, cross, decided = people.resolve(seen, log=log.append)
    assert 2 <= log[0] <= 5
    return who, known, cross, decided


@pytest.fixture(scope="module")
def world(seen):
    return people.world(seen).toPandas()


def person(resolved, room, key, at):
    rows = resolved[1].where((F.col("site") == room) & (F.col("key") == key) & (F.col("since") <= at / TICK) & (F.col("until") > at / TICK)).collect()
    assert len(rows) == 1
    return rows[0].person


def test_identities(resolved):
    same = lambda room, a, b, t=30: person(resolved, room, a, t) == person(resolved, room, b, t)
    assert same("two cameras", "a", "b") and same("hand-off", "a", "b") and same("occlusion", "a", "b") and same("seen there", "a", "c") and same("seen there", "a", "b")
    assert same("thrice", "a", "b") and same("thrice", "a", "c")  # the third is found only once the second is known to be the first
    assert same("neighbours", "a1", "a2") and same("neighbours", "b1", "b2") and not same("neighbours", "a1", "b1")
    assert same("crossing", "a1", "a2") and same("crossing", "b1", "b2") and not same("crossing", "a1", "b1")
    assert same("no looks", "a", "b") and not same("other clothes", "a", "b") and not same("unclear", "a", "b", 18) and not same("seated", "a", "b", 28)
    assert not same("teleport", "a", "b") and not same("edge", "a", "b") and not same("long gone", "a", "b", 70)
    assert same("drift", "a", "b", 5) and not same("drift", "a", "b", 11.8)  # taken back when they part
    assert not same("parted", "a", "b", 5)  # on the whole they are too far apart


def test_events(resolved):
    found = {(r.site, r.type, r.first, r.second) for r in people.audit(*resolved[1:]).collect()}
    assert ("two cameras", "cross_camera_link", "a", "b") in found and ("drift", "link_revoked", "a", "b") in found
    assert ("occlusion", "reacquired", "b", "a") in found and ("seen there", "cross_camera_link", "c", "b") in found and ("thrice", "reacquired", "c", "b") in found
    assert ("parted", "link_blocked", "a", "b") in found and ("drift", "link_blocked", "a", "b") not in found
    assert ("unclear", "ambiguous_reacquisition", "b", "a") in found and not any(site in ("teleport", "edge", "seated", "other clothes") for site, *_ in found)


def test_world(world):
    now = lambda room, t: world[(world.site == room) & (world.tick == round(t / TICK))]
    assert now("two cameras", 0.2).cameras.tolist() == ["cam1,cam2"]  # the lag lets the first ticks know it
    assert now("two cameras", 5).state.tolist() == ["active"] and now("two cameras", 5).shown.tolist() == ["Confirmed"]
    assert abs(now("two cameras", 5).x.iloc[0] - 3.5) < 0.05
    assert now("occlusion", 11).state.tolist() == ["occluded"] and now("occlusion", 11).confidence.iloc[0] < now("occlusion", 9).confidence.iloc[0]
    assert len(now("crossing", 6)) == 2 and len(now("neighbours", 6)) == 2 and len(now("edge", 6)) == 2
    later = now("unclear", 15)  # the lost one fades, the new one may be the same
    assert set(zip(later.state, later.shown)) == {("exited", None), ("ambiguous", "Needs confirmation")}
    gone = world[(world.site == "exit") & (world.person == 1)].sort_values("tick")
    assert len(gone) == 20 + 35 and gone.state.tolist() == ["active"] * 20 + ["occluded"] * 25 + ["exited"] * 10
    assert not world.duplicated(["site", "tick", "person"]).any()


def test_nothing_seen(spark):
    assert people.world(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_links_equal_the_kernel_over_whole_sites(spark):
    import random

    rng = random.Random(5)
    rows = [(site, a, b, float(rng.randint(-6, 9))) for site in range(6) for a in range(9) for b in range(7) if rng.random() < 0.35]
    got = best_links(spark.createDataFrame(rows, "site int, a int, b int, score double"), ["site"]).toPandas()
    for site in range(6):
        mine = pd.DataFrame([r for r in rows if r[0] == site], columns=["site", "a", "b", "score"])
        matrix = mine.pivot(index="a", columns="b", values="score").fillna(0.0).clip(lower=0).to_numpy()
        best = sum(matrix[i, j] for i, j in kernels.assign(matrix))
        part = got[got.site == site]
        assert part.score.sum() == best and part.a.is_unique and part.b.is_unique


def test_rivals_and_overlap(spark):
    """A tick's pairs that compete: the lead counts, not the score alone."""
    s = Settings()
    rows = [("s", 1, "a", "b", "cam1", "cam2", 0.1, 6.0, 6.0, 9), ("s", 1, "a", "c", "cam1", "cam2", 0.1, 5.0, 5.0, 9), ("s", 1, "d", "e", "cam1", "cam2", 0.1, 4.5, 4.5, 9), ("s", 1, "d", "f", "cam1", "cam2", 0.1, 9.0, 9.0, 1)]
    found = {(r.a, r.b): (r.lead, r.rivalled, r.sure) for r in people.leads(spark.createDataFrame(rows, "site string, tick long, a string, b string, ca string, cb string, d double, place double, score double, n int"), s).collect()}
    assert found == {("a", "b"): (1.0, True, False), ("a", "c"): (-1.0, True, False), ("d", "e"): (4.5, False, True)}
