"""Identities in made-up rooms."""

import math

from kinetrace.operators.identity import Resolver

TICK = 0.2


def walk(camera, key, t0, t1, path, noise=0.03, sigma=0.2):
    return [(round(t / TICK), (key, camera, *(c + noise * math.sin(13 * t + len(camera) + i) for i, c in enumerate(path(t))), sigma, False)) for t in [t0 + i * TICK for i in range(int((t1 - t0) / TICK))]]


def run(*tracks):
    by = {}
    for track in tracks:
        for tick, row in track:
            by.setdefault(tick, []).append(row)
    resolver, people = Resolver(), []
    for tick in range(max(by) + 1):
        people += resolver.step(tick, by.get(tick, []))
    return resolver, people + resolver.finish()


def line(t):
    return 1 + 0.5 * t, 2.0


def test_one_person_two_cameras():
    resolver, people = run(walk("cam1", "a", 0, 12, line), walk("cam2", "b", 0, 12, line))
    assert resolver.ids["a"] == resolver.ids["b"]
    assert {p["person"] for p in people if p["tick"] == 30} == {resolver.ids["a"]}
    assert next(p for p in people if p["tick"] == 30)["cameras"] == "cam1,cam2"


def test_hand_off():
    resolver, _ = run(walk("cam1", "a", 0, 10, line), walk("cam2", "b", 7, 18, line))
    assert resolver.ids["a"] == resolver.ids["b"]


def test_occlusion_at_one_place():
    still = lambda t: (4.0, 4.0)
    resolver, people = run(walk("cam1", "a", 0, 10, still), walk("cam1", "b", 12, 20, still))
    assert resolver.ids["a"] == resolver.ids["b"]
    assert {p["state"] for p in people if p["tick"] == 55} == {"occluded"}


def test_neighbours_in_one_camera_stay_apart():
    a, b = (lambda t: (4.0, 4.0)), (lambda t: (4.6, 4.0))
    resolver, _ = run(walk("cam1", "a", 0, 10, a), walk("cam1", "b", 0, 10, b), walk("cam2", "c", 0, 10, a), walk("cam2", "d", 0, 10, b))
    assert resolver.ids["a"] != resolver.ids["b"] and resolver.ids["c"] != resolver.ids["d"]


def test_no_teleporting():
    resolver, _ = run(walk("cam1", "a", 0, 5, lambda t: (0.0, 0.0)), walk("cam1", "b", 5.4, 10, lambda t: (13.0, 0.0)))
    assert resolver.ids["a"] != resolver.ids["b"]


def test_exit_and_drop():
    _, people = run(walk("cam1", "a", 0, 4, line), walk("cam1", "z", 0, 20, lambda t: (50.0, 50.0)))
    states = [p["state"] for p in people if p["person"] == 1]
    assert states[:2] == ["active", "active"] and "exited" in states and len(states) == 20 + 35
