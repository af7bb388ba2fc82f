"""Anonymous identities of one site from the tracks of several cameras, decided with a fixed lag.

``Resolver.step`` takes the observations of one tick and returns the people of the tick ``lag`` ago, seen with all
evidence up to now.  Its whole state is in plain attributes, so it can be kept between batches of a stream.

Cross-camera links: evidence of each pair adds up over common ticks; an optimal one-to-one assignment of the pairs with
enough overlap confirms a link when score and margin over the rivals suffice, keeps a confirmed one that is contested,
and revokes one whose score falls below the floor.  Re-acquisition: a track that starts near where an identity was lost,
at a walkable distance, takes it over when the best candidate leads clearly; an unclear one is marked ambiguous for a while.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np

from kinetrace.operators.kernels import assign, merged


@dataclass(frozen=True)
class Settings:
    tick_s: float = 0.2
    lag_s: float = 3.0
    gate_m: float = 2.5
    competitor_m: float = 1.5
    tau_s: float = 1.0
    link: float = 4.0
    margin: float = 2.0
    pending: float = 1.5
    revoke: float = 0.5
    overlap_s: float = 0.8
    conflict_m: float = 1.5
    walk_m_s: float = 2.0
    walk_delay_s: float = 2.0
    lost_s: float = 90.0
    room_m2: float = 300.0
    need: float = 3.0
    need_per_s: float = 0.05
    occluded_s: float = 5.0
    exited_s: float = 2.0
    ambiguous_s: float = 8.0
    confirmed: float = 0.75


@dataclass
class Seen:
    """What is kept of a track."""

    camera: str
    first: int
    last: int
    x: float
    y: float
    x0: float
    y0: float
    ticks: int = 1
    decided: bool = False


@dataclass
class Pair:
    score: float = 0.0
    ticks: int = 0
    distance: float = 0.0
    near: bool = False


def _rivals(score: np.ndarray) -> np.ndarray:
    """For each cell the greatest other score of its row and its column."""

    def others(x: np.ndarray) -> np.ndarray:  # by row: the greatest, or the second where the cell is the greatest itself
        if x.shape[1] < 2:
            return np.full(x.shape, -np.inf)
        order = np.argsort(-x, axis=1, kind="stable")
        first, second = (np.take_along_axis(x, order[:, i : i + 1], 1) for i in (0, 1))
        return np.where(np.arange(x.shape[1]) == order[:, :1], second, first)

    return np.maximum(others(score), others(score.T).T)


@dataclass
class Resolver:
    settings: Settings = Settings()
    tracks: dict[str, Seen] = field(default_factory=dict)
    pairs: dict[tuple[str, str], Pair] = field(default_factory=dict)
    links: dict[tuple[str, str], float] = field(default_factory=dict)  # confirmed, with their confidence score
    ids: dict[str, int] = field(default_factory=dict)  # track -> identity
    ambiguous: dict[int, int] = field(default_factory=dict)  # identity -> tick until which it is unclear
    since: dict[int, int] = field(default_factory=dict)
    events: list[tuple] = field(default_factory=list)
    waiting: deque = field(default_factory=deque)
    together: set[frozenset] = field(default_factory=set)  # two tracks of one camera seen in one tick
    next_id: int = 1
    now: int = -1  # the last tick

    def step(self, tick: int, rows: list[tuple[str, str, float, float, float, bool]]) -> list[dict]:
        """rows: (track, camera, x, y, sigma, edge) of one tick; ticks must rise."""
        self.now = tick
        for key, camera, x, y, *_ in rows:
            seen = self.tracks.get(key)
            if seen:
                seen.last, seen.x, seen.y, seen.ticks = tick, x, y, seen.ticks + 1
            else:
                self.tracks[key] = Seen(camera, tick, tick, x, y, x, y)
        self._forget(tick)
        self._evidence(rows)
        self._decide(tick, {r[0] for r in rows})
        self._reacquire(tick)
        self._number(tick)
        self.waiting.append((tick, rows))
        out = []
        while self.waiting and tick - self.waiting[0][0] >= round(self.settings.lag_s / self.settings.tick_s):
            out += self._people(*self.waiting.popleft())
        return out

    def finish(self) -> list[dict]:
        """The people of the ticks that are still inside the lag."""
        out = []
        while self.waiting:
            out += self._people(*self.waiting.popleft())
        return out

    def _forget(self, tick: int) -> None:
        """Drops tracks that can neither be re-acquired nor shown any more, so the state stays bounded."""
        oldest = tick - round((self.settings.lost_s + self.settings.lag_s) / self.settings.tick_s)
        for key in [k for k, t in self.tracks.items() if t.last < oldest]:
            del self.tracks[key]
            self.ids.pop(key, None)
            self.ambiguous.pop(key, None)
            self.pairs = {p: v for p, v in self.pairs.items() if key not in p}
            self.links = {p: v for p, v in self.links.items() if key not in p}
            self.together = {p for p in self.together if key not in p}

    def _evidence(self, rows) -> None:
        s = self.settings
        for i, (a, ca, xa, ya, sa, ea) in enumerate(rows):
            for b, cb, xb, yb, sb, eb in rows[i + 1 :]:
                if ca == cb:
                    self.together.add(frozenset((a, b)))
                    continue
                d, v = float(np.hypot(xa - xb, ya - yb)), sa * sa + sb * sb
                llr = float(np.clip(-d * d / (2 * v) - np.log(2 * np.pi * v) + np.log(np.pi * s.competitor_m**2), -4, 2.5))
                if d > s.gate_m:
                    llr = -5.0
                if ea or eb:
                    llr = min(llr, 0.0)
                pair = self.pairs.setdefault((a, b) if a < b else (b, a), Pair())
                pair.score += llr * s.tick_s / s.tau_s
                pair.ticks += 1
                pair.distance += d
                pair.near |= d <= s.gate_m

    def _decide(self, tick: int, active: set[str]) -> None:
        s = self.settings
        cameras = sorted({self.tracks[k].camera for k in active})
        for i, ca in enumerate(cameras):
            for cb in cameras[i + 1 :]:
                left = sorted(k for k in active if self.tracks[k].camera == ca)
                right = sorted(k for k in active if self.tracks[k].camera == cb)
                score = np.full((len(left), len(right)), -1000.0)
                for m, a in enumerate(left):
                    for n, b in enumerate(right):
                        pair = self.pairs.get((a, b) if a < b else (b, a))
                        if pair and pair.ticks * s.tick_s >= s.overlap_s - 1e-9:
                            score[m, n] = pair.score
                lead = score - np.maximum(0.0, _rivals(score))
                sure = (score >= s.link) & (lead >= s.margin)
                for m, n in assign(score):
                    if sure[m, n]:
                        key = tuple(sorted((left[m], right[n])))
                        if key not in self.links:
                            self.events.append((tick, "cross_camera_link", *key))
                        self.links[key] = float(min(score[m, n], lead[m, n] + 4))
        for key in [k for k in self.links if k in self.pairs and self.pairs[k].score < s.revoke and (k[0] in active or k[1] in active)]:
            del self.links[key]
            self.events.append((tick, "link_revoked", *key))

    def _reacquire(self, tick: int) -> None:
        """Once for each track, two seconds after its start or at its end."""
        s = self.settings
        for key, seen in self.tracks.items():
            if seen.decided or tick - seen.first < round(2.0 / s.tick_s) and seen.last == tick:
                continue
            seen.decided = True
            found = []
            for other, was in self.tracks.items():
                gap = (seen.first - was.last) * s.tick_s
                if other == key or not 0 < gap <= s.lost_s or any(other in link for link in self.links if key in link):
                    continue
                d = float(np.hypot(seen.x0 - was.x, seen.y0 - was.y))
                if d / max(gap + s.walk_delay_s, 1e-9) > s.walk_m_s or self._taken(other, seen.first):
                    continue
                spread = 0.5 + 0.15 * s.walk_m_s * gap
                found.append((np.log(s.room_m2 / (2 * np.pi * spread**2)) - d * d / (2 * spread**2), other, gap))
            if not found or any(key in link for link in self.links):
                continue
            found.sort(key=lambda f: (-f[0], f[1]))
            best, other, gap = found[0]
            margin = best - max(0.0, found[1][0] if len(found) > 1 else 0.0)
            need = s.need + s.need_per_s * gap
            if best >= need and margin >= s.margin:
                self.links[tuple(sorted((key, other)))] = float(best + 4 - need)
                self.events.append((tick, "reacquired", key, other))
            elif best >= s.pending:
                self.ambiguous[key] = tick + round(s.ambiguous_s / s.tick_s)
                self.events.append((tick, "ambiguous", key, other))

    def _taken(self, key: str, tick: int) -> bool:
        """Whether the identity of a track was seen elsewhere at that tick."""
        mine = self.ids.get(key)
        return any(i == mine and k != key and self.tracks[k].last >= tick > self.tracks[k].first for k, i in self.ids.items())

    def _number(self, tick: int) -> None:
        """Clusters of linked tracks; the oldest keeps the smallest earlier identity, the others get new ones."""
        s = self.settings
        names = sorted(self.tracks)
        place = {k: i for i, k in enumerate(names)}
        apart = {frozenset(place[k] for k in pair) for pair in self.together}
        apart |= {frozenset((place[a], place[b])) for (a, b), p in self.pairs.items() if p.ticks >= 2 and (not p.near or p.distance / p.ticks > s.conflict_m)}
        roots = merged(len(names), [(c, place[a], place[b]) for (a, b), c in self.links.items()], apart)
        members: dict[int, list[str]] = {}
        for name, root in zip(names, roots):
            members.setdefault(root, []).append(name)
        begun = {root: min(self.tracks[k].first for k in mine) for root, mine in members.items()}
        by_age = sorted(members, key=lambda root: (begun[root], members[root]))
        holds = {root: sorted({self.ids[k] for k in members[root] if k in self.ids}) for root in by_age}
        owner: dict[int, int] = {}  # identity -> the cluster that keeps it: the oldest that holds it and has none yet
        for root in by_age:
            free = [i for i in holds[root] if i not in owner]
            if free:
                owner[free[0]] = root
        kept = {root: identity for identity, root in owner.items()}
        for root in by_age:
            if root not in kept:
                kept[root], self.next_id = self.next_id, self.next_id + 1
                self.events.append((tick, "identity_split" if holds[root] else "identity_created", kept[root]))
            else:
                self.events += [(tick, "identities_merged", kept[root], other) for other in holds[root] if other not in owner]
            self.since.setdefault(kept[root], begun[root])
        self.ids = {k: kept[root] for root, mine in members.items() for k in mine}

    def _people(self, tick: int, rows) -> list[dict]:
        s = self.settings
        here: dict[int, list] = {}
        for row in rows:
            here.setdefault(self.ids[row[0]], []).append(row)
        out = []
        for person in sorted(set(self.ids.values())):
            mine = [k for k, i in self.ids.items() if i == person]
            if person in here:
                w = np.array([1 / r[4] ** 2 for r in here[person]])
                x, y = (float((np.array([r[c] for r in here[person]]) * w).sum() / w.sum()) for c in (2, 3))
                unseen, cameras = 0.0, sorted({r[1] for r in here[person]})
            else:
                past = [self.tracks[k] for k in mine if self.tracks[k].last < tick]
                if not past or any(self.tracks[k].first <= tick <= self.tracks[k].last for k in mine):
                    continue
                last = max(past, key=lambda t: t.last)
                x, y, unseen, cameras = last.x, last.y, (tick - last.last) * s.tick_s, []
            if unseen > s.occluded_s + s.exited_s:
                continue
            observed = sum(self.tracks[k].ticks for k in mine) * s.tick_s
            confidence = 0.55 + 0.4 * min(1.0, observed / 3)
            strength = [1 / (1 + np.exp(-(c - 4 + 1.5) / 1.2)) for link, c in self.links.items() if set(link) <= set(mine)]
            confidence = max([confidence, *([min(strength)] if strength else [])]) * float(np.exp(-unseen / 5))
            unclear = any(self.ambiguous.get(k, -1) >= tick for k in mine)
            confidence = min(confidence, 0.5) if unclear else confidence
            state = "active" if not unseen else "occluded" if unseen <= s.occluded_s else "exited"
            shown = None if state == "exited" else "Needs confirmation" if unclear else "Confirmed" if confidence >= s.confirmed else "Tracking"
            out.append({"tick": tick, "person": person, "x": x, "y": y, "cameras": ",".join(cameras), "state": "ambiguous" if unclear else state, "confidence": round(confidence, 4), "shown": shown})
        return out
