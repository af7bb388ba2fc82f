"""Robust least squares for all cameras and starts at once, and the pinhole camera above a floor.

``least_squares`` is Gauss-Newton with damping: an iteration joins the rows with the present parameters, each task adds up
its part of the normal equations of every (key, start), and one aggregate sums the parts; what comes out, a row each, gets
its next step from a small linear solve.  Derivatives are differences of the residuals; the soft-L1 loss is a weight of each
residual.  Rows are never gathered, and after a few iterations only the best starts of a key go on.

``ground`` and ``pixel`` work on columns and, inside tasks, on numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.operators.matching import Rounds

#: Eye height in metres, focal prior and its spread as shares of the picture's width, its weight in pixels for twenty samples, weight of a metre between two cameras' floors.
EYE, FOCAL, FOCAL_SPREAD, PRIOR_PX, PX_PER_M = 1.57, 0.78, 0.16, 10.0, 20.0


@dataclass(frozen=True)
class Problem:
    """Bounds of the parameters, the differences that give derivatives, and where the loss turns from square to linear."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    step: tuple[float, ...]
    scale: float = 4.0


@dataclass(frozen=True)
class Block:
    """Rows (key, numbers ...) and their residuals, given the parameters and the columns by name, as arrays; ``uses`` are the parameters that matter."""

    rows: DataFrame
    residuals: Callable[[list, dict], list]
    uses: tuple[int, ...]


CAMERA = Problem((400.0, 0.05, -0.3, 1.5), (3000.0, 1.4, 0.3, 30.0), (0.5, 1e-4, 1e-4, 1e-3))
PAIR = Problem(CAMERA.low * 2 + (-10.0, -200.0, -200.0), CAMERA.high * 2 + (10.0, 200.0, 200.0), CAMERA.step * 2 + (1e-4, 1e-3, 1e-3))
#: Rows of a key that go through a step together.
PACK = 2000
#: Greatest relative change of a parameter at which an iteration ends.
TOLERANCE = 3e-5
#: Starts of a camera: focal length, pitch, height.
STARTS = [(f, pitch, 0.0, h) for f in (800.0, 1000.0, 1300.0) for pitch in (0.35, 0.6, 0.85) for h in (4.0, 7.0)]


def _divisor(value, m):
    return value if m is np else F.nullif(value, F.lit(0.0))


def ground(p: list, x, y, cx, cy, m=F) -> tuple:
    """Floor point under a pixel; p are focal length, pitch, roll and height, the camera stands at (0, 0) and looks along +y."""
    f, pitch, roll, height = p
    u, v = (x - cx) / f, (y - cy) / f
    u, v = m.cos(roll) * u + m.sin(roll) * v, m.cos(roll) * v - m.sin(roll) * u
    far = height / _divisor(v * m.cos(pitch) + m.sin(pitch), m)
    return far * u, far * (m.cos(pitch) - v * m.sin(pitch))


def pixel(p: list, x, y, z, cx, cy, m=F) -> tuple:
    """Pixel of the point (x, y, z)."""
    f, pitch, roll, height = p
    depth = _divisor(m.cos(pitch) * y - m.sin(pitch) * (z - height), m)
    u, v = x / depth, -(m.sin(pitch) * y + m.cos(pitch) * (z - height)) / depth
    return f * (m.cos(roll) * u - m.sin(roll) * v) + cx, f * (m.sin(roll) * u + m.cos(roll) * v) + cy


def _packed(rows: DataFrame) -> DataFrame:
    """key, _pack and the other columns as arrays: rows of a key put together, about ``PACK`` of them, so that parameters go along once for all of these."""
    names = [c for c in rows.columns if c != "key"]
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("_packs"))
    dealt = rows.join(F.broadcast(sizes), "key").withColumn("_pack", F.pmod(F.xxhash64(*names), F.col("_packs")))
    packs = dealt.groupBy("key", "_pack").agg(F.collect_list(F.struct(*names)).alias("_rows"))
    return packs.select("key", "_pack", *[F.col(f"_rows.{c}").alias(c) for c in names])


def _sums(block: Block, state: DataFrame, problem: Problem) -> DataFrame:
    """key, start, a (upper triangle by rows), g, cost: parts of the normal equations of one block."""
    uses, residuals, m, upper = block.uses, block.residuals, len(problem.step), np.triu_indices(len(problem.step))
    names = [c for c in block.rows.columns if c not in ("key", "_pack")]

    def at(p: np.ndarray, columns: dict) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.nan_to_num(np.stack(residuals(list(p), columns)), nan=1e6, posinf=1e6, neginf=-1e6)  # a point beyond the horizon

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for pack in rows.to_dict("records"):
                key, start, q, columns = pack["key"], pack["start"], np.asarray(pack["q"], float), {c: np.asarray(pack[c], float) for c in names}
                r = at(q, columns)
                jacobian = np.zeros((m, *r.shape))
                for j in uses:
                    moved = q.copy()
                    moved[j] += problem.step[j]
                    jacobian[j] = (at(moved, columns) - r) / problem.step[j]
                size = np.sqrt(1 + (r / problem.scale) ** 2)
                weighted = jacobian / size
                out.append((key, start, (weighted.reshape(m, -1) @ jacobian.reshape(m, -1).T)[upper].tolist(), (weighted.reshape(m, -1) @ r.ravel()).tolist(), float(2 * problem.scale**2 * (size - 1).sum())))
            yield pd.DataFrame(out, columns=["key", "start", "a", "g", "cost"])

    kind = block.rows.schema["key"].dataType.simpleString()
    few = F.broadcast(state.select("key", "start", "q"))  # a row for each start of each key
    return block.rows.join(few, "key").mapInPandas(parts, f"key {kind}, start int, a array<double>, g array<double>, cost double")


def _stepped(problem: Problem):
    """The next proposal of every row: better ones are taken and the damping eased, worse ones dropped and tried again closer by."""
    low, high = np.array(problem.low), np.array(problem.high)
    m = len(low)
    upper = np.triu_indices(m)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                better = r.new_cost < r.cost
                p, a, g, cost = (r.q, r.new_a, r.new_g, r.new_cost) if better else (r.p, r.a, r.g, r.cost)
                damp = max(r.damp / 4, 1e-9) if better else min(r.damp * 5, 1e9)
                full = np.zeros((m, m))
                full[upper] = a
                full = full + np.triu(full, 1).T
                size = np.diag(full) + 1e-12
                q = np.clip(np.asarray(p) - np.linalg.solve(full + damp * np.diag(size), np.asarray(g)), low, high)
                out.append((r.key, r.start, list(p), q.tolist(), list(a), list(g), float(cost), damp, float(np.max(np.abs(q - np.asarray(p)) / (1 + np.abs(q))))))
            yield pd.DataFrame(out, columns=["key", "start", "p", "q", "a", "g", "cost", "damp", "moved"])

    return step


def least_squares(problem: Problem, starts: DataFrame, blocks: list[Block], most: int = 40, screen: int = 6, keep_best: int = 3, log: Callable[[int, float], None] | None = None) -> DataFrame:
    """key, p, cost: the best parameters of each key found from its starts (key, start, p)."""
    rounds = Rounds(starts.sparkSession, "least-squares")
    kind = starts.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start int, p array<double>, q array<double>, a array<double>, g array<double>, cost double, damp double, moved double"
    m = len(problem.low)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    state = starts.select("key", F.col("start").cast("int").alias("start"), "p", F.col("p").alias("q"), zeros(m * (m + 1) // 2).alias("a"), zeros(m).alias("g"), F.lit(float("inf")).alias("cost"), F.lit(0.01).alias("damp"), F.lit(1.0).alias("moved"))
    state = rounds.keep(state, "state")
    blocks = [replace(block, rows=rounds.keep(_packed(block.rows), "rows")) for block in blocks]
    for n in range(most):
        sums = _sums(blocks[0], state, problem)
        for block in blocks[1:]:
            sums = sums.unionByName(_sums(block, state, problem))
        total = lambda c, k: F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c)
        sums = sums.groupBy("key", "start").agg(total("a", m * (m + 1) // 2), total("g", m), F.sum("cost").alias("cost"))
        sums = sums.select("key", "start", F.col("a").alias("new_a"), F.col("g").alias("new_g"), F.col("cost").alias("new_cost"))
        state = rounds.keep(state.drop("moved").join(sums, ["key", "start"]).mapInPandas(_stepped(problem), schema), "state")
        if n == screen:
            w = Window.partitionBy("key").orderBy("cost", "start")
            state = rounds.keep(state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep_best).drop("rank"), "state")
        moved = state.agg(F.max("moved")).first()[0]
        if log:
            log(n, moved)
        if moved is None or moved < TOLERANCE:
            break
    return state.groupBy("key").agg(F.min_by("p", F.struct("cost", "start")).alias("p"), F.min("cost").alias("cost"))


def _eyes(p: list, rows: dict) -> list:
    x, y = ground(p, rows["fx"], rows["fy"], rows["cx"], rows["cy"], np)
    u, v = pixel(p, x, y, EYE, rows["cx"], rows["cy"], np)
    return [u - rows["ex"], v - rows["ey"]]


def _prior(f: float, rows: dict) -> list:
    """How far a focal length is from the usual one, once for a camera, heavier for more samples."""
    width = 2 * rows["cx"]
    return [(f - FOCAL * width) / (FOCAL_SPREAD * width) * PRIOR_PX * np.sqrt(np.maximum(1.0, rows["n"] / 20.0))]


def self_calibrate(samples: DataFrame, log=None) -> DataFrame:
    """key, p (focal length, pitch, roll, height), cost of each camera (key) from standing people: foot (fx, fy), eyes (ex, ey), picture centre (cx, cy)."""
    sizes = samples.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("cx").alias("cx"))
    starts = sizes.select("key", F.posexplode(F.array(*[F.array(*map(F.lit, s)) for s in STARTS])).alias("start", "p"))
    prior = Block(sizes, lambda p, rows: _prior(p[0], rows), (0,))
    return least_squares(CAMERA, starts, [Block(samples, _eyes, (0, 1, 2, 3)), prior], log=log)


def joint_refine(starts: DataFrame, eyes: dict[str, DataFrame], met: DataFrame, log=None) -> DataFrame:
    """key, p, cost of pairs of cameras: both cameras' parameters and the rigid map (angle, x, y) of the second's floor to the first's.

    ``starts`` has key, start, p; ``eyes`` the samples of side a and b, by key of the pair; ``met`` pixels (ax, ay, bx, by) of people
    seen by both at one time, with the centres (acx, acy, bcx, bcy).
    """

    def apart(p: list, rows: dict) -> list:
        ax, ay = ground(p[:4], *[rows[c] for c in ("ax", "ay", "acx", "acy")], np)
        bx, by = ground(p[4:8], *[rows[c] for c in ("bx", "by", "bcx", "bcy")], np)
        c, s = np.cos(p[8]), np.sin(p[8])
        return [(ax - c * bx + s * by - p[9]) * PX_PER_M, (ay - s * bx - c * by - p[10]) * PX_PER_M]

    blocks = [Block(met, apart, tuple(range(11)))]
    for side, first in (("a", 0), ("b", 4)):
        rows = eyes[side]
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("cx").alias("cx"))
        blocks.append(Block(rows, lambda p, r, i=first: _eyes(p[i : i + 4], r), tuple(range(first, first + 4))))
        blocks.append(Block(sizes, lambda p, r, i=first: _prior(p[i], r), (first,)))
    return least_squares(PAIR, starts, blocks, log=log)
