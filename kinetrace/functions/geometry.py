"""Boxes, projections, angles and evidence arithmetic as column expressions."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def projected(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Image of (x, y) under the row-major 3 x 3 matrix ``h``; null on the horizon."""
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def world_sigma(h: list[Column], x: Column, y: Column, sigma_px: Column) -> Column:
    """Distance on the floor between the images of a point and of one ``sigma_px`` below it."""
    (ax, ay), (bx, by) = projected(h, x, y), projected(h, x, y + sigma_px)
    return F.hypot(ax - bx, ay - by)


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def area(a: list[Column]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: list[Column], b: list[Column]) -> Column:
    shared = overlap_area(a, b)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def turn_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle at b in degrees from two arc tangents, folded to 180."""
    d = F.abs(F.degrees(F.atan2(cy - by, cx - bx) - F.atan2(ay - by, ax - bx)))
    return F.when(d > 180, 360 - d).otherwise(d)


def joint_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle at b in degrees from the clamped cosine; null where a side has no length."""
    dot = (ax - bx) * (cx - bx) + (ay - by) * (cy - by)
    size = F.nullif(F.hypot(ax - bx, ay - by) * F.hypot(cx - bx, cy - by), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """Cosine of two arrays of doubles; ``norms`` is the product of their lengths where it is known."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) if norms is None else norms
    return dot(a, b) / F.nullif(norms, F.lit(0.0))


def geometry_evidence(distance: Column, variance: Column, inside: Column, blind: Column, gate: float = 2.5, competitor: float = 1.5) -> Column:
    """Log likelihood ratio of one person against two ``competitor`` metres apart; see the order of overrides."""
    llr = -(distance * distance) / (2 * variance) - F.log(2 * pi * variance) + log(pi * competitor**2)
    llr = F.greatest(F.lit(-4.0), F.least(F.lit(2.5), llr))
    llr = F.when(distance > gate, -5.0).otherwise(llr)
    llr = F.when(~inside, F.least(llr, F.lit(-1.0))).otherwise(llr)
    return F.when(blind, F.least(llr, F.lit(0.0))).otherwise(llr)


def link_confidence(score: Column, margin: Column) -> Column:
    return F.round(1 / (1 + F.exp(-(F.least(score, margin + 4) - 4 + 1.5) / 1.2)), 3)


def inside_polygon_distance(x: Column, y: Column, polygon: Column) -> Column:
    """Signed distance to a polygon (array of [x, y]), positive inside."""
    n = F.size(polygon)
    edges = F.transform(polygon, lambda p, i: F.struct(p[0].alias("x0"), p[1].alias("y0"), polygon[(i + 1) % n][0].alias("x1"), polygon[(i + 1) % n][1].alias("y1")))

    def distance(e):
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - e["x0"]) * dx + (y - e["y0"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(x - e["x0"] - t * dx, y - e["y0"] - t * dy)

    def crosses(e):
        above = (e["y0"] > y) != (e["y1"] > y)
        at = e["x0"] + F.coalesce(F.try_divide((y - e["y0"]) * (e["x1"] - e["x0"]), e["y1"] - e["y0"]), F.lit(0.0))
        return above & (x < at)

    odd = F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e).cast("int")) % 2 == 1
    near = F.array_min(F.transform(edges, distance))
    return F.when(odd, near).otherwise(-near)
