"""Cameras calibrated from people who stand: each alone, then two of a site together.

Customers stand for people at known places, seen by two made-up cameras of a site whose parameters follow from its
number; so SQL can say what has to be found, and how many samples there are.  Eye heights vary, pixels are noisy, and
some eyes are far off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.operators.calibration import EYE, ground, joint_refine, pixel, self_calibrate
from kinetrace.operators.matching import Rounds
from kinetrace.plans.registry import Registry
from kinetrace.plans.world import aligned
from kinetrace.sources.tables import load

query = Registry()
SITES, CX, CY, SHIFT = 4, 640.0, 360.0, (3.0, -1.0)


def true_camera(side: str, s: Column) -> list[Column]:
    """Focal length, pitch, roll and height of a site's camera."""
    if side == "a":
        return [950 + 40.0 * s, 0.42 + 0.03 * s, 0.01 * s - 0.01, 4.2 + 0.3 * s]
    return [1080 - 30.0 * s, 0.5 + 0.02 * s, -0.01 * s, 4.8 - 0.2 * s]


def turn(s: Column) -> Column:
    """Angle between the floors of a site's cameras."""
    return 0.3 + 0.05 * s


def people(spark, sf_dir) -> DataFrame:
    """k, site and, for side a and b, the pixels of feet and eyes."""
    k = F.col("c_custkey").cast("long")
    rows = load(spark, sf_dir, "customer").select(k.alias("k"), (F.col("c_nationkey") % SITES).cast("long").alias("site"), (k * 37 % 100 / 100.0 * 8 - 4).alias("x"), (7 + k * 61 % 97 / 97.0 * 10).alias("y"))
    angle, s = turn(F.col("site")), F.col("site")
    dx, dy = F.col("x") - SHIFT[0], F.col("y") - SHIFT[1]
    places = {"a": (F.col("x"), F.col("y")), "b": (F.cos(angle) * dx + F.sin(angle) * dy, F.cos(angle) * dy - F.sin(angle) * dx)}
    noise = lambda f, n: (F.col("k") * f % n - n // 2) / (n / 2)  # noqa: E731  about one pixel either way
    tall = F.lit(EYE) + (F.col("k") * 13 % 21 - 10) * 0.005
    wrong = F.when(F.col("k") % 19 == 0, 60.0).otherwise(0.0)
    columns = []
    for i, (side, (x, y)) in enumerate(places.items()):
        cx, cy = F.lit(CX), F.lit(CY)
        foot, eye = pixel(true_camera(side, s), x, y, F.lit(0.0), cx, cy), pixel(true_camera(side, s), x, y, tall, cx, cy)
        columns += [(foot[0] + noise(7 + i, 11)).alias(f"{side}x"), (foot[1] + noise(5 + i, 13)).alias(f"{side}y"), (eye[0] + noise(3 + i, 11)).alias(f"{side}ex"), (eye[1] + noise(11 + i, 13) + wrong).alias(f"{side}ey")]
    return rows.select("k", "site", *columns)


def samples(rows: DataFrame, side: str, key: Column) -> DataFrame:
    return rows.select(key.alias("key"), *[F.col(f"{side}{c}").alias(n) for c, n in (("x", "fx"), ("y", "fy"), ("ex", "ex"), ("ey", "ey"))], F.lit(CX).alias("cx"), F.lit(CY).alias("cy"))


def calibrated(rows: DataFrame) -> DataFrame:
    """site, side, p of every camera; a camera's own samples are the people of its side's parity."""
    sides = [samples(rows.where(F.col("k") % 2 == i), side, F.concat(F.lit(side), F.col("site").cast("string"))) for i, side in enumerate("ab")]
    found = self_calibrate(sides[0].unionByName(sides[1]))
    return found.select(F.substring("key", 2, 9).cast("long").alias("site"), F.substring("key", 1, 1).alias("side"), "p")


_SITES = f"""WITH c AS (SELECT c_custkey AS k, (c_nationkey % {SITES})::BIGINT AS site FROM customer)"""


@query(f"{_SITES} SELECT site, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS side, count(*) AS samples, true AS focal, true AS pitch, true AS roll, true AS height FROM c GROUP BY ALL")
def camera_calibration(spark, sf_dir):
    """Whether focal length, pitch, roll and height of each camera are found again: within 80 pixels, 2 degrees, 2 degrees and half a metre."""
    rows = Rounds(spark, "cameras").keep(people(spark, sf_dir), "people")
    counts = rows.groupBy("site", F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("side")).agg(F.count(F.lit(1)).alias("samples"))
    known = [F.when(F.col("side") == "a", a).otherwise(b) for a, b in zip(true_camera("a", F.col("site")), true_camera("b", F.col("site")), strict=True)]
    near = [F.abs(F.col("p")[i] - known[i]) < most for i, most in enumerate((80.0, 0.035, 0.035, 0.5))]
    return calibrated(rows).join(counts, ["site", "side"]).select("site", "side", "samples", *[c.alias(n) for c, n in zip(near, ("focal", "pitch", "roll", "height"), strict=True)])


def bootstrap(rows: DataFrame) -> DataFrame:
    """site, p, pairs, median, p90: each camera alone, then the map between their floors by consensus, then all of it refined together; metres between the floors of people seen by both."""
    keep = Rounds(rows.sparkSession, "bootstrap").keep
    rows = keep(rows, "people")
    found = keep(calibrated(rows), "calibrated")
    both = found.groupBy("site").agg(*[F.first(F.when(F.col("side") == side, F.col("p")), True).alias(f"p{side}") for side in "ab"])
    met = rows.where("k % 3 = 0").select("k", F.col("site").alias("key"), *[F.col(f"{side}{c}") for side in "ab" for c in "xy"], *[F.lit(v).alias(n) for n, v in (("acx", CX), ("acy", CY), ("bcx", CX), ("bcy", CY))])
    met = keep(met, "met")

    def floors(p: dict[str, list[Column]]) -> list[Column]:
        return [c.alias(f"{side}{n}") for side in "ab" for n, c in zip(("gx", "gy"), ground(p[side], *[F.col(f"{side}{x}") for x in ("x", "y", "cx", "cy")]), strict=True)]

    alone = met.join(both.withColumnRenamed("site", "key"), "key").select("key", "k", *floors({side: [F.col(f"p{side}")[i] for i in range(4)] for side in "ab"}))
    maps = aligned(alone.select(F.col("key").alias("part"), F.col("k").cast("string").alias("key"), F.col("bgx").alias("ax"), F.col("bgy").alias("ay"), F.col("agx").alias("bx"), F.col("agy").alias("by")))
    starts = both.join(maps.withColumnRenamed("part", "site"), "site").select(F.col("site").alias("key"), F.lit(0).alias("start"), F.concat("pa", "pb", F.array("theta", "dx", "dy")).alias("p"))
    eyes = {side: samples(rows.where(F.col("k") % 2 == i), side, F.col("site")) for i, side in enumerate("ab")}
    refined = keep(joint_refine(starts, eyes, met.drop("k")), "refined")
    p = [F.col("p")[i] for i in range(11)]
    last = met.join(refined, "key").select("key", "p", *floors({"a": p[:4], "b": p[4:8]}))
    c, s = F.cos(p[8]), F.sin(p[8])
    d = F.hypot(F.col("agx") - c * F.col("bgx") + s * F.col("bgy") - p[9], F.col("agy") - s * F.col("bgx") - c * F.col("bgy") - p[10])
    return last.groupBy(F.col("key").alias("site")).agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("pairs"), F.percentile(d, 0.5).alias("median"), F.percentile(d, 0.9).alias("p90"))


@query(f"{_SITES} SELECT site, count(*) AS pairs, true AS angle, true AS shift, true AS agree FROM c WHERE k % 3 = 0 GROUP BY site")
def camera_bootstrap(spark, sf_dir):
    """Whether the cameras of each site are brought together: the angle within 2 degrees, the shift within half a metre, the floors within 0.2 m at the median."""
    found = bootstrap(people(spark, sf_dir))
    p = F.col("p")
    return found.select("site", "pairs", (F.abs(p[8] - turn(F.col("site"))) < 0.035).alias("angle"), (F.hypot(p[9] - SHIFT[0], p[10] - SHIFT[1]) < 0.5).alias("shift"), (F.col("median") < 0.2).alias("agree"))
