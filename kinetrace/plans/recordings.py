"""Views of a processed recording: rows of a camera with their identities, heads to hide, who moves or stands, cards and documents.

Events stand in for observations (user = track, hours for seconds); boxes and head points are formed from their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions import geometry as g
from kinetrace.functions.scalars import half_up
from kinetrace.operators.matching import kept_apart
from kinetrace.plans.registry import Registry
from kinetrace.sources.tables import VISITS_SQL, load, visits

query = Registry()
#: A closed segment of a recording, the moment asked for, and the step of its frames.
SEGMENT, MOMENT, STEP = (100.0, 130.0), 400.0, 2.5
PALETTE = 8

_OBS = f"""WITH {VISITS_SQL}, o AS (SELECT visit AS id, 'cam' || (1 + visit % 2) AS camera, member AS track, t, zone AS kind, sets, duration,
    px::DOUBLE AS x1, py::DOUBLE AS y1, (px + 40 + visit % 80)::DOUBLE AS x2, (py + 80 + visit % 150)::DOUBLE AS y2 FROM (
        SELECT *, CASE WHEN member % 4 = 0 THEN member * 37 % 500 + visit % 9 ELSE visit * 37 % 500 END AS px, CASE WHEN member % 4 = 0 THEN member * 53 % 300 + visit % 7 ELSE visit * 53 % 300 END AS py FROM visits))"""


def observations(spark, sf_dir) -> DataFrame:
    """id, camera, track, t, kind, sets, duration and the box; every fourth person stays in place."""
    v, k, m = visits(spark, sf_dir), F.col("visit"), F.col("member")
    x, y = (F.when(m % 4 == 0, m * f % n + k % j).otherwise(k * f % n) for f, n, j in ((37, 500, 9), (53, 300, 7)))
    box = [c.cast("double").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (x, y, x + 40 + k % 80, y + 80 + k % 150))]
    return v.select(k.alias("id"), F.concat(F.lit("cam"), (1 + k % 2).cast("string")).alias("camera"), F.col("member").alias("track"), "t", F.col("zone").alias("kind"), "sets", "duration", *box)


_NAMED = """, k AS (SELECT DISTINCT camera, track, camera || ':' || track AS tracklet FROM o WHERE track % 7 <> 0),
    g AS (SELECT tracklet, track // 3 AS gid FROM k WHERE track % 5 <> 0), l AS (SELECT DISTINCT gid, 'Person ' || lpad(gid::VARCHAR, 2, '0') AS label FROM g WHERE gid % 4 <> 0),
    n AS (SELECT o.*, tracklet, gid, label FROM o LEFT JOIN k USING (camera, track) LEFT JOIN g USING (tracklet) LEFT JOIN l USING (gid))"""


def with_identity(rows: DataFrame, tracklets: DataFrame, identities: DataFrame, labels: DataFrame) -> DataFrame:
    """Observations with their tracklet, identity and label; what is not known stays null and no row is lost."""
    return rows.join(tracklets, ["camera", "track"], "left").join(identities, "tracklet", "left").join(labels, "gid", "left")


def named(spark, sf_dir) -> DataFrame:
    o = observations(spark, sf_dir)
    k = o.where("track % 7 <> 0").select("camera", "track", F.concat_ws(":", "camera", F.col("track").cast("string")).alias("tracklet")).distinct()
    g = k.where("track % 5 <> 0").select("tracklet", F.floor(F.col("track") / 3).alias("gid"))
    label = F.concat(F.lit("Person "), F.lpad(F.col("gid").cast("string"), 2, "0")).alias("label")
    return with_identity(o, k, g, g.where("gid % 4 <> 0").select("gid", label).distinct())


@query(_OBS + _NAMED + " SELECT id, tracklet, gid, label FROM n")
def observation_identities(spark, sf_dir):
    """Tracklet, identity and label of every observation by left joins."""
    return named(spark, sf_dir).select("id", "tracklet", "gid", "label")


@query(_OBS + _NAMED + " SELECT camera, count(*) AS detections, count(gid) AS resolved, count(DISTINCT gid) AS people FROM n GROUP BY camera")
def resolved_detections(spark, sf_dir):
    """Observations of each camera, those with an identity, and how many identities they have."""
    return named(spark, sf_dir).groupBy("camera").agg(F.count(F.lit(1)).alias("detections"), F.count("gid").alias("resolved"), F.countDistinct("gid").alias("people"))


def camera_range(rows: DataFrame, camera: str, t0: float, t1: float, known: tuple[str, ...] = ("cam1", "cam2")) -> DataFrame:
    """The rows of one camera in a closed range; KeyError for a camera that is not there."""
    if camera not in known:
        raise KeyError(camera)
    return rows.where((F.col("camera") == camera) & F.col("t").between(t0, t1))


@query(_OBS + _NAMED + f" SELECT id, track, gid, floor(t * 1e6 + 0.5) / 1e6 AS t, round_even(x1 / 3, 0)::BIGINT AS left_, round_even(y2 / 3, 0)::BIGINT AS bottom FROM n WHERE camera = 'cam1' AND t BETWEEN {SEGMENT[0]} AND {SEGMENT[1]}")
def camera_observations(spark, sf_dir):
    """A camera's rows of a segment as a client gets them."""
    rows = camera_range(named(spark, sf_dir), "cam1", *SEGMENT)
    whole = lambda c: F.bround(F.col(c) / 3).cast("long")
    return rows.select("id", "track", "gid", half_up(F.col("t"), 6).alias("t"), whole("x1").alias("left_"), whole("y2").alias("bottom"))


@query(_OBS + f" SELECT id, track, camera FROM o WHERE kind = 'purchase' AND t BETWEEN {SEGMENT[0]} AND {SEGMENT[1]}")
def segment_events(spark, sf_dir):
    """Events of one type inside a closed segment."""
    return observations(spark, sf_dir).where((F.col("kind") == "purchase") & F.col("t").between(*SEGMENT)).select("id", "track", "camera")


@query(
    _OBS + f""", f AS (SELECT floor(t / {STEP} + 1e-6)::BIGINT AS frame, count(*) AS people, max(id) AS last FROM o GROUP BY 1), s AS (SELECT max(frame) + 1 AS n FROM f)
    SELECT o.id, greatest(0, least(n - 1, floor((t - 5) / {STEP} + 1e-6)::BIGINT)) AS frame, f.people, f.last FROM o CROSS JOIN s LEFT JOIN f ON f.frame = greatest(0, least(n - 1, floor((t - 5) / {STEP} + 1e-6)::BIGINT))"""
)
def frame_before(spark, sf_dir):
    """The frame at or before each moment of a clock that runs five behind, held in range, and what it shows."""
    o = observations(spark, sf_dir)
    f = o.groupBy(F.floor(F.col("t") / STEP + 1e-6).alias("frame")).agg(F.count(F.lit(1)).alias("people"), F.max("id").alias("last"))
    size = F.broadcast(f.agg((F.max("frame") + 1).alias("n")))  # one row
    frame = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor((F.col("t") - 5) / STEP + 1e-6)))
    return o.crossJoin(size).select("id", frame.alias("frame")).join(f, "frame", "left").select("id", "frame", "people", "last")


@query(
    _OBS + """, w AS (SELECT id, last_value(t) OVER w - first_value(t) OVER w AS dt, sqrt(pow(last_value(x1) OVER w - first_value(x1) OVER w, 2) + pow(last_value(y2) OVER w - first_value(y2) OVER w, 2)) AS d
        FROM o WINDOW w AS (PARTITION BY camera, track ORDER BY t, id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) SELECT id FROM w WHERE dt > 0.5 AND d / dt > 0.5"""
)
def moving_observations(spark, sf_dir):
    """Observations whose track gets on faster than half a metre a second over seven rows on either side."""
    w = Window.partitionBy("camera", "track").orderBy("t", "id").rowsBetween(-7, 7)
    change = lambda c: F.last(c).over(w) - F.first(c).over(w)
    rows = observations(spark, sf_dir).select("id", change("t").alias("dt"), F.hypot(change("x1"), change("y2")).alias("d"))
    return rows.where((F.col("dt") > 0.5) & (F.col("d") / F.col("dt") > 0.5)).select("id")


def stands(kp: Column) -> Column:
    """Whether eyes, hips, knees and ankles are seen, legs are straight, and the body has a standing person's size and proportion."""
    mid = lambda i, c: (kp[i][c] + kp[i + 1][c]) / 2
    seen = F.least(*[kp[i][2] for i in (1, 2, 11, 12, 13, 14, 15, 16)]) >= 0.5
    ax, ay, bx, by = mid(13, 0) - mid(11, 0), mid(13, 1) - mid(11, 1), mid(15, 0) - mid(13, 0), mid(15, 1) - mid(13, 1)
    straight = (ax * bx + ay * by) / (F.hypot(ax, ay) * F.hypot(bx, by) + 1e-9) >= 0.92
    leg, body = mid(15, 1) - mid(11, 1), mid(15, 1) - mid(1, 1)
    return seen & straight & (body >= 45) & (leg / body > 0.40) & (leg / body < 0.64)


def standing_samples(rows: DataFrame, per_second: float = 2.0) -> DataFrame:
    """camera_id, local_track_id, t_local, floor_point_px, eyes (their middle) of clearly standing people, at most so many a second of each track."""
    good = rows.where((F.col("floor_method") == "ankles") & ~F.array_contains("quality_flags", "touches_frame_edge") & F.col("keypoints").isNotNull()).where(stands(F.col("keypoints")))
    eyes = F.array(*[(F.col("keypoints")[1][c] + F.col("keypoints")[2][c]) / 2 for c in (0, 1)])
    found = good.select("camera_id", "local_track_id", "t_local", "floor_point_px", eyes.alias("eyes"))
    return kept_apart(found, ["camera_id", "local_track_id"], "t_local", 1 / per_second)


_HEADS = """, q AS (SELECT *, list_filter(list_transform(range(5), lambda k: {'x': x1 + 10 + (id * (k + 2) % 20), 'y': y1 + 5 + (id * (k + 3) % 15), 'c': (id * (k + 3) % 10) / 10.0}), lambda p: p.c >= 0.3) AS p FROM o),
    c AS (SELECT *, CASE WHEN len(p) >= 2 THEN list_avg(list_transform(p, lambda s: s.x)) ELSE (x1 + x2) / 2 END AS cx, CASE WHEN len(p) >= 2 THEN list_avg(list_transform(p, lambda s: s.y)) ELSE y1 + 0.12 * (y2 - y1) END AS cy,
        CASE WHEN len(p) >= 2 THEN greatest(0.32 * (x2 - x1), 1.2 * greatest(list_max(list_transform(p, lambda s: s.x)) - list_min(list_transform(p, lambda s: s.x)), 8)) ELSE 0.4 * (x2 - x1) END AS r FROM q),
    h AS (SELECT id, camera, track, t, round_even(cx - r, 0) AS h1, round_even(cy - r * 1.1, 0) AS h2, round_even(cx + r, 0) AS h3, round_even(cy + r, 0) AS h4 FROM c)"""


def head_boxes(rows: DataFrame, points: str = "points") -> DataFrame:
    """Adds the box h1..h4 around the head: from the head points that are seen, two at least, else from the upper part of the body's box."""
    seen = F.filter(points, lambda p: p["c"] >= 0.3)
    mean = lambda c: F.aggregate(seen, F.lit(0.0), lambda a, p: a + p[c]) / F.size(seen)
    xs, width = F.transform(seen, lambda p: p["x"]), F.col("x2") - F.col("x1")
    enough = F.size(seen) >= 2
    cx = F.when(enough, mean("x")).otherwise((F.col("x1") + F.col("x2")) / 2)
    cy = F.when(enough, mean("y")).otherwise(F.col("y1") + 0.12 * (F.col("y2") - F.col("y1")))
    r = F.when(enough, F.greatest(0.32 * width, 1.2 * F.greatest(F.array_max(xs) - F.array_min(xs), F.lit(8.0)))).otherwise(0.4 * width)
    out = rows.withColumns({"cx": cx, "cy": cy, "r": r})
    return out.select(*rows.columns, *[F.bround(c).alias(f"h{i}") for i, c in enumerate((F.col("cx") - F.col("r"), F.col("cy") - F.col("r") * 1.1, F.col("cx") + F.col("r"), F.col("cy") + F.col("r")), 1)])


def _heads(spark, sf_dir) -> DataFrame:
    point = lambda k: F.struct((F.col("x1") + 10 + F.col("id") * (k + 2) % 20).alias("x"), (F.col("y1") + 5 + F.col("id") * (k + 3) % 15).alias("y"), (F.col("id") * (k + 3) % 10 / 10.0).alias("c"))
    return head_boxes(observations(spark, sf_dir).withColumn("points", F.array(*map(point, range(5)))))


@query(_OBS + _HEADS + " SELECT id, h1::BIGINT AS h1, h2::BIGINT AS h2, h3::BIGINT AS h3, h4::BIGINT AS h4 FROM h")
def head_regions(spark, sf_dir):
    """Heads to be made unrecognisable."""
    return _heads(spark, sf_dir).select("id", *[F.col(f"h{i}").cast("long").alias(f"h{i}") for i in range(1, 5)])


#: A track must be there for so long, and its head box may wander by this share of its width.
PRESENT, WANDER, ROOM = 20.0, 0.35, 0.25


@query(
    _OBS + _HEADS + f""", m AS (SELECT camera, track, max(t) - min(t) AS span, median(h1) AS m1, median(h2) AS m2, median(h3) AS m3, median(h4) AS m4, median((h1 + h3) / 2) AS mx, median((h2 + h4) / 2) AS my FROM h GROUP BY camera, track),
    s AS (SELECT camera, track, m1, m2, m3, m4, median(sqrt(pow((h1 + h3) / 2 - mx, 2) + pow((h2 + h4) / 2 - my, 2))) AS spread FROM h JOIN m USING (camera, track) WHERE span >= {PRESENT} GROUP BY ALL)
    SELECT camera, track, trunc(m1 - {ROOM} * (m3 - m1))::BIGINT AS x1, trunc(m2 - {ROOM} * (m3 - m1))::BIGINT AS y1, trunc(m3 + {ROOM} * (m3 - m1))::BIGINT AS x2, trunc(m4 + {ROOM} * (m3 - m1))::BIGINT AS y2 FROM s WHERE spread <= {WANDER} * (m3 - m1)"""
)
def persistent_heads(spark, sf_dir):
    """The padded median head box of tracks that are there long and stay in place; medians are exact."""
    keys = ["camera", "track"]
    h = _heads(spark, sf_dir).withColumn("cx", (F.col("h1") + F.col("h3")) / 2).withColumn("cy", (F.col("h2") + F.col("h4")) / 2)
    middle = lambda c, n: F.percentile(c, 0.5).alias(n)
    m = h.groupBy(*keys).agg((F.max("t") - F.min("t")).alias("span"), *[middle(f"h{i}", f"m{i}") for i in range(1, 5)], middle("cx", "mx"), middle("cy", "my"))
    far = F.hypot(F.col("cx") - F.col("mx"), F.col("cy") - F.col("my"))
    spread = h.join(m.where(F.col("span") >= PRESENT), keys).withColumn("far", far).groupBy(*keys, "m1", "m2", "m3", "m4").agg(middle("far", "spread"))
    width = F.col("m3") - F.col("m1")
    kept = spread.where(F.col("spread") <= WANDER * width)
    return kept.select(*keys, *[(F.col(f"m{i}") + sign * ROOM * width).cast("long").alias(n) for i, sign, n in ((1, -1, "x1"), (2, -1, "y1"), (3, 1, "x2"), (4, 1, "y2"))])


_PEOPLE = """, p AS (SELECT track, min(t) AS first_seen, max(t + duration) AS last_seen, min({'t': t, 'id': id, 'e': t + duration, 'kind': kind}) FILTER (kind IN ('purchase', 'signup')) AS s, sum(sets)::BIGINT AS reps FROM o GROUP BY track)"""


def _people(spark, sf_dir) -> DataFrame:
    one = F.when(F.col("kind").isin("purchase", "signup"), F.struct("t", "id", (F.col("t") + F.col("duration")).alias("e"), "kind"))
    return observations(spark, sf_dir).groupBy("track").agg(F.min("t").alias("first_seen"), F.max(F.col("t") + F.col("duration")).alias("last_seen"), F.min(one).alias("s"), F.sum("sets").alias("reps"))


@query(_OBS + _PEOPLE + " SELECT track, floor(coalesce((s.t + s.e) / 2, (first_seen + last_seen) / 2) * 1e6 + 0.5) / 1e6 AS spotlight FROM p")
def spotlights(spark, sf_dir):
    """The moment to show of each person: the middle of the first set, else of the presence."""
    middle = F.coalesce((F.col("s.t") + F.col("s.e")) / 2, (F.col("first_seen") + F.col("last_seen")) / 2)
    return _people(spark, sf_dir).select("track", half_up(middle, 6).alias("spotlight"))


@query(_OBS + _PEOPLE + f" SELECT track, 'Person ' || track AS name, coalesce(s.kind, 'Resting') AS exercise, (track % {PALETTE})::INT AS colour, 'thumbs/' || track || '.jpg' AS thumbnail, reps FROM p")
def person_cards(spark, sf_dir):
    """What a list of people shows of each."""
    key = F.col("track").cast("string")
    return _people(spark, sf_dir).select("track", F.concat(F.lit("Person "), key).alias("name"), F.coalesce("s.kind", F.lit("Resting")).alias("exercise"), (F.col("track") % PALETTE).cast("int").alias("colour"), F.concat(F.lit("thumbs/"), key, F.lit(".jpg")).alias("thumbnail"), "reps")


#: Labels put right by hand, for all sets of a person.
OVERRIDES = {3: "row", 7: "press", 11: "dip"}


@query(
    _OBS + f""", r AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{v}')" for k, v in OVERRIDES.items())}) r(track, label))
    SELECT track, coalesce(label, kind) AS exercise, count(*) AS n_sets, sum(sets)::BIGINT AS reps FROM o LEFT JOIN r USING (track) GROUP BY 1, 2"""
)
def label_override(spark, sf_dir):
    """Sets and repetitions by exercise, where a label put right by hand counts instead of the found one."""
    right = spark.createDataFrame(list(OVERRIDES.items()), "track long, label string")
    o = observations(spark, sf_dir).join(F.broadcast(right), "track", "left").withColumn("exercise", F.coalesce("label", "kind"))  # a few rows made by hand
    return o.groupBy("track", "exercise").agg(F.count(F.lit(1)).alias("n_sets"), F.sum("sets").alias("reps"))


@query(
    _OBS + f""", a AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t DESC, id DESC) AS r, sum(sets) OVER (PARTITION BY track) AS done FROM o WHERE t <= {MOMENT})
    SELECT track, done::BIGINT AS reps, CASE WHEN t + duration >= {MOMENT} THEN kind ELSE 'Resting' END AS exercise, floor(x1 / 640 * 1e6 + 0.5) / 1e6 AS left_, floor((y2 - y1) / 480 * 1e6 + 0.5) / 1e6 AS height FROM a WHERE r = 1"""
)
def detections_at(spark, sf_dir):
    """Everyone at one moment: repetitions so far, the set that is on, the last box as shares of the picture."""
    until = observations(spark, sf_dir).where(F.col("t") <= MOMENT)
    last = until.groupBy("track").agg(F.sum("sets").alias("reps"), F.max(F.struct("t", "id", "duration", "kind", "x1", "y1", "y2")).alias("o"))
    exercise = F.when(F.col("o.t") + F.col("o.duration") >= MOMENT, F.col("o.kind")).otherwise("Resting")
    return last.select("track", "reps", exercise.alias("exercise"), half_up(F.col("o.x1") / 640, 6).alias("left_"), half_up((F.col("o.y2") - F.col("o.y1")) / 480, 6).alias("height"))


@query(
    _OBS + """, t AS (SELECT camera, floor(t / 24)::BIGINT AS day, count(*) AS n, count(DISTINCT track) AS people FROM o GROUP BY 1, 2)
    SELECT camera, to_json({'camera_id': camera, 'width': 640, 'height': 480}) AS config, string_agg(day || ':' || people, ',' ORDER BY day) AS timeline, to_json({'observations': sum(n)::BIGINT, 'days': count(*)}) AS metrics FROM t GROUP BY camera"""
)
def run_documents(spark, sf_dir):
    """Documents of each camera: configuration, people by day, and counts."""
    days = observations(spark, sf_dir).groupBy("camera", F.floor(F.col("t") / 24).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("track").alias("people"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("day", "people"))), lambda d: F.concat_ws(":", d["day"].cast("string"), d["people"].cast("string")))
    config = F.to_json(F.struct(F.col("camera").alias("camera_id"), F.lit(640).alias("width"), F.lit(480).alias("height")))
    metrics = F.to_json(F.struct(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("days")))
    return days.groupBy("camera").agg(F.array_join(line, ",").alias("timeline"), metrics.alias("metrics")).select("camera", config.alias("config"), "timeline", "metrics")


#: Picture edges that are followed to where they meet (pixels), its middle, and the depth of the room.
LEFT, RIGHT, TOP, BOTTOM, MIDDLE, DEPTH = 0.0, 853.0, 300.0, 480.0, 427.0, 30.0


def camera_pose(h: list[Column]) -> dict[str, Column]:
    """x, y, heading and field of view (degrees) of a camera from its floor matrix: where the floor lines of the two picture edges meet."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy), (mx, my) = (g.projected(h, F.lit(u), F.lit(v)) for u, v in ((LEFT, TOP), (LEFT, BOTTOM), (RIGHT, TOP), (RIGHT, BOTTOM), (MIDDLE, TOP)))
    along = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / ((bx - ax) * (dy - cy) - (by - ay) * (dx - cx))
    x, y = ax + along * (bx - ax), F.least(F.lit(DEPTH), ay + along * (by - ay))
    to = lambda px, py: F.degrees(F.atan2(py - y, px - x))
    wide = F.abs(to(cx, cy) - to(ax, ay))
    return {"x": half_up(x, 2), "y": half_up(y, 2), "heading": half_up(to(mx, my), 1), "fov": half_up(F.when(wide <= 180, wide).otherwise(360 - wide), 1)}


def _matrix(n) -> list:
    """A floor matrix for the n-th camera, row by row; n is a column or the name of one in SQL."""
    text = isinstance(n, str)
    scaled = lambda base, by: f"({base} + {n} * {by})" if text else F.lit(base) + n * by
    fixed = lambda x: str(x) if text else F.lit(x)
    return [scaled(0.02, 0.0003), fixed(0.001), fixed(0.5), fixed(0.0005), scaled(0.03, 0.0004), fixed(1.0), fixed(0.00001), scaled(0.0008, 0.00002), fixed(1.0)]


def _on_floor(u: float, v: float, c: str) -> str:
    h = [f"h{i}" for i in range(9)]
    w = f"({h[6]} * {u} + {h[7]} * {v} + {h[8]})"
    return f"({h[0]} * {u} + {h[1]} * {v} + {h[2]}) / {w} AS {c}x, ({h[3]} * {u} + {h[4]} * {v} + {h[5]}) / {w} AS {c}y"


@query(
    f"""WITH h AS (SELECT n_nationkey AS camera, {", ".join(f"{x}::DOUBLE AS h{i}" for i, x in enumerate(_matrix("n_nationkey")))} FROM nation),
    p AS (SELECT camera, {", ".join(_on_floor(u, v, c) for u, v, c in ((LEFT, TOP, "a"), (LEFT, BOTTOM, "b"), (RIGHT, TOP, "c"), (RIGHT, BOTTOM, "d"), (MIDDLE, TOP, "m")))} FROM h),
    s AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / ((bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx)) AS s FROM p),
    c AS (SELECT *, ax + s * (bx - ax) AS x, least({DEPTH}, ay + s * (b_y - ay)) AS y FROM s),
    w AS (SELECT *, degrees(atan2(my - y, mx - x)) AS heading, abs(degrees(atan2(cy - y, cx - x)) - degrees(atan2(ay - y, ax - x))) AS wide FROM c)
    SELECT camera, floor(x * 100 + 0.5) / 100 AS x, floor(y * 100 + 0.5) / 100 AS y, floor(heading * 10 + 0.5) / 10 AS heading, floor(CASE WHEN wide <= 180 THEN wide ELSE 360 - wide END * 10 + 0.5) / 10 AS fov FROM w""".replace(" AS by", " AS b_y")
)
def camera_poses(spark, sf_dir):
    """Where each camera stands, looks, and how wide it sees."""
    n = F.col("n_nationkey")
    pose = camera_pose(_matrix(n))
    return load(spark, sf_dir, "nation").select(n.alias("camera"), *[c.alias(k) for k, c in pose.items()])


# The step and the two odd masks of a public 32-bit mixing generator; as its state is a counter, every draw has its own place.
DRAW_STEP, DRAW_MASKS, WORD = 0x6D2B79F5, (1, 61), 1 << 32
STYLES = (("regular", 0.45), ("casual", 0.35), ("keen", 0.2))


def _mixing(seed: int, i: Column, kept) -> Column:
    """The i-th draw of a seeded generator; ``kept`` gets each intermediate value and its name, and says how it is referred to."""
    low = lambda x: x.bitwiseAND(F.lit(WORD - 1))
    shifted = lambda x, n: x.bitwiseXOR(F.shiftright(x, n))

    def product(x: Column, y: Column) -> Column:  # the lower word, in parts that cannot overflow
        return low(x * y.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(low(x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF)), 16))

    a = kept(low(F.lit(seed).cast("long") + (i.cast("long") + 1) * DRAW_STEP), "_a")
    b = kept(product(kept(shifted(a, 15), "_a15"), a.bitwiseOR(F.lit(DRAW_MASKS[0]))), "_b")
    c = kept(b.bitwiseXOR(low(b + product(kept(shifted(b, 7), "_b7"), b.bitwiseOR(F.lit(DRAW_MASKS[1]))))), "_c")
    return shifted(c, 14) / F.lit(float(WORD))


def draw(seed: int, i: Column) -> Column:
    """The i-th draw, from 0, of a seeded generator: uniform in [0, 1), the same wherever the row is computed."""
    return _mixing(seed, i, lambda value, name: value)


def drawn(rows: DataFrame, seed: int, i: Column, name: str = "u") -> DataFrame:
    """Adds the i-th draw of each row; every intermediate value is a column, so it is computed once and not wherever it is used."""
    out = [rows]

    def kept(value: Column, column: str) -> Column:
        out[0] = out[0].withColumn(column, value)
        return F.col(column)

    u = _mixing(seed, i, kept)
    return out[0].withColumn(name, u).select(*rows.columns, name)


def _draw_sql(seed: int, i: str, rows: str, carried: str) -> str:
    return f"""(SELECT {carried}, xor(c, c >> 14) / {float(WORD)} AS u FROM (SELECT *, xor(b, (b + ((xor(b, b >> 7)::HUGEINT * (b | {DRAW_MASKS[1]})) % {WORD})::BIGINT) % {WORD}) AS c FROM (
        SELECT *, ((xor(a, a >> 15)::HUGEINT * (a | {DRAW_MASKS[0]})) % {WORD})::BIGINT AS b FROM (SELECT *, ({seed} + ({i} + 1)::HUGEINT * {DRAW_STEP}) % {WORD} AS a0, a0::BIGINT AS a FROM {rows}))))"""


#: Days of the made-up record, draws kept for each member, and the weekly chance to stop.
DAYS, DRAWS, STOP = 182, 512, 0.01


@query(
    f"""WITH u AS (SELECT c_custkey AS member, d.day FROM customer, (SELECT unnest(range({DAYS})) AS day) d),
    j AS (SELECT member, u AS joins FROM {_draw_sql(42, f"member * {DRAWS}", "(SELECT c_custkey AS member FROM customer)", "member")}),
    s AS (SELECT member, CASE WHEN u < {STYLES[0][1]} THEN '{STYLES[0][0]}' WHEN u < {STYLES[0][1] + STYLES[1][1]} THEN '{STYLES[1][0]}' ELSE '{STYLES[2][0]}' END AS style FROM {_draw_sql(42, f"member * {DRAWS} + 1", "(SELECT c_custkey AS member FROM customer)", "member")}),
    k AS (SELECT member, min(week) AS stops FROM {_draw_sql(42, f"member * {DRAWS} + 2 + week", f"(SELECT c_custkey AS member, unnest(range({DAYS // 7})) AS week FROM customer)", "member, week")} WHERE u < {STOP} GROUP BY member),
    v AS (SELECT member, day, u FROM {_draw_sql(42, f"member * {DRAWS} + 64 + day", "u", "member, day")})
    SELECT member, floor(joins * {DAYS // 2})::INT AS join_day, style, count(*) FILTER (v.day >= floor(joins * {DAYS // 2}) AND v.day < coalesce(stops * 7, {DAYS}) AND v.u < CASE style WHEN 'keen' THEN 0.6 WHEN 'regular' THEN 0.35 ELSE 0.12 END) AS visits
    FROM v JOIN j USING (member) JOIN s USING (member) LEFT JOIN k USING (member) GROUP BY member, joins, style"""
)
def members_and_visits(spark, sf_dir):
    """Made-up members: when they join, how they train, and how often they come until they stop; a draw depends on seed and place only."""
    at = lambda rows, place, name="u": drawn(rows, 42, F.col("member") * DRAWS + place, name)
    days = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    m = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"))
    m = m.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "member")  # few bytes, much work: dealt to all tasks
    weeks = at(m.select("member", days(DAYS // 7, "week")), 2 + F.col("week"))
    m = weeks.groupBy("member").agg(F.coalesce(F.min(F.when(F.col("u") < STOP, F.col("week"))) * 7, F.lit(DAYS)).alias("stops"))
    m = at(at(m, 0, "joins"), 1, "kind")
    style = F.when(F.col("kind") < STYLES[0][1], STYLES[0][0]).when(F.col("kind") < STYLES[0][1] + STYLES[1][1], STYLES[1][0]).otherwise(STYLES[2][0])
    m = m.select("member", F.floor(F.col("joins") * (DAYS // 2)).cast("int").alias("join_day"), style.alias("style"), "stops")
    rate = F.when(F.col("style") == "keen", 0.6).when(F.col("style") == "regular", 0.35).otherwise(0.12)
    came = at(m.select("*", days(DAYS, "day")), 64 + F.col("day"))
    visits = F.count_if((F.col("day") >= F.col("join_day")) & (F.col("day") < F.col("stops")) & (F.col("u") < rate))
    return came.groupBy("member", "join_day", "style").agg(visits.alias("visits"))


__all__ = ["camera_pose", "camera_range", "draw", "drawn", "head_boxes", "query", "standing_samples", "stands", "with_identity"]
