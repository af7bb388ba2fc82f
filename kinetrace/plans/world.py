"""Two-camera evidence: projection, gates, likelihood ratios, fusion, matching and evaluation.

Observations of two cameras are made from events (see ``observations``), appearance vectors are the embeddings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions import geometry as g
from kinetrace.functions.scalars import clock, half_up, ramp
from kinetrace.operators import kernels, people
from kinetrace.operators.identity import Settings
from kinetrace.operators.matching import Rounds, merged
from kinetrace.operators.people import leads
from kinetrace.operators.relational import mutual, nearest, top
from kinetrace.plans.registry import Registry
from kinetrace.sources.tables import load

query = Registry()
GATE, TICK = 2.5, 3600
#: Camera to floor matrices, row-major.
MATRICES = {"cam1": (0.02, 0.001, 0.5, 0.0005, 0.03, 1.0, 0.00001, 0.0001, 1.0), "cam2": (0.018, -0.002, 1.0, 0.001, 0.028, 0.7, -0.00001, 0.0002, 1.0)}
SIMILARITY_KNOTS = people.LOOKS

_OBS = """WITH o AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS site, 'cam' || (1 + event_id % 2) AS camera, user_id % 40 AS track, (epoch_us(ts) // 3600000000) AS tick, user_id * 4 + value / 10 AS px, 100 + value AS py,
        0.2 + (event_id % 7) / 10.0 AS sigma, event_type AS kind, event_id % 5 = 0 AS edge FROM events),
    m AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {', '.join(map(str, h))})" for c, h in MATRICES.items()) + """) m(camera, h0, h1, h2, h3, h4, h5, h6, h7, h8)),
    p AS (SELECT o.*, (h0 * px + h1 * py + h2) / (h6 * px + h7 * py + h8) AS x, (h3 * px + h4 * py + h5) / (h6 * px + h7 * py + h8) AS y,
        sqrt(pow((h0 * px + h1 * py + h2) / (h6 * px + h7 * py + h8) - (h0 * px + h1 * (py + 8) + h2) / (h6 * px + h7 * (py + 8) + h8), 2)
            + pow((h3 * px + h4 * py + h5) / (h6 * px + h7 * py + h8) - (h3 * px + h4 * (py + 8) + h5) / (h6 * px + h7 * (py + 8) + h8), 2)) AS reach FROM o JOIN m USING (camera))"""


def observations(spark, sf_dir) -> DataFrame:
    """id, site (a day's recording), camera, track, tick, pixel and sigma."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("site"), F.concat(F.lit("cam"), (1 + F.col("event_id") % 2).cast("string")).alias("camera"), (F.col("user_id") % 40).alias("track"),
        F.floor(F.unix_micros("ts") / 3_600_000_000).alias("tick"), (F.col("user_id") * 4 + F.col("value") / 10).alias("px"), (100 + F.col("value")).alias("py"),
        (0.2 + F.col("event_id") % 7 / 10.0).alias("sigma"), F.col("event_type").alias("kind"), (F.col("event_id") % 5 == 0).alias("edge"),
    )


def project(observations: DataFrame, matrices: dict) -> DataFrame:
    """Adds the floor position x, y and the reach of eight pixels; the matrices are one row per camera."""
    spark = observations.sparkSession
    table = spark.createDataFrame([(c, *map(float, h)) for c, h in matrices.items()], "camera string, " + ", ".join(f"h{i} double" for i in range(9)))
    joined = observations.join(F.broadcast(table), "camera")
    h = [F.col(f"h{i}") for i in range(9)]
    x, y = g.projected(h, F.col("px"), F.col("py"))
    return joined.select(*observations.columns, x.alias("x"), y.alias("y"), g.world_sigma(h, F.col("px"), F.col("py"), F.lit(8.0)).alias("reach"))


def _floor(spark, sf_dir) -> DataFrame:
    return project(observations(spark, sf_dir), MATRICES)


def r6(x):
    return half_up(x, 6)


@query(_OBS + " SELECT id, floor(x * 1e6 + 0.5) / 1e6 AS x, floor(y * 1e6 + 0.5) / 1e6 AS y, floor(reach * 1e6 + 0.5) / 1e6 AS reach FROM p")
def projected_observations(spark, sf_dir):
    return _floor(spark, sf_dir).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), r6(F.col("reach")).alias("reach"))


_TICKS = """, k AS (SELECT camera, track, tick, median(x) AS x, median(y) AS y, median(sigma) AS sigma, count(*) AS n, bool_and(edge) AS blind FROM p GROUP BY ALL),
    q AS (SELECT a.track AS a, b.track AS b, a.tick, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, a.sigma * a.sigma + b.sigma * b.sigma AS v, a.blind OR b.blind AS blind, b.x < 12 AS inside
        FROM k a JOIN k b ON a.tick = b.tick AND a.camera = 'cam1' AND b.camera = 'cam2'),
    e AS (SELECT *, CASE WHEN blind THEN least(i, 0) ELSE i END AS llr FROM (SELECT *, CASE WHEN NOT inside THEN least(h, -1) ELSE h END AS i FROM (
        SELECT *, CASE WHEN d > 2.5 THEN -5 ELSE greatest(-4, least(2.5, -(d * d) / (2 * v) - ln(2 * pi() * v) + ln(pi() * 2.25))) END AS h FROM q)))"""


def ticks(floor: DataFrame) -> DataFrame:
    """Median position of each track and tick; blind only if every observation is cut by the edge."""
    return floor.groupBy("camera", "track", "tick").agg(
        F.median("x").alias("x"), F.median("y").alias("y"), F.median("sigma").alias("sigma"), F.count(F.lit(1)).alias("n"), F.bool_and("edge").alias("blind")
    )


def evidence(ticks: DataFrame) -> DataFrame:
    """Log likelihood ratio of every pair of tracks of two cameras at each common tick, by an equi-join on the tick."""
    a, b = (ticks.where(F.col("camera") == c).select("tick", *[F.col(x).alias(f"{x}_{s}") for x in ("track", "x", "y", "sigma", "blind")]) for c, s in (("cam1", "a"), ("cam2", "b")))
    pairs = a.join(b, "tick")
    d, v = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")), F.col("sigma_a") * F.col("sigma_a") + F.col("sigma_b") * F.col("sigma_b")
    pairs = pairs.select(F.col("track_a").alias("a"), F.col("track_b").alias("b"), "tick", d.alias("d"), v.alias("v"), (F.col("blind_a") | F.col("blind_b")).alias("blind"), (F.col("x_b") < 12).alias("inside"))
    return pairs.withColumn("llr", g.geometry_evidence(F.col("d"), F.col("v"), F.col("inside"), F.col("blind"), GATE))


@query(
    _OBS + _TICKS + """ SELECT a, b, count(*) AS n, floor(sum(llr) * 1e5 + 0.5) / 1e5 AS score, floor(min(d) * 1e6 + 0.5) / 1e6 AS nearest FROM e GROUP BY a, b HAVING min(d) <= 2.5"""
)
def pair_evidence(spark, sf_dir):
    """Evidence of pairs that ever pass the distance gate."""
    e = evidence(ticks(_floor(spark, sf_dir))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("llr"), 5).alias("score"), F.min("d").alias("low"))
    return e.where(F.col("low") <= GATE).select("a", "b", "n", "score", r6(F.col("low")).alias("nearest"))


@query(
    _OBS + _TICKS + """, s AS (SELECT a, b, sum(llr) AS score, count(*) * 0.2 AS overlap FROM e GROUP BY a, b),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY floor(score * 1e6 + 0.5) DESC, b) AS k, lead(score) OVER (PARTITION BY a ORDER BY floor(score * 1e6 + 0.5) DESC, b) AS second FROM s WHERE overlap >= 0.4)
    SELECT a, b, floor((score - greatest(0, coalesce(second, 0))) * 1e4 + 0.5) / 1e4 AS margin, CASE WHEN score >= 4 AND score - greatest(0, coalesce(second, 0)) >= 2 THEN 'confirmed' WHEN score > 1.5 THEN 'pending' ELSE 'none' END AS decision
    FROM r WHERE k = 1"""
)
def best_candidates(spark, sf_dir):
    """Best partner of each track with its margin over the second."""
    s = evidence(ticks(_floor(spark, sf_dir))).groupBy("a", "b").agg(F.sum("llr").alias("score"), (F.count(F.lit(1)) * 0.2).alias("overlap")).where("overlap >= 0.4")
    w = Window.partitionBy("a").orderBy(r6(F.col("score")).desc(), "b")
    r = s.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("k = 1")
    margin = F.col("score") - F.greatest(F.lit(0.0), F.coalesce("second", F.lit(0.0)))
    decision = F.when((F.col("score") >= 4) & (margin >= 2), "confirmed").when(F.col("score") > 1.5, "pending").otherwise("none")
    return r.select("a", "b", half_up(margin, 4).alias("margin"), decision.alias("decision"))


@query(_OBS + _TICKS + " SELECT track, tick, floor(sum(x / (sigma * sigma)) / sum(1 / (sigma * sigma)) * 1e6 + 0.5) / 1e6 AS x, floor(sum(y / (sigma * sigma)) / sum(1 / (sigma * sigma)) * 1e6 + 0.5) / 1e6 AS y, count(*) AS cameras FROM k GROUP BY track, tick")
def inverse_variance_fusion(spark, sf_dir):
    """Position of each track from all cameras, weighted by certainty."""
    w = 1 / (F.col("sigma") * F.col("sigma"))
    fused = lambda c: r6(F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return ticks(_floor(spark, sf_dir)).groupBy("track", "tick").agg(fused("x"), fused("y"), F.count(F.lit(1)).alias("cameras"))


@query(
    _OBS + _TICKS + """, n AS (SELECT a, b, tick, d, row_number() OVER (PARTITION BY tick, a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY tick, b ORDER BY d, a) AS rb FROM q),
    c AS (SELECT a, b, count(*) AS n FROM n WHERE ra = 1 AND rb = 1 AND d < 6 GROUP BY a, b) SELECT sum(least(n, 8))::BIGINT AS support, count(*) AS pairs FROM c"""
)
def capped_support(spark, sf_dir):
    """Support of an alignment: mutual nearest neighbours by tick, each pair counted at most eight times."""
    pairs = mutual(evidence(ticks(_floor(spark, sf_dir))), ["tick"], "a", "b", "d").where("d < 6")
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum(F.least("n", F.lit(8))).alias("support"), F.count(F.lit(1)).alias("pairs"))


_VEC = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT * FROM v WHERE vec_id % 20 = 0), c AS (SELECT l.vec_id AS a, v.vec_id AS b, l.label AS la, v.label AS lb, list_cosine_similarity(l.e, v.e) AS s FROM l JOIN v ON l.vec_id <> v.vec_id)"


#: Queries and vectors that meet in one task of the similarity search.
QUERY_BLOCK, VECTOR_CELL = 1 << 13, 1 << 15


def most_similar(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """a, b, s, la, lb, rank: the k vectors most similar by cosine to each query (vec_id, label, e); exact, so all rows meet all queries.

    Queries are dealt into blocks and vectors into cells of bounded size; a block meets a cell in one task as a product of two
    matrices, which keeps its own k best.  A vector is copied once for each ``QUERY_BLOCK`` queries and a query once for each
    ``VECTOR_CELL`` vectors, neither side is broadcast, and pairs are never rows: what is left to rank is k rows for each query and cell.
    """
    blocks, cells = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // VECTOR_CELL))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.where("e is not null").select("vec_id", "label", "e", dealt(cells).alias("cell"), every(blocks).alias("block"))
    q = queries.where("e is not null").select(F.col("vec_id").alias("own"), F.col("label").alias("name"), F.col("e").alias("asked"), dealt(blocks).alias("block"), every(cells).alias("cell"))

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame(columns=["a", "b", "la", "lb", "s"])
        order = np.argsort(v.vec_id.to_numpy(), kind="stable")
        right, left = np.stack(v.e.to_numpy()[order]), np.stack(q.asked.to_numpy())
        ids, own = v.vec_id.to_numpy()[order], q.own.to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            right, left = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (right, left))
        found = []
        for some in np.array_split(np.arange(len(left)), max(1, len(left) * len(right) >> 22)):
            s = np.nan_to_num(left[some] @ right.T, nan=-np.inf)
            s[own[some][:, None] == ids] = -np.inf
            near = np.argsort(-np.floor(s * 1e9 + 0.5), axis=1, kind="stable")[:, :k]  # of equals the least id first
            at = np.repeat(some, near.shape[1])
            found.append((own[at], ids[near.ravel()], at, order[near.ravel()], np.take_along_axis(s, near, 1).ravel()))
        a, b, at, place, s = (np.concatenate(c) for c in zip(*found, strict=True))
        out = pd.DataFrame({"a": a, "b": b, "la": q["name"].to_numpy()[at], "lb": v.label.to_numpy()[place], "s": s})
        return out[np.isfinite(out.s)]

    kind = dict(vectors.dtypes)
    schema = f"a {kind['vec_id']}, b {kind['vec_id']}, la {kind['label']}, lb {kind['label']}, s double"
    pairs = v.groupBy("block", "cell").cogroup(q.groupBy("block", "cell")).applyInPandas(best, schema)
    return top(pairs, ["a"], [half_up(F.col("s"), 9).desc(), F.col("b")], k, "k")


@query(
    _VEC + """, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY floor(s * 1e9 + 0.5) DESC, b) AS k FROM c)
    SELECT a, b, k::INT AS k, floor(CASE WHEN s <= 0 THEN -2 WHEN s <= 0.3 THEN -2 + s / 0.3 WHEN s <= 0.5 THEN -1 + (s - 0.3) / 0.2 WHEN s <= 0.7 THEN (s - 0.5) / 0.2 WHEN s <= 1 THEN 1 + (s - 0.7) / 0.3 ELSE 2 END * 1e5 + 0.5) / 1e5 AS llr,
    la = lb AS same FROM r WHERE k <= 5"""
)
def cosine_llr_topk(spark, sf_dir):
    """Five most similar vectors of every twentieth one, the stated queries, and the evidence of the similarity."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    r = most_similar(v, v.where("vec_id % 20 = 0"), 5)
    return r.select("a", "b", "k", half_up(ramp(F.col("s"), SIMILARITY_KNOTS), 5).alias("llr"), (F.col("la") == F.col("lb")).alias("same"))


@query(
    """WITH b AS (SELECT c_custkey AS id, [c_nationkey * 10.0, c_acctbal % 50, c_nationkey * 10.0 + 30, c_acctbal % 50 + 40] AS x, [c_nationkey * 10.0 + 5, 20.0, c_nationkey * 10.0 + 45, 70.0] AS y FROM customer WHERE c_acctbal > 0),
    s AS (SELECT id, greatest(0, least(x[3], y[3]) - greatest(x[1], y[1])) * greatest(0, least(x[4], y[4]) - greatest(x[2], y[2])) AS i, (x[3] - x[1]) * (x[4] - x[2]) AS ax, (y[3] - y[1]) * (y[4] - y[2]) AS ay FROM b)
    SELECT id, floor(i / (ax + ay - i) * 1e6 + 0.5) / 1e6 AS iou, floor(least(1, i / ax) * 1e6 + 0.5) / 1e6 AS covered FROM s"""
)
def box_overlap(spark, sf_dir):
    c = load(spark, sf_dir, "customer").where("c_acctbal > 0")
    n, a = F.col("c_nationkey") * 10.0, F.col("c_acctbal") % 50
    x, y = [n, a, n + 30, a + 40], [n + 5, F.lit(20.0), n + 45, F.lit(70.0)]
    return c.select(F.col("c_custkey").alias("id"), r6(g.iou(x, y)).alias("iou"), r6(F.least(F.lit(1.0), g.overlap_area(x, y) / g.area(x))).alias("covered"))


@query(
    """WITH p AS (SELECT event_id AS id, value AS v, event_id % 17 + 1.0 AS a, event_id % 13 - 6.0 AS b FROM events),
    q AS (SELECT id, abs(degrees(atan2(b, a)) - degrees(atan2(10.0, v))) AS d, degrees(acos(greatest(-1, least(1, (v * a + 10 * b) / (sqrt(v * v + 100) * sqrt(a * a + b * b)))))) AS c FROM p)
    SELECT id, floor(CASE WHEN d > 180 THEN 360 - d ELSE d END * 10 + 0.5) / 10 AS turn, floor(c * 1e4 + 0.5) / 1e4 AS joint FROM q"""
)
def joint_angles(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("v"), (F.col("event_id") % 17 + 1.0).alias("a"), (F.col("event_id") % 13 - 6.0).alias("b"))
    points = (F.col("v"), F.lit(10.0), F.lit(0.0), F.lit(0.0), F.col("a"), F.col("b"))
    return e.select("id", half_up(g.turn_angle(*points), 1).alias("turn"), half_up(g.joint_angle(*points), 4).alias("joint"))


@query(
    """WITH s AS (SELECT event_id AS id, value / 60 AS score, (event_id % 9) / 2.0 AS margin, value AS sec FROM events)
    SELECT id, floor(1000 / (1 + exp(-(least(score, margin + 4) - 4 + 1.5) / 1.2)) + 0.5) / 1000 AS confidence, floor(sec / 60)::BIGINT || ':' || lpad((floor(sec)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM s"""
)
def link_confidences(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), g.link_confidence(F.col("value") / 60, F.col("event_id") % 9 / 2.0).alias("confidence"), clock(F.col("value")).alias("clock"))


@query(
    """WITH RECURSIVE m AS (SELECT n_nationkey AS gid, n_nationkey // 3 AS into_ FROM nation), r AS (SELECT gid, gid AS root, 0 AS d FROM m UNION ALL SELECT r.gid, m.into_, d + 1 FROM r JOIN m ON m.gid = r.root WHERE m.into_ <> r.root)
    SELECT gid, arg_max(root, d) AS root FROM r GROUP BY gid"""
)
def merge_chain_root(spark, sf_dir):
    """The identity that each absorbed one ends in."""
    load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gid"), F.floor(F.col("n_nationkey") / 3).cast("int").alias("into_")).createOrReplaceTempView("kinetrace_merges")
    return spark.sql(
        """WITH RECURSIVE r AS (
            SELECT gid, gid AS root, 0 AS d FROM kinetrace_merges
            UNION ALL SELECT r.gid, m.into_, d + 1 FROM r JOIN kinetrace_merges m ON m.gid = r.root WHERE m.into_ <> r.root)
        SELECT gid, max_by(root, d) AS root FROM r GROUP BY gid"""
    )


@query(
    _OBS + """, w AS (SELECT DISTINCT track, tick FROM p WHERE camera = 'cam2'), l AS (SELECT id, tick, track FROM p WHERE camera = 'cam1')
    SELECT id, (SELECT arg_min(tick, abs(w.tick - l.tick) * 10 - (w.tick > l.tick)::INT) FROM w WHERE w.track = l.track AND abs(w.tick - l.tick) <= 4) AS near FROM l"""
)
def asof_with_tolerance(spark, sf_dir):
    """Nearest tick of the other camera within four, the later on ties, null beyond."""
    o = observations(spark, sf_dir)
    right = o.where("camera = 'cam2'").select("tick", "track").distinct().withColumn("near", F.col("tick"))
    left = o.where("camera = 'cam1'").select("id", "tick", "track")
    return nearest(left, right, ["track"], "tick", ["near"], within=4, cell=64).select("id", "near")


@query(
    _OBS + """, t AS (SELECT track, tick, count(DISTINCT camera) AS cameras, count(DISTINCT kind) AS kinds, min(kind) AS main FROM p GROUP BY track, tick), s AS (SELECT *, lag(main) OVER (PARTITION BY track ORDER BY tick) AS before FROM t)
    SELECT track, count(*) AS ticks, count(*) FILTER (kinds > 1) AS splits, count(*) FILTER (cameras = 2) AS both, count(*) FILTER (cameras = 2 AND kinds = 1) AS unified, count(*) FILTER (main <> before) AS switches FROM s GROUP BY track"""
)
def evaluation_counts(spark, sf_dir):
    """Splits, both-camera ticks, unified ticks and switches of each person; the main identity of a tick is the smallest."""
    t = observations(spark, sf_dir).groupBy("track", "tick").agg(F.countDistinct("camera").alias("cameras"), F.countDistinct("kind").alias("kinds"), F.min("kind").alias("main"))
    s = t.withColumn("before", F.lag("main").over(Window.partitionBy("track").orderBy("tick")))
    both = F.col("cameras") == 2
    return s.groupBy("track").agg(
        F.count(F.lit(1)).alias("ticks"), F.count_if(F.col("kinds") > 1).alias("splits"), F.count_if(both).alias("both"),
        F.count_if(both & (F.col("kinds") == 1)).alias("unified"), F.count_if(F.col("main") != F.col("before")).alias("switches"),
    )


@query(
    """WITH d AS (SELECT event_id AS id, event_type AS type, value AS v FROM events) SELECT type, count(*) AS n, count(*) FILTER (v > 250) AS high FROM d WHERE type IN ('view', 'click', 'purchase') GROUP BY type"""
)
def run_metrics(spark, sf_dir):
    """Counts of the published event types."""
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    return e.groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 250).alias("high"))


@query(_OBS + " SELECT id, tick FROM p WHERE tick BETWEEN 473400 AND 473500 AND (tick - 473400) % 5 = 0 AND NOT edge")
def world_range(spark, sf_dir):
    """Every fifth tick of a closed range."""
    return observations(spark, sf_dir).where("tick between 473400 and 473500 and (tick - 473400) % 5 = 0 and not edge").select("id", "tick")


def site_ticks(spark, sf_dir) -> DataFrame:
    """Median position of each track and tick, with its site."""
    at = ticks(_floor(spark, sf_dir))
    return at.withColumn("site", F.date_format(F.timestamp_seconds(F.col("tick") * 3600), "yyyy-MM-dd"))


def site_scores(at: DataFrame, value: Column) -> DataFrame:
    """site, a, b, score of every pair of tracks that share ticks of a site."""
    return evidence(at).withColumn("site", F.date_format(F.timestamp_seconds(F.col("tick") * 3600), "yyyy-MM-dd")).groupBy("site", "a", "b").agg(value.alias("score"))


def best_links(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, score: the one-to-one links of greatest total score among those of ``scores`` (keys, a, b, score) with a positive one.

    Links without evidence for them never add to a total, so tracks that no chain of positive links joins cannot affect each
    other: a group of the kernel is such a chain, found by rounds of joins, not a whole recording.
    """
    kept = Rounds(scores.sparkSession, "assignment").keep(scores.where("score > 0").select(*keys, "a", "b", "score"), "scores")
    side = lambda c: F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))
    edges = kept.select(*keys, side("a").alias("a"), side("b").alias("b"), "score")
    nodes = edges.select(*keys, F.explode(F.array("a", "b")).alias("item")).distinct()
    chains = merged(nodes, edges, edges.drop("score").limit(0), keys).select(*keys, F.col("item").alias("_a"), F.col("root").alias("chain"))
    linked = kept.withColumn("_a", side("a")).join(chains, [*keys, "_a"]).drop("_a")

    names = kept.columns

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.pivot(index="a", columns="b", values="score").sort_index().sort_index(axis=1)
        found = [(matrix.index[i], matrix.columns[j]) for i, j in kernels.assign(matrix.fillna(0.0).to_numpy()) if matrix.iat[i, j] > 0]
        return rows.merge(pd.DataFrame(found, columns=["a", "b"]))[names]

    return linked.groupBy(*keys, "chain").applyInPandas(links, kept.schema)


@query()
def optimal_assignment(spark, sf_dir):
    """One-to-one links of the two cameras' tracks that maximise the evidence, for each site."""
    found = best_links(site_scores(site_ticks(spark, sf_dir), F.sum("llr")), ["site"])
    return found.select("site", "a", "b", F.round("score", 5).alias("score"))


_KINDS = "click error purchase signup view".split()


@query(
    _OBS.replace("WITH o AS", "WITH RECURSIVE o AS") + f""", n AS (SELECT camera, track, kind, count(*) AS n FROM p GROUP BY ALL),
    r AS (SELECT camera, track, {", ".join(f"coalesce(sum(n) FILTER (kind = '{k}'), 0)::BIGINT AS n{i}" for i, k in enumerate(_KINDS))} FROM n GROUP BY camera, track),
    t AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY track) AS i, [n0, n1, n2, n3, n4] AS n FROM r),
    f AS (
        SELECT camera, 0::BIGINT AS i, list_transform(range(32), lambda m: CASE WHEN m = 0 THEN 0 ELSE -1000000000 END::BIGINT) AS best FROM (SELECT DISTINCT camera FROM t)
        UNION ALL
        SELECT f.camera, t.i, list_transform(range(32), lambda m: greatest(f.best[m + 1],
            {", ".join(f"CASE WHEN m // {1 << k} % 2 = 1 THEN f.best[m - {1 << k} + 1] + t.n[{k + 1}] ELSE -1000000000 END" for k in range(5))})::BIGINT)
        FROM f JOIN t ON t.camera = f.camera AND t.i = f.i + 1),
    b AS (SELECT camera, list_max(arg_max(best, i)) AS idtp FROM f GROUP BY camera), s AS (SELECT camera, sum(n) AS total FROM n GROUP BY camera)
    SELECT camera, idtp, floor(idtp / total * 1e6 + 0.5) / 1e6 AS idf1 FROM b JOIN s USING (camera)"""
)
def idf1(spark, sf_dir):
    """Identity scores of predicted kinds against tracks: co-occurrence, optimal assignment, then F1; predictions and truth have the same rows."""
    counts = observations(spark, sf_dir).groupBy("camera", "track", "kind").agg(F.count(F.lit(1)).alias("n"))

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.pivot(index="track", columns="kind", values="n").fillna(0).sort_index().sort_index(axis=1).to_numpy()
        hit = sum(matrix[i, j] for i, j in kernels.assign(matrix))
        return pd.DataFrame({"camera": [rows.camera.iloc[0]], "idtp": [int(hit)], "idf1": [np.floor(hit / matrix.sum() * 1e6 + 0.5) / 1e6]})

    return counts.groupBy("camera").applyInPandas(score, "camera string, idtp long, idf1 double")


@query(
    _OBS.replace("WITH o AS", "WITH RECURSIVE o AS") + _TICKS + """, d AS (SELECT *, strftime(make_timestamp(tick * 3600000000), '%Y-%m-%d') AS site FROM k),
    t AS (SELECT site, camera, track, row_number() OVER (PARTITION BY site ORDER BY camera, track) - 1 AS item FROM (SELECT DISTINCT site, camera, track FROM d)),
    s AS (SELECT strftime(make_timestamp(tick * 3600000000), '%Y-%m-%d') AS site, a, b, floor(avg(llr) * 1e9 + 0.5) / 1e9 AS score FROM e GROUP BY ALL HAVING avg(llr) > -4),
    l AS (SELECT s.site, x.item AS a, y.item AS b, row_number() OVER (PARTITION BY s.site ORDER BY score DESC, x.item, y.item) AS step FROM s
        JOIN t x ON x.site = s.site AND x.camera = 'cam1' AND x.track = s.a JOIN t y ON y.site = s.site AND y.camera = 'cam2' AND y.track = s.b),
    w AS (SELECT DISTINCT m.site, x.item AS a, y.item AS b FROM d m JOIN d n ON m.site = n.site AND m.camera = n.camera AND m.tick = n.tick AND m.track < n.track
        JOIN t x ON x.site = m.site AND x.camera = m.camera AND x.track = m.track JOIN t y ON y.site = n.site AND y.camera = n.camera AND y.track = n.track),
    z AS (SELECT t.site, count(*) AS n, (SELECT coalesce(list({'a': a, 'b': b}), []) FROM w WHERE w.site = t.site) AS walls FROM t GROUP BY t.site),
    r AS (
        SELECT site, 0::BIGINT AS step, range(n) AS roots FROM z
        UNION ALL
        SELECT site, step, CASE WHEN ra = rb OR len(list_filter(walls, lambda p: (roots[p.a + 1] = ra AND roots[p.b + 1] = rb) OR (roots[p.a + 1] = rb AND roots[p.b + 1] = ra))) > 0 THEN roots
            ELSE list_transform(roots, lambda x: CASE WHEN x = greatest(ra, rb) THEN least(ra, rb) ELSE x END) END
        FROM (SELECT r.site, l.step, r.roots, r.roots[l.a + 1] AS ra, r.roots[l.b + 1] AS rb, z.walls FROM r JOIN l ON l.site = r.site AND l.step = r.step + 1 JOIN z ON z.site = r.site)),
    f AS (SELECT site, arg_max(roots, step) AS roots FROM r GROUP BY site)
    SELECT t.site, t.camera, t.track, f.roots[t.item + 1] AS identity FROM t JOIN f ON f.site = t.site"""
)
def identity_clusters(spark, sf_dir):
    """Tracks of a site merged by falling evidence, unless two of one camera would meet in a tick; in rounds of joins."""
    at = site_ticks(spark, sf_dir)
    names = at.select("site", "camera", "track").distinct().withColumn("item", (F.row_number().over(Window.partitionBy("site").orderBy("camera", "track")) - 1).cast("long"))
    names = Rounds(spark, "clusters").keep(names, "names")
    number = lambda camera, side: names.where(F.col("camera") == camera).select("site", F.col("track").alias(side), F.col("item").alias(f"_{side}"))
    scores = site_scores(at, F.avg("llr")).where("score > -4").join(number("cam1", "a"), ["site", "a"]).join(number("cam2", "b"), ["site", "b"])
    links = scores.select("site", F.col("_a").alias("a"), F.col("_b").alias("b"), half_up(F.col("score"), 9).alias("score"))
    seen = at.join(names, ["site", "camera", "track"]).select("site", "camera", "tick", "item")
    meeting = seen.withColumnRenamed("item", "a").join(seen.withColumnRenamed("item", "b"), ["site", "camera", "tick"]).where("a < b").select("site", "a", "b").distinct()
    roots = merged(names, links, meeting, ["site"])
    return names.join(roots, ["site", "item"]).select("site", "camera", "track", F.col("root").alias("identity"))


#: Landmarks clicked for one camera.
CLICKS = 10


@query(
    f"""WITH m AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {', '.join(map(str, h))})" for i, h in enumerate(MATRICES.values())) + f""") m(kind, h0, h1, h2, h3, h4, h5, h6, h7, h8)),
    c AS (SELECT s_suppkey // {CLICKS} AS camera, s_suppkey % {CLICKS} AS i, (s_suppkey * 37 % 101 * 6)::DOUBLE AS px, (s_suppkey * 53 % 89 * 4 + 100)::DOUBLE AS py FROM supplier),
    e AS (SELECT camera, CASE WHEN camera % 3 = 1 AND i = 3 THEN 1.2 WHEN camera % 3 = 2 AND i IN (3, 7) THEN (5 - i) * 4.5 ELSE 0 END AS off, (h0 * px + h1 * py + h2) / (h6 * px + h7 * py + h8) AS x, (h3 * px + h4 * py + h5) / (h6 * px + h7 * py + h8) AS y
        FROM c JOIN m ON kind = camera % 2),
    r AS (SELECT camera, sqrt(avg(off * off)) AS rmse, max(abs(off)) AS worst, (max(x + off) - min(x + off)) * (max(y) - min(y)) AS spread FROM e GROUP BY camera)
    SELECT camera, round(rmse, 4) AS rmse, round(worst, 4) AS worst, CASE WHEN rmse < 0.3 AND spread > 4 THEN 'good' WHEN rmse < 0.6 THEN 'fair' ELSE 'weak' END AS grade FROM r"""
)
def homography_check(spark, sf_dir):
    """Fit, errors and grade of each camera's matrix from its clicked landmarks.

    The fit comes from the consensus of the good clicks, so its errors are those of the wrong ones: none, one by 1.2 m, or two by 9 m either way.
    """
    k = F.col("s_suppkey")
    clicks = load(spark, sf_dir, "supplier").select(F.floor(k / CLICKS).alias("camera"), (k % CLICKS).alias("i"), (k * 37 % 101 * 6).cast("double").alias("px"), (k * 53 % 89 * 4 + 100).cast("double").alias("py"))
    kinds = [F.array(*map(F.lit, map(float, h))) for h in MATRICES.values()]
    h = F.when(F.col("camera") % 2 == 0, kinds[0]).otherwise(kinds[1])
    x, y = g.projected([h[i] for i in range(9)], F.col("px"), F.col("py"))
    off = F.when((F.col("camera") % 3 == 1) & (F.col("i") == 3), 1.2).when((F.col("camera") % 3 == 2) & F.col("i").isin(3, 7), (5 - F.col("i")) * 4.5).otherwise(0.0)

    def fit(points: pd.DataFrame) -> pd.DataFrame:
        px, world = points[["px", "py"]].to_numpy(), points[["x", "y"]].to_numpy()
        report = kernels.fit_report(kernels.homography(px, world), px, world)
        return pd.DataFrame({"camera": [points.camera.iloc[0]], "rmse": [round(report["rmse"], 4)], "worst": [round(report["max"], 4)], "grade": [report["grade"]]})

    rows = clicks.select("*", (x + off).alias("x"), y.alias("y")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "camera")  # few bytes, much work: dealt to all tasks
    return rows.groupBy("camera").applyInPandas(fit, "camera long, rmse double, worst double, grade string")


#: Candidate maps of an alignment, two pairs of points each; an inlier is nearer than this, in metres.
CANDIDATES, INLIER = 64, 0.8


def aligned(pairs: DataFrame, candidates: int = CANDIDATES, inlier: float = INLIER) -> DataFrame:
    """part, theta, dx, dy, inliers: the rigid map from (ax, ay) to (bx, by) that most pairs of a part agree with.

    ``pairs`` has part, key (string) and the four coordinates.  Candidates come from a sample, two rows each of the 2 x
    ``candidates`` of least digest of the key, so a bounded number of each part; every row votes on every candidate, and
    the best one, the first of equals, is fitted anew to all rows that agree with it.
    """
    spark = pairs.sparkSession
    rows = pairs.withColumn("digest", F.md5("key"))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("digest"), F.col("key")]
    few = top(rows.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells))), ["part", "cell"], order, 2 * candidates, "i")  # a bounded number from each cell
    few = top(few, ["part"], order, 2 * candidates, "i").withColumn("candidate", F.floor((F.col("i") - 1) / 2))
    ends = few.groupBy("part", "candidate").agg(*[f("i").alias(n) if n == "n" else f(c, "i").alias(n) for n, f, c in [("n", F.count, None), *[(f"{c}{e}", f, c) for c in ("ax", "ay", "bx", "by") for e, f in (("1", F.min_by), ("2", F.max_by))]]]).where("n = 2")
    ux, uy, vx, vy = (F.col(f"{c}2") - F.col(f"{c}1") for c in ("ax", "ay", "bx", "by"))
    theta = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)

    def moved(c: Column, s: Column, x: Column, y: Column) -> tuple[Column, Column]:
        return c * x - s * y, s * x + c * y

    mid = lambda c: (F.col(f"{c}1") + F.col(f"{c}2")) / 2
    maps = ends.select("part", "candidate", F.cos(theta).alias("c"), F.sin(theta).alias("s"), *[mid(c).alias(f"m_{c}") for c in ("ax", "ay", "bx", "by")])
    mx, my = moved(F.col("c"), F.col("s"), F.col("m_ax"), F.col("m_ay"))
    maps = maps.select("part", "candidate", "c", "s", (F.col("m_bx") - mx).alias("dx"), (F.col("m_by") - my).alias("dy"))
    x, y = moved(F.col("c"), F.col("s"), F.col("ax"), F.col("ay"))
    near = F.hypot(x + F.col("dx") - F.col("bx"), y + F.col("dy") - F.col("by")) < inlier
    maps = F.broadcast(maps)  # at most ``candidates`` rows of a part, and parts are few
    votes = pairs.join(maps, "part").where(near).groupBy("part", "candidate").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("part").agg(F.max_by("candidate", F.struct("n", -F.col("candidate"))).alias("candidate"))
    agreeing = pairs.join(maps.join(best, ["part", "candidate"]), "part").where(near)
    mean = {c: F.avg(c).alias(f"m_{c}") for c in ("ax", "ay", "bx", "by")}
    centred = agreeing.join(agreeing.groupBy("part").agg(*mean.values(), F.count(F.lit(1)).alias("inliers")), "part")
    px, py, qx, qy = (F.col(c) - F.col(f"m_{c}") for c in mean)
    sums = centred.groupBy("part", "inliers", *[f"m_{c}" for c in mean]).agg(F.sum(px * qx + py * qy).alias("dot"), F.sum(px * qy - py * qx).alias("cross"))
    sums = sums.withColumn("theta", F.atan2("cross", "dot"))
    mx, my = moved(F.cos("theta"), F.sin("theta"), F.col("m_ax"), F.col("m_ay"))
    return sums.select("part", "theta", (F.col("m_bx") - mx).alias("dx"), (F.col("m_by") - my).alias("dy"), "inliers")


@query(
    _OBS + _TICKS + f""", w AS (SELECT a.track % 4 AS part, a.track || ':' || a.tick AS key, a.x AS p1, a.y AS p2, b.x AS q1, b.y AS q2 FROM k a JOIN k b ON a.track = b.track AND a.tick = b.tick AND a.camera = 'cam1' AND b.camera = 'cam2'),
    f AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5(key), key) - 1 AS i FROM w QUALIFY i < {2 * CANDIDATES}),
    c AS (SELECT p.part, p.i // 2 AS k, (p.p1 + r.p1) / 2 AS mp1, (p.p2 + r.p2) / 2 AS mp2, (p.q1 + r.q1) / 2 AS mq1, (p.q2 + r.q2) / 2 AS mq2,
        atan2((r.p1 - p.p1) * (r.q2 - p.q2) - (r.p2 - p.p2) * (r.q1 - p.q1), (r.p1 - p.p1) * (r.q1 - p.q1) + (r.p2 - p.p2) * (r.q2 - p.q2)) AS theta FROM f p JOIN f r ON r.part = p.part AND r.i = p.i + 1 AND p.i % 2 = 0),
    maps AS (SELECT part, k, cos(theta) AS c, sin(theta) AS s, mq1 - (cos(theta) * mp1 - sin(theta) * mp2) AS dx, mq2 - (sin(theta) * mp1 + cos(theta) * mp2) AS dy FROM c),
    v AS (SELECT part, k, count(*) AS n FROM w JOIN maps USING (part) WHERE sqrt(pow(c * p1 - s * p2 + dx - q1, 2) + pow(s * p1 + c * p2 + dy - q2, 2)) < {INLIER} GROUP BY part, k),
    z AS (SELECT part, k FROM v QUALIFY row_number() OVER (PARTITION BY part ORDER BY n DESC, k) = 1),
    g AS (SELECT w.* FROM w JOIN maps USING (part) JOIN z USING (part, k) WHERE sqrt(pow(c * p1 - s * p2 + dx - q1, 2) + pow(s * p1 + c * p2 + dy - q2, 2)) < {INLIER}),
    u AS (SELECT part, avg(p1) AS mp1, avg(p2) AS mp2, avg(q1) AS mq1, avg(q2) AS mq2, count(*) AS n FROM g GROUP BY part),
    t AS (SELECT part, n, mp1, mp2, mq1, mq2, atan2(sum((p1 - mp1) * (q2 - mq2) - (p2 - mp2) * (q1 - mq1)), sum((p1 - mp1) * (q1 - mq1) + (p2 - mp2) * (q2 - mq2))) AS theta FROM g JOIN u USING (part) GROUP BY ALL)
    SELECT part, floor(theta * 1e6 + 0.5) / 1e6 AS theta, floor((mq1 - (cos(theta) * mp1 - sin(theta) * mp2)) * 1e6 + 0.5) / 1e6 AS dx, floor((mq2 - (sin(theta) * mp1 + cos(theta) * mp2)) * 1e6 + 0.5) / 1e6 AS dy, n AS inliers FROM t"""
)
def camera_alignment(spark, sf_dir):
    """Rigid map between the cameras' floors from positions of the same track and tick, for each quarter of the tracks."""
    both = ticks(_floor(spark, sf_dir)).groupBy("track", "tick").pivot("camera", ["cam1", "cam2"]).agg(F.first("x").alias("x"), F.first("y").alias("y")).dropna()
    key = F.concat_ws(":", F.col("track").cast("string"), F.col("tick").cast("string"))
    names = {"cam1_x": "ax", "cam1_y": "ay", "cam2_x": "bx", "cam2_y": "by"}
    found = aligned(both.select((F.col("track") % 4).alias("part"), key.alias("key"), *[F.col(c).alias(n) for c, n in names.items()]))
    return found.select("part", *[r6(F.col(c)).alias(c) for c in ("theta", "dx", "dy")], "inliers")


def recordings(spark, sf_dir) -> DataFrame:
    """site, tick, key, camera, x, y, sigma, edge: one row of each track and tick."""
    rows = _floor(spark, sf_dir).groupBy("site", "tick", "camera", "track").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("sigma").alias("sigma"), F.bool_and("edge").alias("edge"))
    return rows.select("site", "tick", F.concat_ws(":", "camera", F.col("track").cast("string")).alias("key"), "camera", "x", "y", "sigma", "edge")


@query(
    _OBS + """, r AS (SELECT site, tick, camera || ':' || track AS key, camera, avg(x) AS x, avg(y) AS y, min(sigma) AS sigma, bool_and(edge) AS edge FROM p GROUP BY site, tick, camera, track),
    c AS (SELECT a.site, a.tick, a.key AS a, b.key AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, a.sigma * a.sigma + b.sigma * b.sigma AS v, a.edge OR b.edge AS blind
        FROM r a JOIN r b ON a.site = b.site AND a.tick = b.tick AND a.camera < b.camera),
    n AS (SELECT site, a, b FROM c GROUP BY site, a, b HAVING min(d) <= 2.5),
    e AS (SELECT c.*, CASE WHEN blind THEN least(h, 0) ELSE h END AS llr FROM (
        SELECT *, CASE WHEN d > 2.5 THEN -5 ELSE greatest(-4, least(2.5, -(d * d) / (2 * v) - ln(2 * pi() * v) + ln(pi() * 2.25))) END AS h FROM c JOIN n USING (site, a, b)) c),
    u AS (SELECT *, sum(llr) OVER w * 0.2 AS score, row_number() OVER w AS overlap FROM e WINDOW w AS (PARTITION BY site, a, b ORDER BY tick)),
    q AS (SELECT * FROM u WHERE overlap * 0.2 >= 0.8 - 1e-9),
    x AS (SELECT q.*, (SELECT max(o.score) FROM q o WHERE o.site = q.site AND o.tick = q.tick AND (o.a = q.a) <> (o.b = q.b)) AS rival FROM q)
    SELECT site, tick, a, b, overlap, floor(score * 1e6 + 0.5) / 1e6 AS score, floor((score - greatest(0, coalesce(rival, 0))) * 1e6 + 0.5) / 1e6 AS lead,
        score >= 4 AND score - greatest(0, coalesce(rival, 0)) >= 2 AS sure FROM x"""
)
def link_evidence(spark, sf_dir):
    """Evidence so far of every pair of tracks that ever come near, at each common tick after a short overlap, and its lead over the pairs that compete."""
    rows, s = recordings(spark, sf_dir), Settings()
    found = leads(people.evidence(rows, people.near_pairs(rows, s), people.tracks(rows), s), s)
    return found.select("site", "tick", "a", "b", F.col("n").alias("overlap"), r6(F.col("score")).alias("score"), r6(F.col("lead")).alias("lead"), "sure")


#: Ticks between observations of two hours: an hour of the events stands for five seconds of a recording.
HOUR_TICKS = 25


def _recorded(spark, sf_dir) -> DataFrame:
    return recordings(spark, sf_dir).withColumn("tick", F.col("tick") * HOUR_TICKS)


@query()
def identity_world(spark, sf_dir):
    """People of each tick of a site, as known some seconds later."""
    return people.world(_recorded(spark, sf_dir))


@query()
def identity_events(spark, sf_dir):
    """Audit of a site: links made, revoked and blocked, tracks taken for a person who was lost, unclear ones."""
    _, known, cross, decided = people.resolve(_recorded(spark, sf_dir))
    return people.audit(known, cross, decided)
