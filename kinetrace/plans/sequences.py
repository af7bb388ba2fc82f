"""Windows, islands and resampling over observation sequences.

Events stand in for a one-dimensional track: member = track, value = position, ts in hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.scalars import half_up
from kinetrace.operators.filters import on_regular_grid, polynomial_weights, rolling_mean, rolling_median, smoothed
from kinetrace.operators.intervals import overlaps
from kinetrace.operators.matching import kept_apart
from kinetrace.operators.relational import closed_gaps, runs, sessions
from kinetrace.plans.registry import Registry
from kinetrace.sources.tables import VISITS_SQL, visits

query = Registry()
_WITH = f"WITH {VISITS_SQL}, o AS (SELECT member AS track, visit AS id, t, duration * 60 AS x, sets AS k FROM visits)"


def observations(spark, sf_dir) -> DataFrame:
    """track, id, t, x, k."""
    return visits(spark, sf_dir).select(F.col("member").alias("track"), F.col("visit").alias("id"), "t", (F.col("duration") * 60).alias("x"), F.col("sets").alias("k"))


def in_order() -> Window:
    return Window.partitionBy("track").orderBy("t", "id")


def r6(x):
    return half_up(x, 6)


@query(
    _WITH
    + """ SELECT id, floor(sum(x) OVER w * 1e6 + 0.5) / 1e6 AS running, floor(avg(x) OVER (PARTITION BY track ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 1e6 + 0.5) / 1e6 AS last5,
    floor(coalesce(x - lag(x) OVER w, 0) * 1e6 + 0.5) / 1e6 AS step,
    floor(CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END * 1e6 + 0.5) / 1e6 AS gradient
    FROM o WINDOW w AS (PARTITION BY track ORDER BY t, id)"""
)
def running_evidence(spark, sf_dir):
    """Running sum, mean of the last five, step, and central gradient with one-sided ends."""
    w = in_order()
    before, after = F.lag("x").over(w), F.lead("x").over(w)
    gradient = F.when(before.isNull(), after - F.col("x")).when(after.isNull(), F.col("x") - before).otherwise((after - before) / 2)
    return observations(spark, sf_dir).select(
        "id",
        r6(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("running"),
        r6(F.avg("x").over(w.rowsBetween(-4, 0))).alias("last5"),
        r6(F.coalesce(F.col("x") - before, F.lit(0.0))).alias("step"),
        r6(gradient).alias("gradient"),
    )


@query(
    _WITH
    + """, b AS (SELECT track, id, floor(t / 2)::BIGINT AS tick, x FROM o),
    s AS (SELECT id, count(*) OVER w AS n, max(tick) OVER w - min(tick) OVER w AS span, regr_slope(x, tick) OVER w AS slope, avg(x) OVER c AS smooth,
        first_value(x) OVER v AS first, last_value(x) OVER v AS last FROM b
        WINDOW w AS (PARTITION BY track ORDER BY tick RANGE BETWEEN 20 PRECEDING AND CURRENT ROW), c AS (PARTITION BY track ORDER BY tick RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING),
        v AS (PARTITION BY track ORDER BY tick, id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
    SELECT id, floor(CASE WHEN n >= 3 AND span > 1 THEN slope ELSE 0 END * 1e4 + 0.5033) / 1e4 AS slope, floor(smooth * 1e6 + 0.5) / 1e6 AS smooth, abs(last - first) > 100 AS moving FROM s"""
)
def trailing_slope(spark, sf_dir):
    """Least-squares slope of the trailing ticks (three points and a span, else 0), centred mean by ticks, and net displacement."""
    b = observations(spark, sf_dir).select("track", "id", F.floor(F.col("t") / 2).alias("tick"), "x")
    by_tick = Window.partitionBy("track").orderBy("tick")
    w, c, v = by_tick.rangeBetween(-20, 0), by_tick.rangeBetween(-10, 10), Window.partitionBy("track").orderBy("tick", "id").rowsBetween(-7, 7)
    enough = (F.count(F.lit(1)).over(w) >= 3) & (F.max("tick").over(w) - F.min("tick").over(w) > 1)
    slope = F.when(enough, F.regr_slope("x", "tick").over(w)).otherwise(0.0)
    moving = F.abs(F.last("x").over(v) - F.first("x").over(v)) > 100
    return b.select("id", (F.floor(slope * 1e4 + 0.5033) / 1e4).alias("slope"), r6(F.avg("x").over(c)).alias("smooth"), moving.alias("moving"))


_SESSION = """, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY track ORDER BY t, id) > 12 THEN 1 ELSE 0 END AS new FROM o),
    s AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY t, id)::BIGINT AS session FROM g)"""


@query(_WITH + _SESSION + " SELECT track, session, count(*) AS n, floor((max(t) - min(t)) * 1e6 + 0.5) / 1e6 AS hours FROM s GROUP BY track, session")
def session_gaps(spark, sf_dir):
    """Sessions end where a gap exceeds twelve hours."""
    s = sessions(observations(spark, sf_dir), ["track"], "t", 12.0, order=["id"])
    return s.groupBy("track", "session").agg(F.count(F.lit(1)).alias("n"), r6(F.max("t") - F.min("t")).alias("hours"))


@query(
    _WITH
    + """, d AS (SELECT *, coalesce((abs(x - lag(x) OVER w) > 300)::INT, 0) AS cut FROM o WINDOW w AS (PARTITION BY track ORDER BY t, id)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY track ORDER BY t, id)::BIGINT AS segment FROM d)
    SELECT track, segment, count(*) AS n FROM s GROUP BY track, segment HAVING count(*) >= 2"""
)
def jump_split(spark, sf_dir):
    """A jump starts a new segment; segments of one row are dropped."""
    d = observations(spark, sf_dir).withColumn("cut", F.coalesce((F.abs(F.col("x") - F.lag("x").over(in_order())) > 300).cast("int"), F.lit(0)))
    s = d.withColumn("segment", F.sum("cut").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("track", "segment").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


_RUNS = """, i AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY id) AS i FROM o), f AS (SELECT *, i - row_number() OVER (PARTITION BY track ORDER BY id) AS g FROM i WHERE x < 250),
    r AS (SELECT track, min(i) AS "begin", max(i) AS "end", count(*) AS n FROM f GROUP BY track, g)"""


def _numbered(spark, sf_dir) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.withColumn("i", F.row_number().over(Window.partitionBy("track").orderBy("id"))).withColumn("low", F.col("x") < 250)


@query(_WITH + _RUNS + ' SELECT track, "begin", "end", n FROM r')
def true_runs(spark, sf_dir):
    return runs(_numbered(spark, sf_dir), ["track"], "i", "low")


@query(
    _WITH
    + _RUNS
    + """, m AS (SELECT *, coalesce(("begin" - lag("end") OVER (PARTITION BY track ORDER BY "begin") > 2)::INT, 0) AS new FROM r), k AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY "begin") AS g FROM m)
    SELECT track, min("begin") AS "begin", max("end") AS "end" FROM k GROUP BY track, g"""
)
def closed_runs(spark, sf_dir):
    """Runs with gaps of one row closed."""
    return closed_gaps(runs(_numbered(spark, sf_dir), ["track"], "i", "low"), ["track"], 2)


@query(
    _WITH
    + """, g AS (SELECT track, id, t, t - lag(t) OVER (PARTITION BY track ORDER BY t, id) AS gap FROM o), m AS (SELECT track, median(gap) AS mid FROM g WHERE gap IS NOT NULL GROUP BY track),
    e AS (SELECT g.track, t, id, abs(gap - mid) <= 0.35 * mid AS even FROM g JOIN m USING (track)),
    n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, id) AS i FROM e), r AS (SELECT *, i - row_number() OVER (PARTITION BY track ORDER BY t, id) AS k FROM n WHERE even),
    l AS (SELECT track, min(i) - 1 AS first, count(*) + 1 AS n FROM r GROUP BY track, k)
    SELECT track, arg_max(first, n * 100000 - first) AS first, max(n) AS n FROM l GROUP BY track"""
)
def longest_even_run(spark, sf_dir):
    """Longest run whose gaps stay within 35 % of the median gap; the earliest of equals."""
    g = observations(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(in_order())).withColumn("i", F.row_number().over(in_order()))
    mid = F.median("gap").over(Window.partitionBy("track"))
    even = g.withColumn("mid", mid).withColumn("even", F.coalesce(F.abs(F.col("gap") - F.col("mid")) <= 0.35 * F.col("mid"), F.lit(False)))
    found = runs(even, ["track"], "i", "even").select("track", (F.col("begin") - 1).alias("first"), (F.col("n") + 1).alias("n"))
    best = found.groupBy("track").agg(F.max(F.struct("n", (-F.col("first")).alias("f"))).alias("b"))
    return best.select("track", (-F.col("b.f")).alias("first"), F.col("b.n").alias("n"))


@query(
    _WITH
    + """, p AS (SELECT track, id, t, x, lead(t) OVER w AS t2, lead(x) OVER w AS x2 FROM o WINDOW w AS (PARTITION BY track ORDER BY t, id))
    SELECT id, floor((x + CASE WHEN t2 > t THEN (x2 - x) * least(1, (0.25 * (t2 - t)) / (t2 - t)) ELSE 0 END) * 1e6 + 0.5) / 1e6 AS eased FROM p WHERE t2 IS NOT NULL"""
)
def stepwise_lerp(spark, sf_dir):
    """Position a quarter of the way to the next observation."""
    w = in_order()
    p = observations(spark, sf_dir).withColumn("t2", F.lead("t").over(w)).withColumn("x2", F.lead("x").over(w)).where("t2 is not null")
    share = F.try_divide(0.25 * (F.col("t2") - F.col("t")), F.col("t2") - F.col("t"))
    return p.select("id", r6(F.col("x") + F.when(F.col("t2") > F.col("t"), (F.col("x2") - F.col("x")) * F.least(F.lit(1.0), share)).otherwise(0.0)).alias("eased"))


@query(
    _WITH
    + """ SELECT track, round_even(t / 4, 0)::BIGINT AS tick, count(*) AS n, floor(median(x) * 1e6 + 0.5) / 1e6 AS x, floor(avg(k) * 1e6 + 0.5) / 1e6 AS conf, bool_and(x < 400) AS low FROM o GROUP BY ALL"""
)
def per_tick_median(spark, sf_dir):
    """Median and mean by track and tick; ticks are rounded half to even."""
    tick = F.bround(F.col("t") / 4).cast("long")
    return observations(spark, sf_dir).groupBy("track", tick.alias("tick")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.median("x")).alias("x"), r6(F.avg("k")).alias("conf"), F.bool_and(F.col("x") < 400).alias("low")
    )


@query(
    _WITH
    + """, b AS (SELECT floor(t)::BIGINT AS bin, track, id, x, row_number() OVER (PARTITION BY floor(t) ORDER BY id) AS r FROM o)
    SELECT bin, count(*) AS n, floor(avg(x) * 1e6 + 0.5) / 1e6 AS x FROM b WHERE r <= 5 GROUP BY bin"""
)
def capped_bins(spark, sf_dir):
    """Hourly bins of the first five observations in order of arrival."""
    b = observations(spark, sf_dir).withColumn("bin", F.floor("t"))
    first = b.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy("id"))).where("r <= 5")
    return first.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("x"))


@query(
    _WITH
    + """, a AS (SELECT track, id, t, t + x / 60 AS e FROM o WHERE track % 2 = 0), b AS (SELECT track, id, t, t + x / 60 AS e FROM o WHERE track % 2 = 1)
    SELECT a.id AS l_id, b.id AS r_id, floor((least(a.e, b.e) - greatest(a.t, b.t)) * 1e6 + 0.5) / 1e6 AS overlap FROM a JOIN b ON a.t < b.e AND b.t < a.e"""
)
def temporal_overlap_pairs(spark, sf_dir):
    """Intervals of two groups that overlap, found in sorted arrays of a cell; the table is all of them, so it grows as the square of the rows."""
    o = observations(spark, sf_dir)
    return overlaps(o.where("track % 2 in (0, 1)").select((F.col("track") % 2).alias("side"), "id", "t", "x"), 4.0, 60.0)


@query(
    _WITH
    + """, q AS (SELECT track, count(*) AS n, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95, stddev_pop(x) / avg(x) AS cv, abs(corr(x, k)) AS sync FROM o GROUP BY track)
    SELECT track, floor(p50 * 1e6 + 0.5) / 1e6 AS p50, floor(p90 * 1e6 + 0.5) / 1e6 AS p90, floor(CASE WHEN n > 5 THEN p95 - p5 ELSE 0 END * 1e6 + 0.5) / 1e6 AS range, floor(cv * 1e6 + 0.5) / 1e6 AS cv, floor(sync * 1e6 + 0.5) / 1e6 AS sync FROM q"""
)
def track_statistics(spark, sf_dir):
    """Exact percentiles, robust range, variation and correlation of each track."""
    q = observations(spark, sf_dir).groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("x", F.array(*map(F.lit, (0.05, 0.5, 0.9, 0.95)))).alias("p"),
        (F.stddev_pop("x") / F.avg("x")).alias("cv"), F.abs(F.corr("x", F.col("k").cast("double"))).alias("sync"),
    )
    p = F.col("p")
    return q.select("track", r6(p[1]).alias("p50"), r6(p[2]).alias("p90"), r6(F.when(F.col("n") > 5, p[3] - p[0]).otherwise(0.0)).alias("range"), r6(F.col("cv")).alias("cv"), r6(F.col("sync")).alias("sync"))


@query(
    _WITH
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM o)
    SELECT track, id FROM n WHERE i IN (SELECT floor(j * (n - 1) / 4.0 + 1e-9)::BIGINT FROM (SELECT unnest(range(5)) AS j))"""
)
def even_sample(spark, sf_dir):
    """Five evenly spaced rows of each track, first and last among them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track"))
    rows = observations(spark, sf_dir).withColumn("i", F.row_number().over(in_order()) - 1).withColumn("n", n)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.floor(j * (F.col("n") - 1) / 4.0 + 1e-9))
    return rows.where(F.array_contains(wanted, F.col("i").cast("long"))).select("track", "id")


@query(
    _WITH + " SELECT id, (SELECT string_agg(p.id::VARCHAR, ',' ORDER BY p.t, p.id) FROM o p WHERE p.track = o.track AND p.t >= o.t - 24 AND p.t <= o.t AND p.k <> 3) AS trail FROM o"
)
def trails(spark, sf_dir):
    """Recent positions of each observation's track within a day, hidden ones skipped."""
    o = observations(spark, sf_dir)
    w = Window.partitionBy("track").orderBy(F.floor(F.col("t") * 3.6e6)).rangeBetween(-24 * 3_600_000, 0)  # milliseconds
    seen = F.collect_list(F.when(F.col("k") != 3, F.struct("t", "id"))).over(w)
    return o.select("id", F.nullif(F.array_join(F.transform(F.array_sort(seen), lambda x: x["id"].cast("string")), ","), F.lit("")).alias("trail"))


@query(
    """WITH m AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, count(*) AS ticks, count(*) FILTER (role <> before) AS switches, count(DISTINCT role) AS identities FROM m GROUP BY conv_id"""
)
def idswitch_count(spark, sf_dir):
    """Changes of identity between consecutive observations."""
    from kinetrace.sources.tables import load

    c = load(spark, sf_dir, "conversations")
    m = c.withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("ticks"), F.count_if(F.col("role") != F.col("before")).alias("switches"), F.countDistinct("role").alias("identities"))


@query(
    _WITH.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT track, id, t, row_number() OVER (PARTITION BY track ORDER BY t, id) AS i FROM o),
    k AS (
        SELECT track, i, t FROM n WHERE i = 1
        UNION ALL SELECT k.track, (SELECT min(n.i) FROM n WHERE n.track = k.track AND n.t >= k.t + 6 - 1e-9) AS i, (SELECT min(n.t) FROM n WHERE n.track = k.track AND n.t >= k.t + 6 - 1e-9) AS t FROM k WHERE k.t IS NOT NULL)
    SELECT n.track, n.id FROM n JOIN k ON n.track = k.track AND n.i = k.i"""
)
def thinned(spark, sf_dir):
    """Rows at least six hours after the last kept one."""
    return kept_apart(observations(spark, sf_dir).select("track", "id", "t"), ["track"], "t", 6.0, ["id"]).select("track", "id")


_WEIGHTS = {s: polynomial_weights(s, 2) for s in (3, 5, 7)}
_FILTERS = """, g AS (SELECT track, t, x, lead(t) OVER w AS t2, lead(x) OVER w AS x2, min(t) OVER (PARTITION BY track) AS t0 FROM o WINDOW w AS (PARTITION BY track ORDER BY t, id)),
    p AS (SELECT *, unnest(range(ceil((t - t0) / 3 - 1e-9)::BIGINT, CASE WHEN t2 IS NULL THEN floor((t - t0) / 3 + 1e-9)::BIGINT + 1 ELSE ceil((t2 - t0) / 3 - 1e-9)::BIGINT END)) AS i FROM g),
    y AS (SELECT track, i, CASE WHEN t0 + i * 3 - t <= 1e-9 THEN x WHEN t2 - t <= 12 THEN x + (x2 - x) / (t2 - t) * (t0 + i * 3 - t) END AS y FROM p),
    f AS (SELECT *, count(*) OVER (PARTITION BY track) AS n, max(CASE WHEN y IS NOT NULL THEN i END) OVER b AS i1, min(CASE WHEN y IS NOT NULL THEN i END) OVER a AS i2 FROM y
        WINDOW b AS (PARTITION BY track ORDER BY i), a AS (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    z AS (SELECT f.track, f.i, f.n, CASE WHEN f.y IS NOT NULL THEN f.y WHEN f.i1 IS NULL THEN c.y WHEN f.i2 IS NULL THEN b.y ELSE b.y + (c.y - b.y) * ((f.i - f.i1) / (f.i2 - f.i1)::DOUBLE) END AS y
        FROM f LEFT JOIN y b ON b.track = f.track AND b.i = f.i1 LEFT JOIN y c ON c.track = f.track AND c.i = f.i2),
    l AS (SELECT track, any_value(n) AS n, list(y ORDER BY i) AS ys FROM z GROUP BY track),
    s AS (SELECT track, n, i, ys[i + 1] AS x, CASE WHEN n < 3 THEN NULL WHEN n < 5 THEN 3 WHEN n < 7 THEN 5 ELSE 7 END AS size, ys FROM l, unnest(range(n)) u(i)),
    q AS (SELECT *, greatest(0, least(i - size // 2, n - size)) AS start FROM s),
    m AS (SELECT track, n, i, x, CASE WHEN size IS NULL THEN x ELSE list_sum(list_transform(range(size), lambda j: (CASE size WHEN 3 THEN %s WHEN 5 THEN %s ELSE %s END)[i - start + 1][j + 1] * ys[start + j + 1])) END AS smooth FROM q)""" % tuple(_WEIGHTS[s] for s in (3, 5, 7))


@query(
    _WITH + _FILTERS + """, v AS (SELECT track, list(smooth ORDER BY i) AS ss FROM m GROUP BY track)
    SELECT track, i, floor(x * 1e6 + 0.5) / 1e6 AS x, floor(smooth * 1e6 + 0.5) / 1e6 AS smooth,
        floor((smooth - list_sort(list_transform(range(21), lambda j: ss[1 + greatest(0, least(n - 1, i + j - 10))]))[11]) * 1e6 + 0.5) / 1e6 AS flat,
        floor(list_sum(list_transform(range(8), lambda j: ss[1 + greatest(0, least(n - 1, i + j - 4))])) / 8 * 1e6 + 0.5) / 1e6 AS mean FROM m JOIN v USING (track)"""
)
def resampled(spark, sf_dir):
    """Each track on a three-hour grid: interpolated within gaps of twelve hours, smoothed, its slow part removed, and its moving mean."""
    grid = on_regular_grid(observations(spark, sf_dir), ["track"], "t", "x", 3.0, 12.0, ["id"])
    rows = smoothed(grid, ["track"], "y", "smooth", 7)
    rows = rolling_mean(rolling_median(rows, ["track"], "smooth", "slow", 21), ["track"], "smooth", "mean", 8)
    return rows.select("track", "i", r6(F.col("y")).alias("x"), r6(F.col("smooth")).alias("smooth"), r6(F.col("smooth") - F.col("slow")).alias("flat"), r6(F.col("mean")).alias("mean"))
