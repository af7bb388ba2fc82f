"""Operator metrics over visits: occupancy, demand, engagement, retention, members at risk, insights.

The clock is a day index and an hour of day; NOW is fixed by the parameters below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.scalars import dollars, half_up, hour_label, idle_label, joined, percent_change, ramp, weekday
from kinetrace.operators.relational import filled, hours_covered, nearest, numbers, top
from kinetrace.plans.registry import Registry
from kinetrace.sources.tables import MEMBERS_SQL, VISITS_SQL, load, members, visits

NOW_DAY, NOW_HOUR = 29, 10.75
NOW = NOW_DAY * 24 + NOW_HOUR
OPEN, CLOSE, WEEKS = 5, 23, 4
WEEK_HOURS = 168
PAST = (NOW_DAY - 7 * WEEKS, NOW_DAY - 1)
#: Zones: places and units (machines) for each.
UNITS = {"click": 14, "error": 6, "purchase": 10, "signup": 8, "view": 20}
#: Price tiers: least members, monthly price; one-off dues of a member.
TIERS, DUES = ((0, 99), (51, 149), (101, 249)), 40
OCCUPANCY_KNOTS = [(0.0, 90.0), (0.5, 200.0), (0.85, 250.0), (1.0, 255.0)]
query = Registry()
_WITH = f"WITH {VISITS_SQL}"


def in_window(t0: float, t1: float, t: str = "t") -> Column:
    """[t0, t1)."""
    return (F.col(t) >= t0) & (F.col(t) < t1)


def slots(visits: DataFrame, keys: list[str]) -> DataFrame:
    """Visitors by keys, weekday and open hour, averaged over the last WEEKS weeks of whole days."""
    recent = visits.where(F.col("day").between(NOW_DAY - 7 * WEEKS, NOW_DAY - 1))
    hours = hours_covered(recent.withColumn("end", F.col("start") + F.col("duration")), "start", "end")
    inside = hours.where(F.col("hour").between(OPEN, CLOSE - 1)).withColumn("weekday", weekday(F.col("day")))
    return inside.groupBy(*keys, "weekday", F.col("hour").cast("int").alias("hour")).agg((F.sum("overlap") / WEEKS).alias("people"))


_SLOTS = f"""
    {VISITS_SQL},
    covered AS (
        SELECT zone, day % 7 AS weekday, h.hour::INT AS hour, least(start + duration, h.hour + 1) - greatest(start, h.hour) AS overlap
        FROM visits, (SELECT unnest(range({OPEN}, {CLOSE})) AS hour) h
        WHERE day BETWEEN {NOW_DAY - 7 * WEEKS} AND {NOW_DAY - 1} AND start < h.hour + 1 AND start + duration > h.hour)"""


def _grid(spark) -> DataFrame:
    return numbers(spark, 7, "weekday").crossJoin(F.broadcast(numbers(spark, CLOSE - OPEN, "hour").select((F.col("hour") + OPEN).alias("hour"))))  # 7 x 18 cells


@query(
    f"""WITH {_SLOTS}
    SELECT w.weekday::INT AS weekday, h.hour::INT AS hour, floor(coalesce(sum(overlap), 0) / {WEEKS} + 0.5)::BIGINT AS people
    FROM (SELECT unnest(range(7)) AS weekday) w CROSS JOIN (SELECT unnest(range({OPEN}, {CLOSE})) AS hour) h
    LEFT JOIN covered c ON c.weekday = w.weekday AND c.hour = h.hour GROUP BY ALL"""
)
def peak_hours(spark, sf_dir):
    """Hour-of-week occupancy, zero-filled."""
    found = filled(_grid(spark), slots(visits(spark, sf_dir, PAST), []), ["weekday", "hour"], ["people"])
    return found.select("weekday", "hour", half_up(F.col("people")).alias("people"))


@query(
    f"""{_WITH}
    SELECT count(*) FILTER (t <= {NOW} AND {NOW} < t + duration AND day = {NOW_DAY}) AS in_gym_now,
        count(*) FILTER (t >= {NOW - 168} AND t < {NOW}) AS visits, count(*) FILTER (t >= {NOW - 336} AND t < {NOW - 168}) AS visits_before,
        count(DISTINCT CASE WHEN t >= {NOW - 168} AND t < {NOW} THEN member END) AS active,
        coalesce(sum(sets) FILTER (t >= {NOW - 168} AND t < {NOW}), 0)::BIGINT AS sets,
        coalesce(sum(sets) FILTER (t >= {NOW - 336} AND t < {NOW - 168}), 0)::BIGINT AS sets_before,
        coalesce(floor(100.0 * (count(*) FILTER (t >= {NOW - 168} AND t < {NOW}) - count(*) FILTER (t >= {NOW - 336} AND t < {NOW - 168}))
            / nullif(count(*) FILTER (t >= {NOW - 336} AND t < {NOW - 168}), 0) + 0.5)::BIGINT, 0) AS change
    FROM visits"""
)
def kpis_now_vs_previous(spark, sf_dir):
    """Counts of this week and the week before, in one pass."""
    now, before = in_window(NOW - WEEK_HOURS, NOW), in_window(NOW - 2 * WEEK_HOURS, NOW - WEEK_HOURS)
    inside = (F.col("t") <= NOW) & (F.lit(NOW) < F.col("t") + F.col("duration")) & (F.col("day") == NOW_DAY)
    found = visits(spark, sf_dir, (NOW_DAY - 14, NOW_DAY)).agg(
        F.count_if(inside).alias("in_gym_now"),
        F.count_if(now).alias("visits"),
        F.count_if(before).alias("visits_before"),
        F.countDistinct(F.when(now, F.col("member"))).alias("active"),
        F.coalesce(F.sum(F.when(now, F.col("sets"))), F.lit(0)).alias("sets"),
        F.coalesce(F.sum(F.when(before, F.col("sets"))), F.lit(0)).alias("sets_before"),
    )
    return found.withColumn("change", percent_change(F.col("visits"), F.col("visits_before")))


@query(f"{_WITH} SELECT h.hour::INT AS hour, count(v.visit) AS people FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN visits v ON v.day = 14 AND v.start <= h.hour AND h.hour < v.start + v.duration GROUP BY h.hour")
def occupancy_at_instant(spark, sf_dir):
    """People inside at each full hour of one day: start <= hour < end."""
    day = visits(spark, sf_dir, (14, 14))
    touched = F.sequence(F.ceil("start").cast("int"), F.ceil(F.col("start") + F.col("duration")).cast("int") - 1)
    full = F.ceil("start") <= F.ceil(F.col("start") + F.col("duration")) - 1
    hours = day.where(full).withColumn("hour", F.explode(touched)).where("hour < 24").groupBy("hour").agg(F.count(F.lit(1)).alias("people"))
    return filled(numbers(spark, 24, "hour"), hours, ["hour"], ["people"])


@query(
    f"""{_WITH}, {MEMBERS_SQL}, e AS (SELECT member FROM members WHERE join_day <= {NOW_DAY - 14})
    SELECT (SELECT count(*) FROM visits WHERE member IN (SELECT member FROM e) AND t >= {NOW - 336} AND t < {NOW}) AS visits,
        (SELECT count(*) FROM e) AS members,
        floor(1e6 * (SELECT count(*) FROM visits WHERE member IN (SELECT member FROM e) AND t >= {NOW - 336} AND t < {NOW}) / (SELECT count(*) FROM e) + 0.5) / 1e6 AS per_member"""
)
def visits_per_established_member(spark, sf_dir):
    """Visits by members who had joined before the window, for each of them."""
    old = members(spark, sf_dir).where(F.col("join_day") <= NOW_DAY - 14).select("member")
    made = visits(spark, sf_dir, (NOW_DAY - 14, NOW_DAY)).where(in_window(NOW - 336, NOW)).join(old, "member", "left_semi").agg(F.count(F.lit(1)).alias("visits"))
    both = made.crossJoin(F.broadcast(old.agg(F.count(F.lit(1)).alias("members"))))  # one row each
    return both.withColumn("per_member", half_up(F.try_divide(F.col("visits"), F.col("members")), 6))


@query(
    f"""{_WITH}, w AS (SELECT ceil(({NOW} - t) / 168)::INT - 1 AS weeks_ago FROM visits WHERE t < {NOW} AND t >= {NOW - 12 * 168})
    SELECT g.w::INT AS weeks_ago, count(w.weeks_ago) AS visits FROM (SELECT unnest(range(12)) AS w) g LEFT JOIN w ON w.weeks_ago = g.w GROUP BY g.w"""
)
def weekly_visits(spark, sf_dir):
    """Twelve trailing weeks that end at NOW, start inclusive; empty ones are 0."""
    recent = visits(spark, sf_dir, (NOW_DAY - 84, NOW_DAY)).where(in_window(NOW - 12 * WEEK_HOURS, NOW))
    weeks = recent.groupBy((F.ceil((NOW - F.col("t")) / WEEK_HOURS).cast("int") - 1).alias("weeks_ago")).agg(F.count(F.lit(1)).alias("visits"))
    return filled(numbers(spark, 12, "weeks_ago"), weeks, ["weeks_ago"], ["visits"])


def _units(spark) -> DataFrame:
    return spark.createDataFrame(list(UNITS.items()), "zone string, units int")


_UNITS_SQL = "units AS (SELECT * FROM (VALUES " + ", ".join(f"('{z}', {n})" for z, n in UNITS.items()) + ") u(zone, units))"
_DEMAND_SQL = f"""{_SLOTS}, {_UNITS_SQL},
    demand AS (SELECT u.zone, c.weekday::INT AS weekday, c.hour, sum(c.overlap) / {WEEKS} AS demand, least(1, sum(c.overlap) / {WEEKS} / u.units) AS occupancy
        FROM covered c JOIN units u ON c.zone = u.zone GROUP BY u.zone, u.units, c.weekday, c.hour)"""


def _demand(spark, sf_dir) -> DataFrame:
    people = slots(visits(spark, sf_dir, PAST), ["zone"]).join(F.broadcast(_units(spark)), "zone")  # a row for each zone
    return people.select("zone", "weekday", "hour", "units", F.col("people").alias("demand"), F.least(F.lit(1.0), F.col("people") / F.col("units")).alias("occupancy"))


@query(f"WITH {_DEMAND_SQL} SELECT zone, weekday, hour, floor(demand * 1e6 + 0.5) / 1e6 AS demand, floor(occupancy * 1e6 + 0.5) / 1e6 AS occupancy FROM demand")
def zone_demand_cube(spark, sf_dir):
    """Demand and capped occupancy by zone, weekday and hour."""
    return _demand(spark, sf_dir).select("zone", "weekday", "hour", half_up(F.col("demand"), 6).alias("demand"), half_up(F.col("occupancy"), 6).alias("occupancy"))


@query(
    f"""WITH {_DEMAND_SQL} SELECT zone, weekday, floor(sum(occupancy) / {CLOSE - OPEN} / CASE WHEN grouping(weekday) = 1 THEN 7 ELSE 1 END * 1e6 + 0.5) / 1e6 AS occupancy
    FROM demand GROUP BY GROUPING SETS ((zone, weekday), (zone))"""
)
def zone_average_by_day_and_week(spark, sf_dir):
    """Mean occupancy of the open hours, by weekday and over the week (weekday null), in one aggregation."""
    cube = _demand(spark, sf_dir).groupingSets([[F.col("zone"), F.col("weekday")], [F.col("zone")]], "zone", "weekday")
    hours = F.when(F.grouping("weekday") == 1, 7).otherwise(1)
    return cube.agg(half_up(F.sum("occupancy") / (CLOSE - OPEN) / hours, 6).alias("occupancy"))


@query(
    f"""WITH {_DEMAND_SQL} SELECT zone, weekday, hour, rank::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY zone ORDER BY floor(occupancy * 1e9 + 0.5) DESC, floor(demand * 1e9 + 0.5) DESC, weekday, hour) AS rank FROM demand) WHERE rank <= 3"""
)
def top_slots_per_zone(spark, sf_dir):
    order = [half_up(F.col("occupancy"), 9).desc(), half_up(F.col("demand"), 9).desc(), F.col("weekday"), F.col("hour")]
    return top(_demand(spark, sf_dir), ["zone"], order, 3).select("zone", "weekday", "hour", "rank")


@query(
    f"""WITH {_DEMAND_SQL}, p AS (SELECT zone, avg(occupancy) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY occupancy DESC) AS r FROM demand) WHERE r <= 10 GROUP BY zone),
    x AS (SELECT u.zone, g.unit::INT AS unit, 1.0 / (1 + g.unit) AS popularity FROM units u, (SELECT unnest(range(20)) AS unit) g WHERE g.unit < u.units)
    SELECT zone, unit, floor(least(1, popularity / mean * peak) * 1e6 + 0.5) / 1e6 AS usage, least(1, popularity / mean * peak) < 0.25 AS idle
    FROM (SELECT x.*, avg(popularity) OVER (PARTITION BY zone) AS mean FROM x) JOIN p USING (zone)"""
)
def unit_usage_and_idle_units(spark, sf_dir):
    """Peak occupancy (mean of the ten best slots) split over a zone's units by popularity; idle below a quarter."""
    best = top(_demand(spark, sf_dir), ["zone"], [F.col("occupancy").desc(), F.col("weekday"), F.col("hour")], 10)
    peak = best.groupBy("zone").agg(F.avg("occupancy").alias("peak"))
    units = _units(spark).withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).withColumn("popularity", 1.0 / (1 + F.col("unit")))
    share = F.col("popularity") / F.avg("popularity").over(Window.partitionBy("zone"))
    used = units.withColumn("share", share).join(peak, "zone").withColumn("u", F.least(F.lit(1.0), F.col("share") * F.col("peak")))
    return used.select("zone", "unit", half_up(F.col("u"), 6).alias("usage"), (F.col("u") < 0.25).alias("idle"))


_RATE = f"""rates AS (SELECT m.member, count(v.visit) FILTER (v.t >= {NOW - 4 * 168} AND v.t < {NOW}) / 4.0 AS rate FROM members m LEFT JOIN visits v USING (member) GROUP BY m.member),
    b AS (SELECT *, CASE WHEN rate = 0 THEN 0 WHEN rate < 1 THEN 1 WHEN rate < 2 THEN 2 WHEN rate < 3 THEN 3 WHEN rate < 4 THEN 4 ELSE 5 END AS bucket FROM rates)"""


def _buckets(spark, sf_dir) -> DataFrame:
    made = visits(spark, sf_dir, (NOW_DAY - 28, NOW_DAY)).where(in_window(NOW - 4 * WEEK_HOURS, NOW)).groupBy("member").agg((F.count(F.lit(1)) / 4.0).alias("rate"))
    rate = F.coalesce("rate", F.lit(0.0))
    ladder = F.when(rate == 0, 0).when(rate < 1, 1).when(rate < 2, 2).when(rate < 3, 3).when(rate < 4, 4).otherwise(5)
    return members(spark, sf_dir).join(made, "member", "left").withColumn("bucket", ladder)


@query(f"{_WITH}, {MEMBERS_SQL}, {_RATE} SELECT g.b::INT AS bucket, count(b.member) AS members FROM (SELECT unnest(range(6)) AS b) g LEFT JOIN b ON b.bucket = g.b GROUP BY g.b")
def sessions_per_week_histogram(spark, sf_dir):
    """Members by weekly rate: 0, below 1, 2, 3, 4, and more; members without visits count."""
    counts = _buckets(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    return filled(numbers(spark, 6, "bucket"), counts, ["bucket"], ["members"])


@query(f"{_WITH}, {MEMBERS_SQL}, {_RATE} SELECT count(*) AS members, count(*) FILTER (bucket >= 3) AS engaged, floor(100.0 * count(*) FILTER (bucket >= 3) / count(*) + 0.5)::BIGINT AS percent FROM b")
def engagement_share(spark, sf_dir):
    found = _buckets(spark, sf_dir).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("bucket") >= 3).alias("engaged"))
    return found.withColumn("percent", half_up(F.try_divide(100.0 * F.col("engaged"), F.col("members"))))


@query(
    f"""{_WITH}, {MEMBERS_SQL}, w AS (SELECT unnest(range(13))::INT AS week),
    c AS (SELECT week, member, EXISTS (SELECT 1 FROM visits v WHERE v.member = m.member AND v.day >= join_day + 7 * week AND v.day < join_day + 7 * week + 14) AS back
        FROM w, members m WHERE join_day >= 0 AND join_day + (week + 2) * 7 <= {NOW_DAY})
    SELECT w.week, count(c.member) AS cohort, count(*) FILTER (c.back) AS retained, floor(100.0 * count(*) FILTER (c.back) / nullif(count(c.member), 0) + 0.5)::BIGINT AS percent
    FROM w LEFT JOIN c USING (week) GROUP BY w.week"""
)
def retention_curve(spark, sf_dir):
    """For each week after joining, the share of the members old enough who came in the following two weeks; no cohort gives null."""
    joined_ = members(spark, sf_dir).where("join_day >= 0")
    weeks = joined_.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(12)))).where(F.col("join_day") + (F.col("week") + 2) * 7 <= NOW_DAY)
    # a visit counts for the week it falls in and the one before: an equi-join instead of a range
    made = visits(spark, sf_dir).join(joined_, "member").select("member", F.floor((F.col("day") - F.col("join_day")) / 7).cast("int").alias("w"))
    seen = made.select("member", F.explode(F.array(F.col("w"), F.col("w") - 1)).alias("week")).distinct().withColumn("back", F.lit(1))
    counts = weeks.join(seen, ["member", "week"], "left").groupBy("week").agg(F.count(F.lit(1)).alias("cohort"), F.count("back").alias("retained"))
    out = filled(numbers(spark, 13, "week"), counts, ["week"], ["cohort", "retained"])
    return out.withColumn("percent", half_up(F.try_divide(100.0 * F.col("retained"), F.col("cohort"))))


_RISK_SQL = f"""
    kept AS (SELECT * FROM visits WHERE (member % 10 <> 0 OR day < 26) AND (member % 10 <> 1 OR day < 12 OR visit % 4 = 0)),
    wk AS (SELECT member, ceil(({NOW} - t) / 168)::INT - 1 AS w FROM kept WHERE t < {NOW} AND t >= {NOW - 8 * 168}),
    last AS (SELECT member, max(day) AS last_day FROM kept WHERE t < {NOW} GROUP BY member),
    r AS (
        SELECT m.member, {NOW_DAY} - last_day AS days_idle, (SELECT count(*) FROM wk WHERE wk.member = m.member AND w BETWEEN 3 AND 7) / 5.0 AS usual,
            (SELECT count(*) FROM wk WHERE wk.member = m.member AND w BETWEEN 0 AND 2) / 3.0 AS recent
        FROM members m JOIN last USING (member) WHERE join_day <= {NOW_DAY - 28}),
    risk AS (SELECT *, CASE WHEN days_idle >= 2 THEN 'inactive' WHEN usual >= 2 AND recent <= usual * 0.5 THEN 'declining' END AS reason FROM r)"""


def at_risk(visits: DataFrame, members: DataFrame, idle_days: int = 14) -> DataFrame:
    """Members who stay away or come at most half as often: usual and recent weekly rates from eight trailing weeks."""
    past = visits.where(F.col("t") < NOW)
    counted = past.withColumn("w", F.ceil((NOW - F.col("t")) / WEEK_HOURS).cast("int") - 1)
    rates = counted.groupBy("member").agg(
        F.max("day").alias("last_day"),
        *[F.count_if(F.col("w") == w).alias(f"w{w}") for w in range(8)],
    )
    weekly = F.array(*[F.col(f"w{w}") for w in range(7, -1, -1)])  # oldest first
    mean = lambda a, b: F.aggregate(F.slice("weekly", a, b), F.lit(0).cast("long"), lambda s, x: s + x) / float(b)
    found = rates.join(members, "member").where(F.col("join_day") <= NOW_DAY - 28).withColumn("weekly", weekly)
    found = found.select("member", "join_day", "weekly", (F.lit(NOW_DAY) - F.col("last_day")).alias("days_idle"), mean(1, 5).alias("usual"), mean(6, 3).alias("recent"))
    reason = F.when(F.col("days_idle") >= idle_days, "inactive").when((F.col("usual") >= 2) & (F.col("recent") <= F.col("usual") * 0.5), "declining")
    return found.withColumn("reason", reason).where("reason is not null")


def _risk(spark, sf_dir) -> DataFrame:
    """The events' users never stop coming, so some are made to: one tenth stays away, one tenth comes less."""
    fewer = visits(spark, sf_dir).where("(member % 10 <> 0 or day < 26) and (member % 10 <> 1 or day < 12 or visit % 4 = 0)")
    return at_risk(fewer, members(spark, sf_dir), idle_days=2)


@query(
    f"""{_WITH}, {MEMBERS_SQL}, {_RISK_SQL} SELECT member, days_idle, floor(usual * 1e6 + 0.5) / 1e6 AS usual, floor(recent * 1e6 + 0.5) / 1e6 AS recent, reason,
    CASE WHEN days_idle = 0 THEN 'Today' WHEN days_idle = 1 THEN 'Yesterday' ELSE days_idle || ' days ago' END AS last_visit
    FROM risk WHERE reason = 'declining' OR (reason = 'inactive' AND days_idle <= 60 AND usual > 0)"""
)
def at_risk_members(spark, sf_dir):
    found = _risk(spark, sf_dir).where("reason = 'declining' or (days_idle <= 60 and usual > 0)")
    return found.select("member", "days_idle", half_up(F.col("usual"), 6).alias("usual"), half_up(F.col("recent"), 6).alias("recent"), "reason", idle_label(F.col("days_idle")).alias("last_visit"))


@query(f"{_WITH}, {MEMBERS_SQL}, {_RISK_SQL} SELECT coalesce(reason, 'all') AS reason, count(*) AS members FROM risk WHERE reason IS NOT NULL GROUP BY ROLLUP (reason)")
def risk_counts(spark, sf_dir):
    return _risk(spark, sf_dir).rollup("reason").agg(F.count(F.lit(1)).alias("members")).select(F.coalesce("reason", F.lit("all")).alias("reason"), "members")


@query(f"{_WITH}, {MEMBERS_SQL}, {_RISK_SQL} SELECT member, days_idle FROM risk WHERE reason IS NOT NULL ORDER BY floor(usual * 1e6 + 0.5) DESC, days_idle, member LIMIT 10")
def risk_first_page(spark, sf_dir):
    """The first ten, most regular first."""
    return _risk(spark, sf_dir).orderBy(half_up(F.col("usual"), 6).desc(), "days_idle", "member").limit(10).select("member", "days_idle")


@query(
    """SELECT coalesce(r_name, 'chain') AS region, count(*) AS customers, floor(sum(c_acctbal) * 100 + 0.5)::BIGINT AS cents FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)"""
)
def chain_totals(spark, sf_dir):
    """Measures of each location and of the chain."""
    places = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = load(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name")
    return sums.agg(F.count(F.lit(1)).alias("customers"), half_up(F.sum("c_acctbal"), 0).alias("x"), F.sum("c_acctbal").alias("s")).select(F.coalesce("r_name", F.lit("chain")).alias("region"), "customers", half_up(F.col("s") * 100).alias("cents"))


@query(
    """SELECT n_name AS place, count(*) AS customers, floor(1e6 * count(*) / sum(count(*)) OVER () + 0.5) / 1e6 AS share, count(*) = max(count(*)) OVER () AS largest
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def chain_shares(spark, sf_dir):
    """Each place's share and whether it is the largest; totals are joined back, so no window over all rows is needed."""
    places = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("place")).agg(F.count(F.lit(1)).alias("customers"))
    total = places.agg(F.sum("customers").alias("all"), F.max("customers").alias("most"))  # one row
    return places.crossJoin(F.broadcast(total)).select("place", "customers", half_up(F.col("customers") / F.col("all"), 6).alias("share"), (F.col("customers") == F.col("most")).alias("largest"))


@query(
    f"""WITH {_DEMAND_SQL}, n AS (SELECT u.zone, u.units, coalesce(d.occupancy, 0) AS occupancy FROM units u LEFT JOIN demand d ON d.zone = u.zone AND d.weekday = {NOW_DAY % 7} AND d.hour = {int(NOW_HOUR)})
    SELECT floor(sum(occupancy * units) / sum(units) * 1e6 + 0.5) / 1e6 AS occupancy, max_by(zone, occupancy * 1000 + length(zone)) AS busiest FROM n"""
)
def floor_now(spark, sf_dir):
    """Occupancy now weighted by units, and the busiest zone."""
    here = _demand(spark, sf_dir).where((F.col("weekday") == NOW_DAY % 7) & (F.col("hour") == int(NOW_HOUR))).select("zone", "occupancy")
    zones = _units(spark).join(here, "zone", "left").withColumn("occupancy", F.coalesce("occupancy", F.lit(0.0)))
    return zones.agg(half_up(F.sum(F.col("occupancy") * F.col("units")) / F.sum("units"), 6).alias("occupancy"), F.max_by("zone", F.col("occupancy") * 1000 + F.length("zone")).alias("busiest"))


@query(
    f"""WITH {_DEMAND_SQL} SELECT zone, max_by(hour, people * 1000 - hour) AS hour FROM (SELECT zone, hour, floor(sum(demand) * 1e3 + 0.5) AS people FROM demand GROUP BY zone, hour) GROUP BY zone"""
)
def argmax_hour(spark, sf_dir):
    """The busiest hour of each zone, the earliest of equals."""
    hourly = _demand(spark, sf_dir).groupBy("zone", "hour").agg(half_up(F.sum("demand"), 3).alias("people"))
    return hourly.groupBy("zone").agg(F.max_by("hour", F.struct("people", -F.col("hour"))).alias("hour"))


@query(
    f"""WITH {_DEMAND_SQL}, p AS (SELECT zone, max(demand) AS top FROM demand GROUP BY zone)
    SELECT zone, ceil(top / 0.85)::INT - units AS missing, (floor(top * 12 / 5) * 5)::BIGINT AS monthly, '$' || CASE WHEN floor(top * 1000 + 0.5) >= 1000
    THEN format('{{:,}}', floor(top * 1000 + 0.5)::BIGINT) ELSE floor(top * 1000 + 0.5)::BIGINT::VARCHAR END AS worth FROM p JOIN units USING (zone)"""
)
def capacity_insight(spark, sf_dir):
    """Units missing for peaks at 85 %, numbers rounded down to fives, and a sum of money."""
    peak = _demand(spark, sf_dir).groupBy("zone", "units").agg(F.max("demand").alias("top"))
    return peak.select("zone", (F.ceil(F.col("top") / 0.85).cast("int") - F.col("units")).alias("missing"), (F.floor(F.col("top") * 12 / 5) * 5).alias("monthly"), dollars(F.col("top") * 1000).alias("worth"))


@query(
    "WITH t AS (SELECT * FROM (VALUES " + ", ".join(map(str, TIERS)) + f""") t(least, price)), n AS (SELECT n_name AS place, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
    SELECT place, members, arg_max(price, least)::INT AS price, ceil(arg_max(price, least) / {float(DUES)})::BIGINT AS break_even FROM n JOIN t ON least <= members GROUP BY place, members"""
)
def pricing_tier(spark, sf_dir):
    """The last tier whose least number of members is reached."""
    places = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("place")).agg(F.count(F.lit(1)).alias("members"))
    price = F.element_at(F.filter(F.array(*[F.struct(F.lit(a).alias("least"), F.lit(b).alias("price")) for a, b in TIERS]), lambda t: t["least"] <= F.col("members")), -1)["price"]
    return places.withColumn("price", price).withColumn("break_even", F.ceil(F.col("price") / float(DUES)))


@query(
    f"""{_WITH} SELECT hour, label, color, visits FROM (SELECT (floor(t) % 24)::INT AS hour, count(*) AS visits FROM visits GROUP BY ALL) h, LATERAL (SELECT CASE WHEN hour % 12 = 0 THEN '12' ELSE (hour % 12)::VARCHAR END || CASE WHEN hour < 12 THEN 'am' ELSE 'pm' END AS label,
    floor(CASE WHEN hour / 24.0 <= 0 THEN 90 WHEN hour / 24.0 <= 0.5 THEN 90 + hour / 24.0 * 220 WHEN hour / 24.0 <= 0.85 THEN 200 + (hour / 24.0 - 0.5) * 50 / 0.35 ELSE 250 + (hour / 24.0 - 0.85) * 5 / 0.15 END + 0.5)::BIGINT AS color)"""
)
def hour_labels(spark, sf_dir):
    """Visits that begin in each hour of the day, with the hour's label and colour."""
    hours = visits(spark, sf_dir).groupBy((F.floor("t") % 24).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("visits"))
    return hours.select("hour", "visits", hour_label(F.col("hour")).alias("label"), half_up(ramp(F.col("hour") / 24.0, OCCUPANCY_KNOTS)).alias("color"))


@query(
    f"""{_WITH}, z AS (SELECT member, list_sort(list_distinct(list(zone))) AS zones FROM visits GROUP BY member)
    SELECT member, CASE WHEN len(zones) = 1 THEN zones[1] ELSE array_to_string(zones[1:len(zones) - 1], ', ') || ' and ' || zones[len(zones)] END AS zones FROM z"""
)
def member_zone_list(spark, sf_dir):
    """The zones of each member in words."""
    sets = visits(spark, sf_dir).groupBy("member").agg(F.array_sort(F.collect_set("zone")).alias("z"))
    return sets.select("member", joined(F.col("z")).alias("zones"))


@query(
    f"""{_WITH} SELECT member, count(*) AS visits, string_agg(visit::VARCHAR, ',' ORDER BY t, visit) AS ids FROM visits WHERE day BETWEEN 3 AND 9 GROUP BY member"""
)
def visits_by_member(spark, sf_dir):
    """Each member's visits in order of time."""
    some = visits(spark, sf_dir, (3, 9))
    lists = some.groupBy("member").agg(F.count(F.lit(1)).alias("visits"), F.array_sort(F.collect_list(F.struct("t", "visit"))).alias("v"))
    return lists.select("member", "visits", F.array_join(F.transform("v", lambda x: x["visit"].cast("string")), ",").alias("ids"))


@query(
    f"""{_WITH}, p AS (SELECT zone, min(t) AS t, max(visit) AS ref FROM visits WHERE zone = 'purchase' GROUP BY zone, t),
    l AS (SELECT visit, t FROM visits WHERE zone = 'signup')
    SELECT visit, (SELECT arg_min(ref, abs(p.t - l.t) * 1e9 - p.t * 1e-3) FROM p) AS ref FROM l"""
)
def asof_nearest_visit(spark, sf_dir):
    """For each sign-up, the purchase nearest in time; the later one on ties."""
    v = visits(spark, sf_dir)
    right = v.where("zone = 'purchase'").groupBy("t").agg(F.max("visit").alias("ref")).withColumn("site", F.lit(1))
    left = v.where("zone = 'signup'").select("visit", "t", F.lit(1).alias("site"))
    return nearest(left, right, ["site"], "t", ["ref"], cell=6.0).select("visit", "ref")
