"""Member training: loads by muscle, recovery, workouts, progress, calendar, next session.

Orders stand in for workouts (customer = member), line items for sets, parts for exercises.
The muscle tables are long: one row for each exercise and muscle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.scalars import half_up
from kinetrace.plans.registry import Registry
from kinetrace.sources.tables import load

query = Registry()
MUSCLES = ("chest", "back", "shoulders", "biceps", "triceps", "quads", "hamstrings", "glutes", "calves", "abs")
READY, RECOVERING, TRAINED, UNTRAINED_HOURS, OVERDUE_HOURS = 85, 45, 0.25, 672, 168
#: Line items of one task.
TASK_ROWS = 1_000_000
MOST_EXERCISES, LEAST_EXERCISES, LEAST_GAIN, COVERED = 4, 3, 0.5, 0.25

#: Exercises (type of part) with their muscles; 1 is primary, 0.5 secondary.  The n-th type takes three muscles from the n-th on.
_MAP = "map AS (SELECT name, m.muscle, m.weight FROM (SELECT p_type AS name, row_number() OVER (ORDER BY p_type) - 1 AS n FROM (SELECT DISTINCT p_type FROM part)) t, (SELECT unnest(range(3)) AS k) k, LATERAL (SELECT muscles[1 + (n * 3 + k) % 10] AS muscle, CASE WHEN k = 0 THEN 1.0 ELSE 0.5 END AS weight FROM (SELECT " + str(list(MUSCLES)) + " AS muscles)) m)"
_SETS = "sets AS (SELECT o_custkey AS member, o_orderkey AS workout, o_orderdate AS day, p_type AS exercise, l_linenumber AS n, l_quantity::INT AS reps FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def muscle_map(spark, sf_dir) -> DataFrame:
    """name, muscle, weight of every exercise."""
    types = load(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    numbered = types.withColumn("n", F.row_number().over(Window.orderBy("name")) - 1)  # a row per exercise
    slots = numbered.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    muscle = F.element_at(F.array(*map(F.lit, MUSCLES)), 1 + (F.col("n") * 3 + F.col("k")) % 10)
    return slots.select("name", muscle.alias("muscle"), F.when(F.col("k") == 0, 1.0).otherwise(0.5).alias("weight"))


def sets(spark, sf_dir) -> DataFrame:
    """member, workout, day, exercise, n, reps; rows lie by workout, in more parts for more rows, so what a task sorts and adds up stays as large as it is."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lines.count() // TASK_ROWS + 1
    dealt = lambda rows, key: rows.repartition(parts, key) if parts > usual else rows
    named = dealt(lines, "l_partkey").join(dealt(load(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = dealt(named, "l_orderkey").join(dealt(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("workout"), F.col("o_orderdate").alias("day"), F.col("p_type").alias("exercise"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("reps"))


@query(
    f"""WITH {_MAP}, {_SETS}, l AS (SELECT member, muscle, sum(reps * weight) AS load FROM sets JOIN map ON exercise = name GROUP BY member, muscle)
    SELECT member, muscle, floor(load / max(load) OVER (PARTITION BY member) * 1000 + 0.5) / 1000 AS load FROM l"""
)
def muscle_load(spark, sf_dir):
    """Weighted repetitions by muscle, as a share of the member's most loaded one."""
    loads = sets(spark, sf_dir).groupBy("member", "exercise").agg(F.sum("reps").alias("reps"))
    loads = loads.join(muscle_map(spark, sf_dir), F.col("exercise") == F.col("name")).groupBy("member", "muscle").agg(F.sum(F.col("reps") * F.col("weight")).alias("load"))
    most = F.max("load").over(Window.partitionBy("member"))
    return loads.select("member", "muscle", half_up(F.col("load") / F.coalesce(F.nullif(most, F.lit(0.0)), F.lit(1.0)), 3).alias("load"))


@query(
    f"""WITH {_MAP}, {_SETS}, s AS (SELECT workout, muscle, sum(weight * CASE WHEN reps = 0 THEN 10 ELSE reps END) AS score FROM sets JOIN map ON exercise = name GROUP BY workout, muscle)
    SELECT workout, muscle, least(1, floor(score / greatest(24, max(score) OVER (PARTITION BY workout)) * 100 + 0.5) / 100) AS intensity FROM s"""
)
def muscle_intensity(spark, sf_dir):
    """Loads of a workout against its highest score, at least 24; zero or unknown repetitions count as ten."""
    reps = F.when(F.col("reps").isNull() | (F.col("reps") == 0), 10).otherwise(F.col("reps"))
    scores = sets(spark, sf_dir).join(F.broadcast(muscle_map(spark, sf_dir)), F.col("exercise") == F.col("name"))  # three rows per exercise
    scores = scores.groupBy("workout", "muscle").agg(F.sum(F.col("weight") * reps).alias("score"))
    most = F.greatest(F.lit(24.0), F.max("score").over(Window.partitionBy("workout")))
    return scores.select("workout", "muscle", F.least(F.lit(1.0), half_up(F.col("score") / most, 2)).alias("intensity"))


_ALIAS = (("quads", "legs", 1.0), ("hamstrings", "legs", 0.5), ("calves", "legs", 0.5), ("glutes", "legs", 1.0), ("biceps", "arms", 1.0), ("triceps", "arms", 1.0))


@query(
    f"""WITH {_MAP}, {_SETS}, a AS (SELECT * FROM (VALUES {", ".join(map(str, _ALIAS))}) a(muscle, area, factor)),
    l AS (SELECT member, muscle, sum(reps * weight) / 400 AS load FROM sets JOIN map ON exercise = name GROUP BY member, muscle)
    SELECT member, coalesce(area, l.muscle) AS area, floor(max(least(1, load * coalesce(factor, 1))) * 1000 + 0.5) / 1000 AS load FROM l LEFT JOIN a ON l.muscle = a.muscle GROUP BY member, coalesce(area, l.muscle)"""
)
def muscle_remap(spark, sf_dir):
    """Fine muscles to coarse areas with a factor; where several meet, the largest counts."""
    alias = spark.createDataFrame(list(_ALIAS), "muscle string, area string, factor double")
    loads = sets(spark, sf_dir).join(F.broadcast(muscle_map(spark, sf_dir)), F.col("exercise") == F.col("name"))
    loads = loads.groupBy("member", "muscle").agg((F.sum(F.col("reps") * F.col("weight")) / 400).alias("load")).join(F.broadcast(alias), "muscle", "left")
    area = F.coalesce("area", "muscle")
    return loads.groupBy("member", area.alias("area")).agg(half_up(F.max(F.least(F.lit(1.0), F.col("load") * F.coalesce("factor", F.lit(1.0)))), 3).alias("load"))


@query(
    f"""WITH {_SETS} SELECT workout, exercise, count(*) AS sets, string_agg(reps::VARCHAR, ',' ORDER BY n, reps) AS reps_per_set, sum(reps)::BIGINT AS total FROM sets GROUP BY workout, exercise"""
)
def workout_rollup(spark, sf_dir):
    """Sets, repetitions of each set in order, and their sum by exercise."""
    s = sets(spark, sf_dir).groupBy("workout", "exercise").agg(F.count(F.lit(1)).alias("sets"), F.array_sort(F.collect_list(F.struct("n", "reps"))).alias("l"), F.sum("reps").alias("total"))
    return s.select("workout", "exercise", "sets", F.array_join(F.transform("l", lambda x: x["reps"].cast("string")), ",").alias("reps_per_set"), "total")


@query(
    f"""WITH {_SETS}, d AS (SELECT member, exercise, day, sum(reps)::BIGINT AS reps FROM sets GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY member, exercise ORDER BY reps DESC, day DESC) AS best, count(*) OVER (PARTITION BY member, exercise) AS times FROM d),
    b AS (SELECT member, exercise, reps AS best, strftime(day, '%Y-%m-%d') AS best_day, times FROM r WHERE best = 1)
    SELECT *, row_number() OVER (PARTITION BY member ORDER BY times DESC, exercise)::INT AS rank FROM b"""
)
def progress_best(spark, sf_dir):
    """Best day of each exercise, the latest of equals, ranked by how often it was done."""
    days = sets(spark, sf_dir).groupBy("member", "exercise", "day").agg(F.sum("reps").alias("reps"))
    best = days.groupBy("member", "exercise").agg(F.max(F.struct("reps", "day")).alias("b"), F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("member").orderBy(F.col("times").desc(), "exercise"))
    return best.select("member", "exercise", F.col("b.reps").alias("best"), F.date_format("b.day", "yyyy-MM-dd").alias("best_day"), "times", rank.alias("rank"))


_CALENDAR = """m AS (SELECT DISTINCT user_id AS member FROM events), g AS (SELECT member, d::DATE AS day FROM m, generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(d))"""


@query(
    f"""WITH {_CALENDAR} SELECT g.member, strftime(g.day, '%Y-%m-%d') AS day, coalesce(sum(json_extract(props, '$.k')::INT), 0)::BIGINT AS reps, count(e.event_id) AS sessions
    FROM g LEFT JOIN events e ON e.user_id = g.member AND e.ts::DATE = g.day GROUP BY ALL"""
)
def activity_calendar(spark, sf_dir):
    """Thirty days of each member, empty ones as 0."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("member"), F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    grid = e.select("member").distinct().withColumn("day", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))))
    sums = e.groupBy("member", "day").agg(F.sum("k").alias("reps"), F.count(F.lit(1)).alias("sessions"))
    found = grid.join(sums, ["member", "day"], "left").na.fill(0, ["reps", "sessions"])
    return found.select("member", F.date_format("day", "yyyy-MM-dd").alias("day"), "reps", "sessions")


_HOURS = f"""{_MAP}, {_SETS}, w AS (SELECT member, muscle, day, sum(reps * weight) / 20 AS load FROM sets JOIN map ON exercise = name GROUP BY ALL),
    h AS (SELECT m.member, u.muscle, coalesce((epoch(TIMESTAMP '2001-08-02') - epoch(max(w.day) FILTER (load >= {TRAINED}))) / 3600, {UNTRAINED_HOURS}) / 24 AS hours
        FROM (SELECT DISTINCT member FROM w) m CROSS JOIN (SELECT unnest({list(MUSCLES)}) AS muscle) u LEFT JOIN w ON w.member = m.member AND w.muscle = u.muscle GROUP BY ALL)"""


def hours_since_trained(spark, sf_dir) -> DataFrame:
    """Hours since each muscle was last loaded, or UNTRAINED_HOURS.

    Workouts are years apart in these tables, so a day counts for an hour.
    """
    days = sets(spark, sf_dir).join(F.broadcast(muscle_map(spark, sf_dir)), F.col("exercise") == F.col("name"))
    days = days.groupBy("member", "muscle", "day").agg((F.sum(F.col("reps") * F.col("weight")) / 20).alias("load"))
    last = days.groupBy("member", "muscle").agg(F.max(F.when(F.col("load") >= TRAINED, F.col("day"))).alias("last"))
    grid = days.select("member").distinct().withColumn("muscle", F.explode(F.array(*map(F.lit, MUSCLES))))
    since = (F.unix_timestamp(F.lit("2001-08-02").cast("timestamp")) - F.unix_timestamp("last")) / 3600
    return grid.join(last, ["member", "muscle"], "left").select("member", "muscle", (F.coalesce(since, F.lit(float(UNTRAINED_HOURS))) / 24).alias("hours"))


def recovery(hours: DataFrame, needed: float = 72.0) -> DataFrame:
    """percent, status and need of each muscle from its hours since training."""
    share = F.least(F.lit(1.0), F.col("hours") / needed)
    out = hours.withColumn("percent", half_up(share * 100)).withColumn("need", F.least(F.lit(1.0), F.col("hours") / OVERDUE_HOURS))
    return out.withColumn("status", F.when(F.col("percent") < RECOVERING, "fatigued").when(F.col("percent") < READY, "recovering").otherwise("ready"))


_RECOVERY = f"""{_HOURS}, r AS (SELECT *, floor(least(1, hours / 72) * 100 + 0.5)::BIGINT AS percent, least(1, hours / {OVERDUE_HOURS}) AS need FROM h)"""


@query(
    f"""WITH {_RECOVERY} SELECT member, muscle, percent, floor(need * 1e6 + 0.5) / 1e6 AS need, CASE WHEN percent < {RECOVERING} THEN 'fatigued' WHEN percent < {READY} THEN 'recovering' ELSE 'ready' END AS status FROM r"""
)
def recovery_status(spark, sf_dir):
    return recovery(hours_since_trained(spark, sf_dir)).select("member", "muscle", "percent", half_up(F.col("need"), 6).alias("need"), "status")


@query(
    f"""WITH {_RECOVERY} SELECT member, name AS exercise, coalesce(string_agg(muscle, ',' ORDER BY muscle) FILTER ((weight = 1 AND percent < {READY}) OR percent < {RECOVERING}), '') AS waiting_on
    FROM r JOIN map USING (muscle) GROUP BY member, name"""
)
def exercises_waiting(spark, sf_dir):
    """What each exercise waits for: primary muscles that are not ready, secondary ones that are fatigued."""
    r = recovery(hours_since_trained(spark, sf_dir)).join(F.broadcast(muscle_map(spark, sf_dir)), "muscle")
    blocked = ((F.col("weight") == 1) & (F.col("status") != "ready")) | (F.col("status") == "fatigued")
    return r.groupBy("member", F.col("name").alias("exercise")).agg(F.array_join(F.array_sort(F.collect_set(F.when(blocked, F.col("muscle")))), ",").alias("waiting_on"))


@query(
    f"""WITH {_MAP}, {_SETS}, w AS (SELECT workout, muscle, sum(reps * weight) / 60 AS load FROM sets JOIN map ON exercise = name GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY workout ORDER BY floor(load * 1e6 + 0.5) DESC, muscle) AS k FROM w WHERE load >= 0.5)
    SELECT workout, string_agg(muscle, ',' ORDER BY k) AS muscles FROM r WHERE k <= 3 GROUP BY workout"""
)
def workout_title(spark, sf_dir):
    """The three most worked muscles of a workout."""
    loads = sets(spark, sf_dir).join(F.broadcast(muscle_map(spark, sf_dir)), F.col("exercise") == F.col("name")).groupBy("workout", "muscle").agg((F.sum(F.col("reps") * F.col("weight")) / 60).alias("load"))
    best = loads.where("load >= 0.5").groupBy("workout").agg(F.array_sort(F.collect_list(F.struct((-half_up(F.col("load"), 6)).alias("l"), "muscle"))).alias("m"))
    return best.select("workout", F.array_join(F.transform(F.slice("m", 1, 3), lambda x: x["muscle"]), ",").alias("muscles"))


@query(
    f"""WITH {_SETS}, e AS (SELECT workout, exercise, min(n) AS first, string_agg(reps::VARCHAR, ', ' ORDER BY n, reps) AS reps FROM sets GROUP BY workout, exercise)
    SELECT workout, string_agg(exercise || ': ' || reps, '; ' ORDER BY first, exercise) AS recap FROM e GROUP BY workout"""
)
def workout_recap(spark, sf_dir):
    """A line for each workout, exercises in the order they were first done."""
    e = sets(spark, sf_dir).groupBy("workout", "exercise").agg(F.min("n").alias("first"), F.array_sort(F.collect_list(F.struct("n", "reps"))).alias("l"))
    part = F.concat("exercise", F.lit(": "), F.array_join(F.transform("l", lambda x: x["reps"].cast("string")), ", "))
    whole = e.select("workout", F.struct("first", "exercise", part.alias("text")).alias("p")).groupBy("workout").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("workout", F.array_join(F.transform("p", lambda x: x["text"]), "; ").alias("recap"))


@query(
    f"""WITH {_MAP}, {_SETS}, w AS (SELECT member, muscle, workout, day, sum(reps * weight) / 20 AS load FROM sets JOIN map ON exercise = name GROUP BY ALL)
    SELECT member, muscle, max(day * 1)::VARCHAR AS day FROM (SELECT member, muscle, strftime(day, '%Y%m%d')::BIGINT AS day FROM w WHERE load >= {TRAINED}) GROUP BY member, muscle"""
)
def last_trained(spark, sf_dir):
    """The newest day each muscle was loaded."""
    days = sets(spark, sf_dir).join(F.broadcast(muscle_map(spark, sf_dir)), F.col("exercise") == F.col("name"))
    days = days.groupBy("member", "muscle", "workout", "day").agg((F.sum(F.col("reps") * F.col("weight")) / 20).alias("load"))
    return days.where(F.col("load") >= TRAINED).groupBy("member", "muscle").agg(F.date_format(F.max("day"), "yyyyMMdd").alias("day"))


def plan_sessions(need: np.ndarray, ready: np.ndarray, tired: np.ndarray, primary: np.ndarray, secondary: np.ndarray) -> np.ndarray:
    """Greedy choice for many members at once: the exercise of each pick, -1 for none.

    need, ready, tired: members by muscles; primary, secondary: exercises by muscles.  The focus is the muscle most in
    need that is ready, the first of equals; picks maximise the need that no pick before them covers.
    """
    score = np.where(ready, need, -1.0)
    focus = score.argmax(1)
    waits = (primary @ ~ready.T > 0) | ((primary | secondary) @ tired.T > 0)  # exercises by members
    open_ = ~waits.T & (score.max(1) > 0)[:, None]
    fixed = 0.05 * secondary[:, focus].T - 0.1 * (primary.sum(1)[None] - primary[:, focus].T)
    covered = np.zeros(need.shape, bool)
    picks = np.full((len(need), MOST_EXERCISES), -1)
    going, rows = np.ones(len(need), bool), np.arange(len(need))
    for n in range(MOST_EXERCISES):
        gain = np.where(open_, (need * np.where(covered, COVERED, 1.0)) @ primary.T + fixed, -np.inf)
        best = gain.argmax(1)
        most = gain[rows, best]
        going &= np.isfinite(most)
        if n >= LEAST_EXERCISES:
            going &= ~(covered[rows, focus] & (most < LEAST_GAIN))
        picks[going, n] = best[going]
        covered[going] |= primary[best[going]]
        open_[rows[going], best[going]] = False
    return picks


@query()
def next_session(spark, sf_dir):
    """Exercises for each member's next session; members are planned in batches, as the table of exercises is the same for all."""
    table = sorted((r.name, -r.weight, r.muscle) for r in muscle_map(spark, sf_dir).collect())  # a few rows per exercise
    names = sorted({name for name, _, _ in table})
    muscles = list(dict.fromkeys(muscle for _, _, muscle in table))
    primary, secondary = (np.zeros((len(names), len(muscles)), bool) for _ in "ps")
    for name, weight, muscle in table:
        (primary if weight == -1 else secondary)[names.index(name), muscles.index(muscle)] = True

    def plan(batches):
        for rows in batches:
            need, ready, tired = (np.stack([rows[f"{m}_{c}"] for m in muscles], 1) for c in ("need", "ready", "tired"))
            picks = plan_sessions(need, ready, tired, primary, secondary)
            yield pd.DataFrame({"member": rows.member, "n": (picks >= 0).sum(1).astype("int32"), "exercises": [",".join(names[i] for i in p if i >= 0) for p in picks.tolist()]})

    r = recovery(hours_since_trained(spark, sf_dir))
    wide = r.groupBy("member").pivot("muscle", muscles).agg(F.first("need").alias("need"), F.first(F.col("status") == "ready").alias("ready"), F.first(F.col("status") == "fatigued").alias("tired"))
    return wide.mapInPandas(plan, "member long, n int, exercises string")


@query(
    """SELECT o_orderkey AS workout, datediff('day', o_orderdate, TIMESTAMP '2001-08-02') AS days_ago, CASE WHEN datediff('day', o_orderdate, TIMESTAMP '2001-08-02') < 30 THEN 'recent' ELSE 'old' END AS age
    FROM orders WHERE o_totalprice > 0 AND datediff('day', o_orderdate, TIMESTAMP '2001-08-02') < 90"""
)
def recent_workouts(spark, sf_dir):
    ago = F.datediff(F.lit("2001-08-02").cast("date"), "o_orderdate").cast("long")
    o = load(spark, sf_dir, "orders").where(F.col("o_totalprice") > 0).select(F.col("o_orderkey").alias("workout"), ago.alias("days_ago")).where("days_ago < 90")
    return o.withColumn("age", F.when(F.col("days_ago") < 30, "recent").otherwise("old"))
