"""People of a site from the tracks of several cameras, as joins, windows and rounds of joins.

Rows are observations: site, tick, key (of the track), camera, x, y, sigma, edge (cut by the picture's edge) and, if there
is such a column, look, a vector of the person's appearance (null where none was taken).

1. Evidence.  Pairs of tracks of two cameras that ever come within the gate, found by cells of place in each tick, get a
   log likelihood ratio for each common tick, added up over time, and once the likeness of their looks.
2. Links.  In each tick a pair is confirmed if its score and its lead over the other pairs of either track suffice and it
   is part of the best one-to-one assignment; only a tick's pairs that compete with others go through that kernel.  A link
   holds from its confirmation until its score falls below the floor.
3. Identities.  Between changes of links the tracks that are ever linked with each other are merged under constraints
   (``matching.merged``), for all stretches of time at once.  A cluster is the person of its oldest track, so numbers are
   stable: an older cluster that joins takes the younger one in, a part that splits off is the person of its own oldest track.
4. Re-acquisition.  A track that starts anew is compared with the people that this camera has lost; who they are depends
   on earlier re-acquisitions, so 3 and 4 are repeated until nothing changes.  Such a link holds from the tick after its
   decision, so decisions depend on those of earlier ticks only, and each repetition settles at least the next one of a site.
5. World.  The people of a tick are those known ``lag_s`` later: positions weighted by certainty, people out of sight for
   some seconds, lifecycle and confidence.

A link's strength is that of its last confirmation while it held.  The rivals of a pair are the pairs of the same tick.
People lost for longer than ``lost_s`` are not looked for.  No step gathers a site, or a track, in one task's memory.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions import geometry as g
from kinetrace.functions.scalars import ramp
from kinetrace.operators import kernels
from kinetrace.operators.identity import Settings
from kinetrace.operators.matching import Rounds, merged

FOREVER = 1 << 60
#: Fixed values of the re-acquisition score: spread where another camera sees the person, growth and greatest spread of a lost one, reach of a step, evidence limit, and the gap beyond which place alone is not enough.
LIVE_SIGMA, LOST_SIGMA, SIGMA_PER_S, MOST_SIGMA, STEP_M, LIMIT, ALONE_S = 0.6, 0.5, 0.7, 6.0, 0.8, 4.0, 5.0
#: Evidence of the cosine of two looks, how many rows of a track must have one, likeness that bridges a longer gap and unlikeness that none does, and what place must give a link.
LOOKS = [(0.0, -2.0), (0.3, -1.0), (0.5, 0.0), (0.7, 1.0), (1.0, 2.0)]
LEAST_LOOKS, LIKE, UNLIKE, LEAST_PLACE = 3, 0.5, -0.5, 3.0


def with_looks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("look", F.col("look") if "look" in rows.columns else F.lit(None).cast("array<double>"))


def likeness(a: Column, b: Column) -> Column:
    """Evidence of two looks; null without both."""
    alike = g.cosine(a, b)
    return F.when(alike.isNotNull(), ramp(alike, LOOKS))


def tracks(rows: DataFrame) -> DataFrame:
    """site, key, camera, begin, end, ticks, x0, y0, x1, y1, edge (share of rows), look (the first), number (by begin, then key)."""
    at = lambda f, c: f(c, "tick")
    look = F.when(F.count("look") >= LEAST_LOOKS, F.min_by("look", F.when(F.col("look").isNotNull(), F.col("tick"))))
    found = with_looks(rows).groupBy("site", "key").agg(
        F.min("camera").alias("camera"), F.min("tick").alias("begin"), F.max("tick").alias("end"), F.count(F.lit(1)).alias("ticks"), F.avg(F.col("edge").cast("int")).alias("edge"), look.alias("look"),
        *[at(f, c).alias(f"{c}{n}") for n, f in ((0, F.min_by), (1, F.max_by)) for c in "xy"],
    )
    return found.withColumn("number", F.row_number().over(Window.partitionBy("site").orderBy("begin", "key")).cast("long"))


def near_pairs(rows: DataFrame, s: Settings) -> DataFrame:
    """site, a, b: tracks of two cameras (a's is the first by name) that come within the gate in some tick."""
    cell = [F.floor(F.col(c) / s.gate_m) for c in "xy"]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = rows.select("site", "tick", *[F.col(c).alias(f"{c}_a") for c in ("key", "camera", "x", "y")], *[k.alias(n) for k, n in zip(cell, ("cx", "cy"), strict=True)])
    right = rows.select("site", "tick", *[F.col(c).alias(f"{c}_b") for c in ("key", "camera", "x", "y")], cell[0].alias("px"), cell[1].alias("py"), F.explode(steps).alias("d"))
    right = right.select("site", "tick", "key_b", "camera_b", "x_b", "y_b", (F.col("px") + F.col("d.i")).alias("cx"), (F.col("py") + F.col("d.j")).alias("cy"))
    pairs = left.join(right, ["site", "tick", "cx", "cy"]).where((F.col("camera_a") < F.col("camera_b")) & (F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")) <= s.gate_m))
    return pairs.select("site", F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def evidence(rows: DataFrame, near: DataFrame, who: DataFrame, s: Settings) -> DataFrame:
    """site, tick, a, b, ca, cb, d, and so far place (evidence of it), score and n: every common tick of the near pairs."""
    for n in "ab":
        near = near.join(who.select("site", F.col("key").alias(n), F.col("look").alias(f"look_{n}")), ["site", n])
    near = near.select("site", "a", "b", F.coalesce(likeness(F.col("look_a"), F.col("look_b")), F.lit(0.0)).alias("alike"))
    side = lambda n: rows.select("site", "tick", F.col("key").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("camera", "x", "y", "sigma", "edge")])
    both = near.join(side("a"), ["site", "a"]).join(side("b"), ["site", "b", "tick"])
    d, v = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")), F.col("sigma_a") * F.col("sigma_a") + F.col("sigma_b") * F.col("sigma_b")
    llr = g.geometry_evidence(d, v, F.lit(True), F.col("edge_a") | F.col("edge_b"), s.gate_m, s.competitor_m)
    w = Window.partitionBy("site", "a", "b").orderBy("tick")
    place = F.sum(llr).over(w) * (s.tick_s / s.tau_s)
    return both.select(
        "site", "tick", "a", "b", F.col("camera_a").alias("ca"), F.col("camera_b").alias("cb"), d.alias("d"), place.alias("place"), (place + F.col("alike")).alias("score"), F.row_number().over(w).alias("n"),
    )


def leads(seen: DataFrame, s: Settings) -> DataFrame:
    """Adds to pairs that overlap long enough the lead over the best other pair of either track, and whether there is another."""
    ready = seen.where(F.col("n") * s.tick_s >= s.overlap_s - 1e-9)

    def others(*keys: str) -> tuple[Column, Column]:
        every = F.sort_array(F.collect_list("score").over(Window.partitionBy("site", "tick", *keys)), asc=False)  # one per person in view
        return F.when(F.col("score") < every[0], every[0]).otherwise(F.get(every, F.lit(1))), F.size(every) > 1

    (row, more), (column, more_too) = others("a", "cb"), others("b", "ca")
    rival = F.greatest(F.lit(0.0), row, column)
    return ready.withColumns({"lead": F.col("score") - rival, "rivalled": more | more_too}).withColumn("sure", (F.col("score") >= s.link) & (F.col("place") >= LEAST_PLACE) & (F.col("lead") >= s.margin))


def _assigned(cells: pd.DataFrame) -> pd.DataFrame:
    """The pairs of the best one-to-one assignment of one tick's competing pairs of two cameras."""
    matrix = cells.pivot(index="a", columns="b", values="score").sort_index().sort_index(axis=1)
    found = [(matrix.index[i], matrix.columns[j]) for i, j in kernels.assign(matrix.fillna(-1000.0).to_numpy())]
    return pd.DataFrame([(cells.site.iloc[0], cells.tick.iloc[0], a, b) for a, b in found], columns=["site", "tick", "a", "b"])


def cross_links(seen: DataFrame, s: Settings) -> DataFrame:
    """site, a, b, begin, until, strength: when links of two cameras hold."""
    steps = leads(seen, s)
    hard = steps.where("sure and rivalled").select("site", "tick", "ca", "cb").distinct()
    picked = steps.join(hard, ["site", "tick", "ca", "cb"], "left_semi").select("site", "tick", "ca", "cb", "a", "b", "score").groupBy("site", "tick", "ca", "cb").applyInPandas(_assigned, "site string, tick long, a string, b string")
    steps = steps.join(picked.withColumn("picked", F.lit(True)), ["site", "tick", "a", "b"], "left")
    confirmed = F.col("sure") & (~F.col("rivalled") | F.col("picked"))
    steps = steps.select("site", "tick", "a", "b", F.least("score", F.col("lead") + 4).alias("strength"), F.when(confirmed, 1).when(F.col("score") < s.revoke, 0).alias("says"))
    w = Window.partitionBy("site", "a", "b").orderBy("tick")
    held = steps.withColumn("held", F.coalesce(F.last("says", True).over(w), F.lit(0)))
    turned = held.withColumn("turn", (F.col("held") != F.coalesce(F.lag("held").over(w), F.lit(0))).cast("int")).withColumn("part", F.sum("turn").over(w))
    parts = turned.where("part > 0").groupBy("site", "a", "b", "part").agg(F.min("tick").alias("begin"), F.max("held").alias("held"), F.max_by("strength", F.when(F.col("says") == 1, F.col("tick"))).alias("strength"))
    until = F.coalesce(F.lead("begin").over(Window.partitionBy("site", "a", "b").orderBy("part")), F.lit(FOREVER))
    return parts.withColumn("until", until).where("held = 1").select("site", "a", "b", "begin", "until", "strength")


def timeline(links: DataFrame, who: DataFrame, seen: DataFrame, s: Settings, keep) -> DataFrame:
    """site, key, since, until, person, oldest (its begin), strength (of the weakest link): whose each track is, over time."""
    own = who.select("site", "key", F.lit(-FOREVER).alias("since"), F.col("number").alias("person"), F.col("begin").alias("oldest"), F.lit(None).cast("double").alias("strength"))
    nodes = links.select("site", F.explode(F.array("a", "b")).alias("item")).distinct()
    none = links.select("site", "a", "b").limit(0)
    groups = merged(nodes, links.select("site", "a", "b", F.lit(0.0).alias("score")), none, ["site"]).select("site", F.col("item").alias("key"), F.col("root").alias("circle"))
    groups = keep(groups, "circles")
    mine = keep(links.join(groups.withColumnRenamed("key", "a"), ["site", "a"]), "links")
    epochs = mine.select("site", "circle", F.explode(F.array("begin", "until")).alias("epoch")).where(F.col("epoch") < FOREVER).distinct()
    keys = ["site", "circle", "epoch"]
    items = epochs.join(groups, ["site", "circle"]).select(*keys, F.col("key").alias("item"))
    alive = mine.join(epochs, ["site", "circle"]).where((F.col("begin") <= F.col("epoch")) & (F.col("epoch") < F.col("until")))
    alive = keep(alive.select(*keys, "a", "b", F.col("strength").alias("score")), "alive")
    walls = keep(apart(groups, who, seen, s), "walls")
    walls = epochs.join(walls, ["site", "circle"]).select(*keys, "a", "b")
    clusters = keep(merged(items, alive, walls, keys), "clusters")
    weakest = alive.join(clusters.select(*keys, F.col("item").alias("a"), F.col("root")), [*keys, "a"]).join(clusters.select(*keys, F.col("item").alias("b"), F.col("root").alias("other")), [*keys, "b"])
    weakest = weakest.where("root = other").groupBy(*keys, "root").agg(F.min("score").alias("strength"))
    first = clusters.join(who.select("site", F.col("key").alias("item"), "begin", "number"), ["site", "item"]).groupBy(*keys, "root").agg(F.min("number").alias("person"), F.min("begin").alias("oldest"))
    later = clusters.join(first, [*keys, "root"]).join(weakest, [*keys, "root"], "left").select("site", F.col("item").alias("key"), F.col("epoch").alias("since"), "person", "oldest", "strength")
    until = F.coalesce(F.lead("since").over(Window.partitionBy("site", "key").orderBy("since")), F.lit(FOREVER))
    return own.unionByName(later).withColumn("until", until)


def apart(groups: DataFrame, who: DataFrame, seen: DataFrame, s: Settings) -> DataFrame:
    """site, circle, a, b: tracks that are never one person: together in one camera, or in two but not near enough."""
    lives = groups.join(who.select("site", "key", "camera", "begin", "end"), ["site", "key"])
    sides = [lives.select("site", "circle", *[F.col(c).alias(f"{c}_{n}") for c in ("key", "camera", "begin", "end")]) for n in "ab"]
    pairs = sides[0].join(sides[1], ["site", "circle"]).where((F.col("key_a") != F.col("key_b")) & (F.col("camera_a") <= F.col("camera_b")))
    pairs = pairs.where(F.least("end_a", "end_b") - F.greatest("begin_a", "begin_b") >= 2)
    near = seen.groupBy("site", "a", "b").agg(F.avg("d").alias("mean"))
    met = pairs.select("site", "circle", F.col("key_a").alias("a"), F.col("key_b").alias("b"), (F.col("camera_a") == F.col("camera_b")).alias("same")).join(near, ["site", "a", "b"], "left")
    return met.where(F.col("same") | F.col("mean").isNull() | (F.col("mean") > s.conflict_m)).select("site", "circle", "a", "b")


def reacquired(rows: DataFrame, who: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """site, key, tick, previous, outcome, strength: what each newly started track is taken for."""
    delay, lost = round(2.0 / s.tick_s), round(s.lost_s / s.tick_s)
    asks = who.select("site", F.col("key").alias("t"), F.col("camera").alias("camera_t"), F.col("begin").alias("begin_t"), F.col("end").alias("end_t"), "x0", "y0", F.col("edge").alias("edge_t"), F.col("look").alias("look_t"), F.least(F.col("begin") + delay, "end").alias("tick"))
    whose = known.select("site", F.col("key").alias("t"), "since", "until", F.col("person").alias("me"), F.col("oldest").alias("my_oldest"))
    asks = asks.join(whose, ["site", "t"]).where((F.col("since") <= F.col("tick")) & (F.col("tick") < F.col("until")) & (F.col("my_oldest") >= F.col("begin_t") - 1)).drop("since", "until", "my_oldest")
    cell = lambda c: F.floor(c / lost)
    # tracks that ended in the time in which people are looked for, by cells of time
    ended = who.select("site", F.col("key").alias("o"), F.col("end").alias("end_o"), F.col("begin").alias("begin_o"), F.explode(F.array(cell(F.col("end")), cell(F.col("end")) + 1)).alias("cell"))
    met = asks.withColumn("cell", cell(F.col("begin_t") + 1)).join(ended, ["site", "cell"]).where((F.col("t") != F.col("o")) & (F.col("end_o") <= F.col("begin_t") + 1) & (F.col("end_o") >= F.col("begin_t") - lost) & (F.col("begin_o") <= F.col("tick")))
    at = lambda name: known.select("site", F.col("key").alias(name), F.col("since"), F.col("until"), "person")
    met = met.drop("cell", "end_o", "begin_o").join(at("o"), ["site", "o"]).where((F.col("since") <= F.col("tick")) & (F.col("tick") < F.col("until")) & (F.col("person") != F.col("me")))
    met = met.drop("o", "since", "until").distinct()
    members = met.join(at("m"), ["site", "person"]).where((F.col("since") <= F.col("tick")) & (F.col("tick") < F.col("until"))).drop("since", "until")
    members = members.join(who.select("site", F.col("key").alias("m"), "camera", "begin", "end", "x1", "y1", "look"), ["site", "m"]).where(F.col("begin") <= F.col("tick"))
    here = rows.select("site", F.col("key").alias("m"), F.col("tick").alias("begin_t"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    members = members.join(here, ["site", "m", "begin_t"], "left")
    same = F.col("camera") == F.col("camera_t")
    live = ~same & F.col("lx").isNotNull()
    people = members.groupBy("site", "t", "person").agg(
        *[F.first(c).alias(c) for c in ("tick", "begin_t", "x0", "y0", "edge_t", "look_t")],
        F.bool_or(same & (F.least("end", "end_t") - F.greatest("begin", "begin_t") >= 2)).alias("clash"), F.bool_or(same).alias("was_here"), F.bool_or(live).alias("live"),
        F.max("end").alias("last"), F.max_by(F.struct("x1", "y1", "m"), F.struct("end", "m")).alias("lost_at"),
        F.max_by(F.struct("m", "look"), F.when(same, F.struct("end", "m"))).alias("here"), F.max_by("look", F.struct("end", "m")).alias("last_look"), F.min_by(F.struct("lx", "ly"), F.when(live, F.col("m"))).alias("seen_at"),
    )
    people = people.where(~F.col("clash") & F.when(F.col("live"), F.col("was_here") & (F.col("edge_t") <= 0.5)).otherwise(F.col("last") <= F.col("begin_t") + 1))
    gap = F.when(F.col("live"), s.tick_s).otherwise(F.greatest((F.col("begin_t") - F.col("last")) * s.tick_s, F.lit(s.tick_s)))
    x, y = (F.when(F.col("live"), F.col(f"seen_at.l{c}")).otherwise(F.col(f"lost_at.{c}1")) for c in "xy")
    people = people.withColumns({"gap": gap, "d": F.hypot(F.col("x0") - x, F.col("y0") - y)})
    reach = F.when(F.col("live"), F.col("d") <= s.gate_m).otherwise(F.greatest(F.lit(0.0), F.col("d") - STEP_M) / F.col("gap") <= s.walk_m_s)
    spread = F.when(F.col("live"), LIVE_SIGMA).otherwise(F.least(LOST_SIGMA + SIGMA_PER_S * F.col("gap"), F.lit(MOST_SIGMA)))
    people = people.where(reach).withColumn("spread", spread)
    score = -F.col("d") * F.col("d") / (2 * F.col("spread") * F.col("spread")) - F.log(2 * math.pi * F.col("spread") * F.col("spread")) + math.log(s.room_m2)
    alike = likeness(F.col("look_t"), F.coalesce("here.look", F.when(F.col("here").isNull(), F.col("last_look"))))
    people = people.withColumn("alike", alike).where(F.coalesce(F.col("alike") >= UNLIKE, F.lit(True)))
    people = people.withColumn("score", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), score)) + F.coalesce("alike", F.lit(0.0)))
    w = Window.partitionBy("site", "t").orderBy(F.desc("score"), "person")
    best = people.withColumns({"rank": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rank = 1")
    need, margin = s.need + s.need_per_s * F.col("gap"), F.col("score") - F.greatest(F.lit(0.0), F.coalesce("second", F.lit(0.0)))
    taken = (F.col("score") >= need) & (margin >= s.margin) & (F.col("live") | (F.col("gap") <= ALONE_S) | F.coalesce(F.col("alike") >= LIKE, F.lit(False)))
    outcome = F.when(taken, "reacquired").when(F.col("score") >= s.pending, "ambiguous")
    previous = F.when(F.col("live"), F.col("here.m")).otherwise(F.col("lost_at.m"))
    return best.select("site", F.col("t").alias("key"), "tick", previous.alias("previous"), outcome.alias("outcome"), F.least(F.col("score") + 4 - need, margin + 4).alias("strength")).where("outcome is not null")


def resolve(rows: DataFrame, s: Settings = Settings(), log=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tracks, timeline, links of two cameras, and decisions on newly started tracks; see the module. ``log`` gets the number of repetitions."""
    keep = Rounds(rows.sparkSession, "people").keep
    rows = keep(with_looks(rows).select("site", "tick", "key", "camera", "x", "y", "sigma", "edge", "look"), "rows")
    who = keep(tracks(rows), "tracks")
    seen = keep(evidence(rows, near_pairs(rows, s), who, s), "evidence")
    cross = keep(cross_links(seen, s), "cross")
    decided, n = None, 0
    while True:
        links = cross
        if decided is not None:
            again = decided.where("outcome = 'reacquired'")
            links = cross.unionByName(again.select("site", F.col("previous").alias("a"), F.col("key").alias("b"), (F.col("tick") + 1).alias("begin"), F.lit(FOREVER).alias("until"), "strength"))
        known = keep(timeline(links, who, seen, s, keep), "timeline")
        now = keep(reacquired(rows, who, known, s), "decided")
        same = [x.select("site", "key", "previous", "outcome") for x in (now, decided)] if decided is not None else [now.select("key"), now.select("key").limit(0)]
        n += 1
        if same[0].exceptAll(same[1]).isEmpty() and same[1].exceptAll(same[0]).isEmpty():
            if log:
                log(n)
            return who, known, cross, now
        decided = now


def world(rows: DataFrame, s: Settings = Settings(), log=None) -> DataFrame:
    """site, tick, person, x, y, cameras, state, confidence, shown: the people of every tick, as known ``lag_s`` later."""
    who, known, _, decided = resolve(rows, s, log)
    lag, gone = round(s.lag_s / s.tick_s), round((s.occluded_s + s.exited_s) / s.tick_s)
    w = Window.partitionBy("site", "key").orderBy("tick")
    end = F.max("tick").over(Window.partitionBy("site"))
    rows = rows.select("site", "tick", "key", "camera", "x", "y", "sigma", F.coalesce(F.lead("tick").over(w), F.lit(FOREVER)).alias("next"), end.alias("over"))
    # a row also stands for the ticks after it, until the track is seen again or its person has left
    ticks = F.sequence(F.col("tick"), F.least(F.col("next") - 1, F.col("tick") + gone, F.col("over")))
    spread = rows.select("site", "key", F.col("tick").alias("from"), "camera", "x", "y", "sigma", F.explode(ticks).alias("tick"))
    unclear = decided.where("outcome = 'ambiguous'").select("site", "key", F.col("tick").alias("asked"))
    mine = spread.join(known.select("site", "key", "since", F.col("until"), "person", "strength"), ["site", "key"])
    mine = mine.where((F.col("since") <= F.col("tick") + lag) & (F.col("tick") + lag < F.col("until"))).join(who.select("site", "key", "ticks"), ["site", "key"]).join(unclear, ["site", "key"], "left")
    seen = F.col("from") == F.col("tick")
    weight = F.when(seen, 1 / (F.col("sigma") * F.col("sigma")))
    people = mine.groupBy("site", "tick", "person").agg(
        (F.sum(F.col("x") * weight) / F.sum(weight)).alias("fx"), (F.sum(F.col("y") * weight) / F.sum(weight)).alias("fy"), F.max_by(F.struct("x", "y"), F.struct("from", "key")).alias("last"),
        ((F.col("tick") - F.max("from")) * s.tick_s).alias("unseen"), F.array_join(F.array_sort(F.collect_set(F.when(seen, F.col("camera")))), ",").alias("cameras"),
        F.min("strength").alias("strength"), (F.sum("ticks") * s.tick_s).alias("observed"),
        F.coalesce(F.bool_or(F.col("tick").between(F.col("asked"), F.col("asked") + round(s.ambiguous_s / s.tick_s))), F.lit(False)).alias("unclear"),
    )
    sure = F.greatest(0.55 + 0.4 * F.least(F.lit(1.0), F.col("observed") / 3), 1 / (1 + F.exp(-(F.col("strength") - 4 + 1.5) / 1.2)))
    sure = sure * F.exp(-F.col("unseen") / 5)
    sure = F.round(F.when(F.col("unclear"), F.least(sure, F.lit(0.5))).otherwise(sure), 4)
    state = F.when(F.col("unclear"), "ambiguous").when(F.col("unseen") == 0, "active").when(F.col("unseen") <= s.occluded_s + 1e-9, "occluded").otherwise("exited")
    people = people.withColumns({"confidence": sure, "state": state})
    shown = F.when(F.col("state") == "exited", None).when(F.col("unclear"), "Needs confirmation").when(F.col("confidence") >= s.confirmed, "Confirmed").otherwise("Tracking")
    return people.select("site", "tick", "person", F.coalesce("fx", "last.x").alias("x"), F.coalesce("fy", "last.y").alias("y"), "cameras", "state", "confidence", shown.alias("shown"))


def audit(known: DataFrame, cross: DataFrame, decided: DataFrame) -> DataFrame:
    """site, tick, type, first, second: links made, revoked and blocked by a constraint, tracks re-acquired or unclear."""
    made = cross.select("site", F.col("begin").alias("tick"), F.lit("cross_camera_link").alias("type"), F.col("a").alias("first"), F.col("b").alias("second"))
    ended = cross.where(F.col("until") < FOREVER).select("site", F.col("until").alias("tick"), F.lit("link_revoked").alias("type"), F.col("a").alias("first"), F.col("b").alias("second"))
    again = decided.select("site", "tick", F.when(F.col("outcome") == "reacquired", "reacquired").otherwise("ambiguous_reacquisition").alias("type"), F.col("key").alias("first"), F.col("previous").alias("second"))
    whose = lambda side: known.select("site", F.col("key").alias(side), F.col("since").alias("s"), F.col("until").alias("u"), F.col("person").alias(f"person_{side}"))
    tied = made
    for side in ("first", "second"):
        tied = tied.join(whose(side), ["site", side]).where((F.col("s") <= F.col("tick")) & (F.col("tick") < F.col("u"))).drop("s", "u")
    blocked = tied.where("person_first <> person_second").select("site", "tick", F.lit("link_blocked").alias("type"), "first", "second")
    return made.unionByName(ended).unionByName(blocked).unionByName(again)
