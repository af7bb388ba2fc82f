"""Streams: sessions, tumbling ticks, lagged emission, hysteresis counting.

Each has a batch twin on the same rows, which the tests compare.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetrace.operators.identity import Resolver


def tick_counts(events: DataFrame, ts: str, tick: str, lag: str, keys: list[str]) -> DataFrame:
    """Rows by tumbling tick, emitted when the watermark has passed ``lag`` beyond it."""
    return events.withWatermark(ts, lag).groupBy(F.window(ts, tick), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, ts: str, gap: str, lag: str, keys: list[str]) -> DataFrame:
    """Sessions that end after a gap without rows."""
    grouped = events.withWatermark(ts, lag).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def first_seen(events: DataFrame, ts: str, lag: str, keys: list[str]) -> DataFrame:
    """One row for each key within the lag."""
    return events.withWatermark(ts, lag).dropDuplicatesWithinWatermark(keys)


def hysteresis(state: tuple[bool, int], values: Iterator[float], low: float, high: float) -> tuple[bool, int]:
    """Flexed below ``low``; back above ``high`` counts one repetition."""
    flexed, reps = state
    for v in values:
        if not flexed and v < low:
            flexed = True
        elif flexed and v > high:
            flexed, reps = False, reps + 1
    return flexed, reps


def count_repetitions(angles: DataFrame, low: float, high: float) -> DataFrame:
    """Running repetitions of each key from a stream (key long, t double, angle double); rows of a batch are taken in order of t."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flexed, reps = state.get if state.exists else (False, 0)
        rows = pd.concat(list(batches)).sort_values("t")
        flexed, reps = hysteresis((flexed, reps), rows.angle, low, high)
        state.update((flexed, reps))
        yield pd.DataFrame({"key": [key[0]], "t": [rows.t.iloc[-1]], "reps": [reps]})

    grouped = angles.groupBy("key")
    return grouped.applyInPandasWithState(step, "key long, t double, reps long", "flexed boolean, reps long", "update", GroupStateTimeout.NoTimeout)


def count_repetitions_batch(angles: DataFrame, low: float, high: float) -> DataFrame:
    """The same for a table, with windows: a repetition is a crossing above ``high`` whose last crossing before was below ``low``."""
    w = Window.partitionBy("key").orderBy("t")
    side = F.when(F.col("angle") < low, -1).when(F.col("angle") > high, 1)
    before: Column = F.last("side", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = angles.withColumn("side", side).withColumn("before", before)
    return rows.groupBy("key").agg(F.count_if((F.col("side") == 1) & (F.col("before") == -1)).alias("reps"))


def lifecycle(observed: DataFrame, now: Column, occluded_s: float = 5.0, exited_s: float = 2.0) -> DataFrame:
    """State of each identity from when it was last observed: active, occluded, exited; confidence falls with absence."""
    unseen = now - F.col("last_t")
    state = F.when(unseen <= 0, "active").when(unseen <= occluded_s, "occluded").when(unseen <= occluded_s + exited_s, "exited")
    faded = F.round(F.when(unseen <= 0, F.col("confidence")).otherwise(F.col("confidence") * F.exp(-unseen / 5)), 6)
    return observed.withColumn("state", state).withColumn("confidence", faded).where("state is not null")


PEOPLE = "site string, tick long, person long, x double, y double, cameras string, state string, confidence double, shown string"


EVENTS = "site string, tick long, type string, first string, second string"


def on_each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs ``action`` on every batch of what there is now; the rows stay on the executors unless the action asks for them.

    A batch may come twice after a failure, with the same number, so an action should overwrite by that number.
    """
    return stream.writeStream.foreachBatch(action).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _advance(resolver: Resolver, waiting: pd.DataFrame, upto: float) -> tuple[pd.DataFrame, list[dict]]:
    """Steps through the waiting ticks up to one; what is later still waits, what comes too late is an event."""
    late = waiting.tick <= resolver.now
    resolver.events += [(int(t), "late_row", k) for t, k in zip(waiting.tick[late], waiting.key[late])]
    waiting = waiting[~late]
    ready = waiting[waiting.tick <= upto].sort_values(["tick", "key"])
    people = []
    for tick, at in ready.groupby("tick"):
        people += resolver.step(int(tick), list(at[["key", "camera", "x", "y", "sigma", "edge"]].itertuples(index=False, name=None)))
    return waiting[waiting.tick > upto], people


def resolve_identities(observations: DataFrame, emit: str = "people", slack: int = 1) -> DataFrame:
    """People, or with ``emit="events"`` links, merges and splits, of a stream of observations (site, tick, key, camera, x, y, sigma, edge).

    A site is the unit of state.  A tick is resolved when rows ``slack`` ticks later have come, so rows of a tick may be
    dealt over batches; a row that comes later still is a ``late_row`` event.  A row without a tick ends its site's
    recording: the ticks inside the resolver's lag are given out, and the site's state goes.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        resolver, waiting = pickle.loads(bytes(state.get[0])) if state.exists else (Resolver(), None)
        waiting = pd.concat([*([waiting] if waiting is not None else []), *batches], ignore_index=True)
        ended = waiting.tick.isna().any()
        waiting = waiting[waiting.tick.notna()]
        waiting, people = _advance(resolver, waiting, np.inf if ended else waiting.tick.max() - slack)
        if ended:
            people += resolver.finish()
        found = [(key[0], tick, kind, *[x if x is None else str(x) for x in (*rest, None, None)[:2]]) for tick, kind, *rest in resolver.events]
        resolver.events.clear()
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps((resolver, waiting)),))
        if emit == "events":
            yield pd.DataFrame(found, columns=["site", "tick", "type", "first", "second"])
        else:
            out = pd.DataFrame(people, columns=["tick", "person", "x", "y", "cameras", "state", "confidence", "shown"])
            out.insert(0, "site", key[0])
            yield out

    schema = EVENTS if emit == "events" else PEOPLE
    return observations.groupBy("site").applyInPandasWithState(step, schema, "resolver binary", "append", GroupStateTimeout.NoTimeout)
