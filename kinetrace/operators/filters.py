"""Filters over regular grids, in stretches with halos.

A row has keys, an index ``i`` from 0 without holes, and ``n``, the number of rows of its key.  Rows are dealt into
stretches of ``STRETCH`` indices; those within the halo of a stretch are copied into it, the filter runs over (keys,
stretch) and the copies are cut off.  So no key, however long, is a single task's load, and the result is that of the
filter over the whole key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4096


def on_regular_grid(rows: DataFrame, keys: list[str], at: str, value: str, step: float, gap: float, tie: list[str] | None = None) -> DataFrame:
    """keys, i, n, y: linear interpolation at the first row's ``at`` + i * step; across gaps beyond ``gap`` along the index, ends extended.

    Grid points come from pairs of consecutive rows, so there is no join of a grid with rows.
    """
    w = Window.partitionBy(*keys).orderBy(at, *(tie or []))
    first = F.min(at).over(Window.partitionBy(*keys))
    pairs = rows.select(*keys, F.col(at).alias("t"), F.col(value).alias("x"), F.lead(at).over(w).alias("t2"), F.lead(value).over(w).alias("x2"), first.alias("t0"))
    place = lambda t: (t - F.col("t0")) / step
    low = F.ceil(place(F.col("t")) - 1e-9)
    high = F.when(F.col("t2").isNull(), F.floor(place(F.col("t")) + 1e-9)).otherwise(F.ceil(place(F.col("t2")) - 1e-9) - 1)
    points = pairs.withColumn("i", F.explode(F.when(high >= low, F.sequence(low, high))))
    ahead = F.col("t0") + F.col("i") * step - F.col("t")
    near = F.when(ahead <= 1e-9, F.col("x")).when(F.col("t2") - F.col("t") <= gap, F.col("x") + (F.col("x2") - F.col("x")) / (F.col("t2") - F.col("t")) * ahead)
    known = points.select(*keys, "i", near.alias("y"))
    n = known.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    good = known.where("y is not null").join(n, keys)
    w = Window.partitionBy(*keys).orderBy("i")
    good = good.select(*keys, "n", "i", "y", F.lag("i").over(w).alias("before"), F.lead("i").over(w).alias("after"), F.lead("y").over(w).alias("y2"))
    begin = F.when(F.col("before").isNull(), F.lit(0).cast("long")).otherwise(F.col("i"))  # the first one is extended to the front
    end = F.coalesce(F.col("after"), F.col("n")) - 1
    filled = good.select("*", F.explode(F.sequence(begin, end)).alias("at"))
    share = (F.col("at") - F.col("i")) / (F.col("after") - F.col("i"))
    y = F.when((F.col("at") <= F.col("i")) | F.col("after").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("y2") - F.col("y")) * share)
    return filled.select(*keys, F.col("at").alias("i"), "n", y.alias("y"))


def stretched(rows: DataFrame, halo: int, stretch: int = STRETCH) -> DataFrame:
    """``rows`` with ``_stretch``, once for each stretch whose bounds are at most ``halo`` away."""
    first, last = F.greatest(F.lit(0), F.floor((F.col("i") - halo) / stretch)), F.floor(F.least(F.col("n") - 1, F.col("i") + halo) / stretch)
    return rows.withColumn("_stretch", F.explode(F.sequence(first, last)))


def _filtered(rows: DataFrame, keys: list[str], halo: int, out: str, value, stretch: int) -> DataFrame:
    wide = stretched(rows, halo, stretch)
    return wide.withColumn(out, value(Window.partitionBy(*keys, "_stretch").orderBy("i"))).where(F.col("_stretch") == F.floor(F.col("i") / stretch)).drop("_stretch")


def polynomial_weights(size: int, degree: int) -> list[list[float]]:
    """For each place in a window of so many values the weights whose sum is the fitted polynomial there."""
    places = np.arange(size) - size // 2
    powers = np.vander(places, degree + 1)
    return (powers @ np.linalg.pinv(powers)).tolist()


def smoothed(rows: DataFrame, keys: list[str], value: str, out: str, size: int, degree: int = 2, stretch: int = STRETCH) -> DataFrame:
    """Adds the local least-squares polynomial; at the ends it is read off the first and last whole window.

    A key shorter than the window gets the widest odd window it has, one no wider than the degree stays as it is.
    """
    sizes = [s for s in range(1, size + 1, 2) if s > degree]
    weights = {s: polynomial_weights(s, degree) for s in sizes}

    def fitted(w) -> Column:
        def of(s: int) -> Column:
            half = s // 2
            start = F.greatest(F.lit(0), F.least(F.col("i") - half, F.col("n") - s))
            place = F.col("i") - start
            around = {o: F.lag(value, -o).over(w) if o < 0 else F.lead(value, o).over(w) for o in range(1 - s, s)}
            cases = [sum((F.lit(k) * around[j - p] for j, k in enumerate(row)), F.lit(0.0)) for p, row in enumerate(weights[s])]
            found = F.when(place == 0, cases[0])
            for p, case in enumerate(cases[1:], 1):
                found = found.when(place == p, case)
            return found

        out = F.when(F.col("n") < sizes[0], F.col(value))
        for s in sizes[:-1]:
            out = out.when(F.col("n") < s + 2, of(s))
        return out.otherwise(of(sizes[-1]))

    return _filtered(rows, keys, size - 1, out, fitted, stretch)


def rolling_median(rows: DataFrame, keys: list[str], value: str, out: str, size: int, stretch: int = STRETCH) -> DataFrame:
    """Adds the median of an odd number of values around each; the ends are repeated outward."""
    half = size // 2

    def median(w) -> Column:
        frame = w.rowsBetween(-half, half)
        missing = lambda have: F.greatest(F.lit(0), half - have).cast("int")
        values = F.concat(
            F.collect_list(value).over(frame),
            F.array_repeat(F.first(value).over(frame), missing(F.col("i"))), F.array_repeat(F.last(value).over(frame), missing(F.col("n") - 1 - F.col("i"))),
        )
        return F.array_sort(values)[half]

    return _filtered(rows, keys, half, out, median, stretch)


def rolling_mean(rows: DataFrame, keys: list[str], value: str, out: str, size: int, stretch: int = STRETCH) -> DataFrame:
    """Adds the mean of ``size`` values around each, one more before than after if that is even; the ends are repeated outward."""
    before, after = size // 2, size - 1 - size // 2

    def mean(w) -> Column:
        frame = w.rowsBetween(-before, after)
        ends = F.first(value).over(frame) * F.greatest(F.lit(0), before - F.col("i")) + F.last(value).over(frame) * F.greatest(F.lit(0), after - (F.col("n") - 1 - F.col("i")))
        return (F.sum(value).over(frame) + ends) / size

    return _filtered(rows, keys, max(before, after), out, mean, stretch)
