"""Scalar functions shared by the plans: rounding, dates, labels, text keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds half toward plus infinity, as floor(x + 0.5)."""
    scale = 10.0**digits
    rounded = F.floor(x * scale + 0.5)
    return rounded.cast("long") if digits == 0 else rounded / scale


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def percent_change(now: Column, before: Column) -> Column:
    """Rounded percent, 0 where there was nothing before."""
    return F.coalesce(half_up(F.try_divide(100.0 * (now - before), F.nullif(before, F.lit(0)))), F.lit(0).cast("long"))


def weekday(day: Column) -> Column:
    """Monday is 0, for a day index whose day 0 is a Monday."""
    return F.pmod(day, F.lit(7)).cast("int")


def clock(seconds: Column) -> Column:
    """Minutes and seconds, as 3:07."""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def hour_label(hour: Column) -> Column:
    """5am, 12pm, 11pm."""
    h = F.pmod(hour, F.lit(24))
    twelve = F.when(F.pmod(h, F.lit(12)) == 0, 12).otherwise(F.pmod(h, F.lit(12)))
    return F.concat(twelve.cast("int").cast("string"), F.when(h < 12, "am").otherwise("pm"))


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(half_up(amount), 0))


def joined(words: Column, last: str = " and ") -> Column:
    """a, b and c."""
    n = F.size(words)
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.try_element_at(words, F.lit(1))).otherwise(F.concat(head, F.lit(last), F.try_element_at(words, F.lit(-1))))


def pretty(name: Column) -> Column:
    """Sentence case of words joined by _ or -."""
    words = F.lower(F.regexp_replace(name, "[_-]+", " "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1 << 30))


def exercise_id(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-\s]", "_")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no built-in for it."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def text_key(text: Column) -> Column:
    """Lower-case words of letters and digits, accents and apostrophes dropped."""
    plain = F.lower(F.regexp_replace(decomposed(text), "['’]", ""))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(text_key(a), F.lit(" | "), text_key(b))


def ramp(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear map through the knots, flat beyond their ends."""
    found = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        found = found.when(x <= x1, y0 + (x - x0) * (y1 - y0) / (x1 - x0))
    return found.otherwise(F.lit(knots[-1][1]))


def idle_label(days: Column) -> Column:
    return F.when(days.isNull(), "Never").when(days == 0, "Today").when(days == 1, "Yesterday").otherwise(F.format_string("%d days ago", days))
