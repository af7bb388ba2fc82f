"""Chat formatting in budgeted windows, by DataFrame functions only.

Template.  A window is ``<s>`` turns ``</s>``; a turn is an opening mark, its text and
a closing mark:

    system [SYS] [/SYS]    user [INST] [/INST]    assistant [OUT] [/OUT]    any other role [ROLE=name] [/ROLE]

Inside texts & becomes &amp;, the < of <s> and </s> becomes &lt;, and the [ of a mark
becomes &#91;, so no text can close a turn, and the texts can be restored exactly.

Windows.  Prefix sums of the turns' tokens cut a conversation into turn-aligned spans:
turn t goes to cell floor((tokens up to and with t - 1) / span budget), and each cell
with turns is a window.  A window begins with the system turn, if the conversation
opens with one, and the turns before its span that fit the history budget, at most
back to the start of the previous window.  Repeated turns carry no loss; of the others
the assistant's texts do, so each target counts once.  No turn is ever cut.

Defined results: null text and null role count as empty; turns are ordered by turn,
then role, then text; repeated rows are turns of their own; null conv_ids are one
conversation.  Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_TOKENS, HISTORY_TOKENS, TARGET = 512, 256, "assistant"
_MARKS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
_TURN = r"(?s)\[(SYS|INST|OUT|ROLE=[^\]]*)\](.*?)\[/(?:SYS|INST|OUT|ROLE)\]"


def tokens_of(text: Column) -> Column:
    """Token estimate of a turn: a quarter of its UTF-8 bytes, and four for its marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.regexp_replace(text, "<(?=/?s>)", "&lt;")
    return F.regexp_replace(text, r"\[(?=/?(?:SYS|INST|OUT|ROLE))", "&#91;")


def unescaped(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&#91;", "["), ("&#93;", "]"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _mark(role: Column) -> Column:
    other = F.concat(F.lit("ROLE="), F.replace(escaped(role), F.lit("]"), F.lit("&#93;")))
    found = F.when(role == "system", "SYS").when(role == "user", "INST").when(role == "assistant", "OUT")
    return found.otherwise(other)


def chat_windows(turns: DataFrame, span_tokens: int = SPAN_TOKENS, history_tokens: int = HISTORY_TOKENS, target: str = TARGET) -> DataFrame:
    """One row per window: conv_id, window (from 1), formatted, loss (array of begin and end in code points), n_turns, n_repeated, tokens."""
    conversation = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("cost", tokens_of(F.col("text")))
    rows = rows.withColumn("i", F.row_number().over(conversation)).withColumn("upto", F.sum("cost").over(conversation.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = Window.partitionBy("conv_id").orderBy("i")
    cell = F.floor((F.col("upto") - 1) / span_tokens)
    rows = rows.withColumn("cell", cell).withColumn("opens", (F.coalesce(F.lag("cell").over(in_order), F.lit(-1)) != F.col("cell")).cast("int"))
    rows = rows.withColumn("own", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("last", F.max("own").over(whole)).withColumn("reached", F.max("upto").over(Window.partitionBy("conv_id", "own")))
    repeats = F.col("own") < F.col("last")
    later = (
        F.when(repeats & (F.col("i") == 1) & (F.col("role") == "system"), F.sequence("own", "last"))
        .when(repeats & (F.col("reached") - F.col("upto") + F.col("cost") <= history_tokens), F.array("own", F.col("own") + 1))
        .otherwise(F.array("own"))
    )
    placed = rows.withColumn("window", F.explode(later)).withColumn("repeated", F.col("window") != F.col("own"))
    mark, body = _mark(F.col("role")), escaped(F.col("text"))
    placed = placed.withColumn("opening", F.concat(F.lit("["), mark, F.lit("]"))).withColumn("body", body)
    placed = placed.withColumn("piece", F.concat("opening", "body", F.lit("[/"), F.regexp_extract(mark, "^(SYS|INST|OUT|ROLE)", 1), F.lit("]")))
    in_window = Window.partitionBy("conv_id", "window").orderBy("i")
    before = F.coalesce(F.sum(F.length("piece")).over(in_window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = F.lit(len("<s>")) + before + F.length("opening")
    counts = ~F.col("repeated") & (F.col("role") == target)
    placed = placed.withColumn("begin", begin).withColumn("span", F.when(counts, F.struct(F.col("begin"), (F.col("begin") + F.length("body")).alias("end"))))
    grouped = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("i", "piece", "span"))).alias("turns"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.col("repeated").cast("long")).alias("n_repeated"),
        F.sum("cost").alias("tokens"),
    )
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: t["piece"]), ""), F.lit("</s>"))
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return grouped.select("conv_id", "window", formatted.alias("formatted"), loss.alias("loss"), "n_turns", "n_repeated", "tokens")


def read_windows(windows: DataFrame) -> DataFrame:
    """Parses formatted windows: conv_id, window, turns (array of role and text, without repeated ones), targets (array of text)."""
    marks = F.regexp_extract_all("formatted", F.lit(_TURN), 1)
    texts = F.regexp_extract_all("formatted", F.lit(_TURN), 2)
    parsed = windows.select("*", F.arrays_zip(marks.alias("mark"), texts.alias("text")).alias("parsed"))
    named = F.create_map(*[F.lit(x) for role, mark in _MARKS.items() for x in (mark, role)])

    def turn(t: Column) -> Column:
        role = F.coalesce(F.try_element_at(named, t["mark"]), unescaped(F.substring(t["mark"], len("ROLE=") + 1, 1 << 30)))
        return F.struct(role.alias("role"), unescaped(t["text"]).alias("text"))

    fresh = F.slice("parsed", F.col("n_repeated").cast("int") + 1, F.size("parsed"))
    targets = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))
    return parsed.select("conv_id", "window", "formatted", F.transform(fresh, turn).alias("turns"), targets.alias("targets"))


def chat_report(windows: DataFrame) -> DataFrame:
    """What a reader of the windows finds for each conversation: turns, targets and sizes."""
    found = read_windows(windows).select(
        "conv_id",
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("wanted"),
        F.length("formatted").alias("size"),
    )
    whole = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "n", "said", "wanted", "size"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"))
    said = F.array_join(F.transform("w", lambda x: x["said"]), "")
    wanted = F.array_join(F.transform("w", lambda x: x["wanted"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(wanted).cast("long").alias("loss_chars"), F.sha2(wanted, 256).alias("loss_sha256"), "formatted_chars")
