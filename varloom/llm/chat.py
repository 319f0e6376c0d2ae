"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask lists the character spans that are trained on (the
assistant's words and the end mark). Context roles (system) are rendered as themselves and are no
participants.

Defined cases: a null role is the participant `unknown`; a null text is empty; turns are ordered by turn
(null first), then role, then text; repeated turns stay; a row without a conversation id is a dialogue of
its own; a dialogue of context roles only has no participant, so no row; an empty table gives none; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, n_turns, text, mask array<struct<start,end>>); one row per dialogue and participant."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        # an orphan turn is its own dialogue, so that null ids never form one group
        F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("orphan"),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("unknown")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("m"),
    )
    # one row per dialogue: the messages in order, and the speakers
    talks = rows.groupBy("conv_id", "orphan").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    talks = talks.withColumn("who", F.array_distinct(F.filter(F.transform("ms", lambda m: m["r"]), lambda r: ~r.isin(*context))))
    each = talks.select("conv_id", "orphan", F.explode("who").alias("perspective"), "ms").select("conv_id", "orphan", "perspective", F.posexplode("ms").alias("i", "m"))
    name = F.regexp_replace(F.col("m.r"), "[^\\p{L}\\p{N}_.-]+", "_")
    own = F.col("m.r") == F.col("perspective")
    head = F.when(own, F.lit("assistant")).when(F.col("m.r").isin(*context), F.col("m.r")).otherwise(F.concat(F.lit("user name="), name))
    each = each.select("conv_id", "orphan", "perspective", "i", own.alias("own"), F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat(F.col("m.x"), F.lit(CLOSE)).alias("body"))
    # where each body starts in the rendered text: running lengths, one newline after each message
    size = F.length("head") + F.length("body") + 1
    w = Window.partitionBy("conv_id", "orphan", "perspective").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", (F.coalesce(F.sum(size).over(w), F.lit(0)) + F.length("head")).cast("long"))
    part = F.struct("i", "head", "body", "own", "at")
    out = each.groupBy("conv_id", "orphan", "perspective").agg(F.array_sort(F.collect_list(part)).alias("ps"))
    span = lambda p: F.struct(p["at"].alias("start"), (p["at"] + F.length(p["body"])).alias("end"))
    return out.select(
        "conv_id", "perspective", F.size("ps").cast("long").alias("n_turns"),
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.transform(F.filter("ps", lambda p: p["own"]), span).alias("mask"),
    )
