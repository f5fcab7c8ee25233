"""Chat formatting of preference pairs.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once, as the prompt; what follows is rendered for each side
as its completion, with a mask: the character ranges of the completion that a
loss may count (what the assistant says, up to and with the end mark).

Turns of both sides meet by an aggregate over (pair, turn), pairs by a second
one; a pair's turns are together only because its rendered text is one value.

Edge cases: repeated rows count once; several different rows of one turn are
rendered in order of role and text. A null text is empty, a null role is
"user"; rows without a pair or a turn number are left out. Template marks inside
texts are broken up. Sides that are equal throughout give a prompt and two empty
completions (``tied``); a side without turns gives an empty prompt and
completion. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
LEARNED = "assistant"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(turns: Column) -> Column:
    """Text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x["role"]), x["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """Ranges ``start:end`` of the assistant's words in ``render(turns)``, comma-joined."""
    def add(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(_head(x["role"]))
        end = start + F.length(x["text"]) + len(END)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["role"] == LEARNED, F.concat(a["out"], F.array(span)))
                        .otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
                       add, lambda a: F.array_join(a["out"], ","))


def _clean(turns: DataFrame, side: int) -> DataFrame:
    def safe(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    return turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull()).select(
        "pair_id", F.col("turn").cast("long").alias("turn"), F.lit(side).alias("side"),
        safe(F.coalesce("role", F.lit("user"))).alias("role"),
        safe(F.coalesce("text", F.lit(""))).alias("text"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both frames have pair_id, turn, role, text. One row per pair: prompt,
    chosen, rejected, their masks, the number of prompt turns and ``tied``."""
    rows = _clean(chosen, 0).union(_clean(rejected, 1)).distinct()

    def own(side: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("role", "text"))))

    turns = rows.groupBy("pair_id", "turn").agg(own(0).alias("c"), own(1).alias("r"))
    pairs = turns.groupBy("pair_id").agg(
        F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("split"),
        F.sort_array(F.collect_list(F.struct("turn", "c", "r"))).alias("t"))

    def said(side: str, keep) -> Column:
        return F.flatten(F.transform(F.filter("t", keep), lambda x: x[side]))

    split = F.col("split")
    parts = pairs.select(
        "pair_id", split.isNull().alias("tied"),
        said("c", lambda x: split.isNull() | (x["turn"] < split)).alias("p"),
        said("c", lambda x: x["turn"] >= split).alias("c"), said("r", lambda x: x["turn"] >= split).alias("r"))
    return parts.select(
        "pair_id", F.size("p").cast("long").alias("prompt_turns"), "tied", render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"),
        render(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def echo_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) made of plain conversations: the rejected side gives,
    as its last assistant reply, an echo of the last user turn before it (of
    nothing, if there is none). Conversations without an assistant turn make
    no pair."""
    t = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"),
                             "role", "text").where("turn is not null and pair_id is not null")
    last = t.where(F.col("role") == LEARNED).groupBy("pair_id").agg(F.max("turn").alias("last"))
    with_last = t.join(last, "pair_id")
    asked = with_last.where((F.col("role") == "user") & (F.col("turn") < F.col("last"))).groupBy("pair_id").agg(
        F.max(F.struct("turn", "text"))["text"].alias("echo"))
    upto = with_last.where(F.col("turn") <= F.col("last"))
    mine = (F.col("turn") == F.col("last")) & (F.col("role") == LEARNED)
    rejected = upto.join(asked, "pair_id", "left").withColumn(
        "text", F.when(mine, F.coalesce("echo", F.lit(""))).otherwise(F.col("text")))
    cols = ("pair_id", "turn", "role", "text")
    return upto.select(*cols), rejected.select(*cols)
