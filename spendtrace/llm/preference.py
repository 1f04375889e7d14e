"""Preference formatting: one prompt and a pair of masked completions from chosen and rejected conversations.

The turns of each side are gathered in order, one row per pair. The longest
common prefix of turns (same role and text) is rendered once as the prompt; what
follows on each side is rendered as its completion, with the character spans of
assistant content to train on. Rendering marks every turn as
``<|role|>\\n text <|end|>\\n``.

DataFrame functions only. One shuffle gathers the turns of both sides of a pair;
a conversation is one training example and so one row.

Defined results: null roles and texts render as '' and equal each other. Turns
are ordered by number, then role and text (nulls first); repeated rows are
repeated turns. Rows with a null pair id belong to no pair. A pair with one side
missing has an empty prompt and an empty completion for that side. Where
one side is the start of the other, its completion is empty. Columns other than those named are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(a: Column, b: Column) -> Column:
    return a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shared = F.least(F.size(chosen), F.size(rejected))
    equal = F.transform(F.slice(F.arrays_zip(chosen.alias("c"), rejected.alias("r")), 1, shared), lambda p: _same(p["c"], p["r"]))
    first_other = F.array_position(equal, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(shared.cast("long")).cast("long")


def opening(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    closing = F.lit("<|end|>\n")
    return F.array_join(F.transform(turns, lambda t: F.concat(opening(t), F.coalesce(t["text"], F.lit("")), closing)), "")


def trained_spans(turns: Column) -> Column:
    """(start, end) in characters of the rendered turns: assistant texts with their end mark, the mark's newline left out."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.char_length(opening(turn)).cast("long")
        end = begin + F.char_length(F.coalesce(turn["text"], F.lit(""))).cast("long") + 7
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """From turns (pair_id, turn, role, text) of both sides: pair_id, common_turns, prompt, chosen, rejected and their spans."""
    columns = ["pair_id", F.col("turn").cast("long").alias("turn"), "role", "text"]
    both = chosen.select(*columns, F.lit(True).alias("good")).union(rejected.select(*columns, F.lit(False).alias("good")))
    turn = F.struct("turn", "role", "text")
    sides = both.where("pair_id is not null").groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("good"), turn))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col("good"), turn))).alias("r"),
    )
    split = sides.withColumn("common", common_turns(F.col("c"), F.col("r")))

    def tail(side: str) -> Column:
        # slice() wants a length, even where nothing is left.
        return F.slice(F.col(side), F.col("common").cast("int") + 1, F.size(side))

    return split.select(
        "pair_id",
        F.col("common").alias("common_turns"),
        rendered(F.slice(F.col("c"), F.lit(1), F.col("common").cast("int"))).alias("prompt"),
        rendered(tail("c")).alias("chosen"),
        rendered(tail("r")).alias("rejected"),
        trained_spans(tail("c")).alias("chosen_spans"),
        trained_spans(tail("r")).alias("rejected_spans"),
    )


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs for tables without preferences: (chosen, rejected) turns per conversation.

    The chosen side is the conversation up to its last assistant turn. The
    rejected side ends with the last assistant reply of the conversation with the
    next id instead. Conversations without an assistant turn or such a successor give no pair.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").where("pair_id is not null")
    # Of repeated turn numbers the one that sorts last counts; a maximum is combined before the shuffle.
    last = turns.where("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    following = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("other"))
    paired = last.select("pair_id", F.col("last.turn").alias("last_turn")).join(following, "pair_id")
    joined = turns.join(paired, "pair_id").where("turn <= last_turn")
    chosen = joined.select("pair_id", "turn", "role", "text")
    before = joined.where("turn < last_turn").select("pair_id", "turn", "role", "text")
    reply = paired.select("pair_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    return chosen, before.union(reply)
