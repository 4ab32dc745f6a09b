"""Perspective rotation of multi-party dialogues.

For every participant the dialogue is rendered with that speaker as the assistant and the others as
users under their names; only the assistant's words count for the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import packed
from reelsift.operators.skew import broadcast_if_small, number_within, split_large_groups
from reelsift.session import materialise

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
INSTRUCTIONS = ("system",)  # roles that speak to all and are nobody's perspective
UNNAMED = "unknown"
PART_TURNS = 1024  # turns of a dialogue that become one row


def _escaped(text: Column) -> Column:
    """Text that cannot be taken for the template's own marks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")


def rotations(
    turns: DataFrame,
    part_turns: int = PART_TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, part, speaker, n_turns, text, mask, spans``: the whole dialogue for each participant.

    Participants are all who speak in the conversation, instructions aside. A dialogue of up to
    ``part_turns`` turns is one row for each of them, ``part`` 0. A longer one comes in parts of so many
    turns in their order, numbered from 0; every participant gets all parts, those in which they are silent
    too, and the instructions the dialogue opens with stand before each part.

    ``mask`` has 1 for each turn of the speaker and 0 for others; ``spans`` are the code points
    ``[begin, end)`` of the speaker's words with the end mark. ``n_turns`` counts the turns in ``text``.

    Turns come by number (null last), then role, then text. Null and blank roles are ``unknown``; null
    texts are empty. Null conversation ids are one conversation. Repeated rows stay. The marks of the
    template in a text or role are broken up. Other columns are not read.
    """
    given = packed(turns, (), _conv=conv_col, _turn=turn_col, _role=role_col, _text=text_col)
    role = F.trim(F.coalesce(F.col("_role").cast("string"), F.lit("")))
    named = given.select(
        F.coalesce(F.concat(F.lit("c"), F.col("_conv").cast("string")), F.lit("")).alias("_key"),
        "_conv", "_turn", F.when(role == "", UNNAMED).otherwise(_escaped(role)).alias("role"), _escaped(F.col("_text")).alias("text"),
    )
    instructs = F.array(*map(F.lit, INSTRUCTIONS))
    usual, long = split_large_groups(named, ["_key"], part_turns)
    in_order = F.array_sort(F.collect_list(F.struct(F.col("_turn").isNull().alias("last"), "_turn", "role", "text")))
    said = F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    speakers = F.array_except(F.array_distinct(F.transform("said", lambda t: t["role"])), instructs)
    whole = usual.groupBy("_key").agg(F.first("_conv").alias("_conv"), in_order.alias("said"))
    views = whole.select("_conv", F.lit(0).alias("part"), said.alias("said"), F.explode(speakers).alias("speaker"))
    if long is not None:
        views = views.unionByName(_long_views(long, part_turns, instructs))

    def head(t: Column) -> Column:
        own = t["role"] == F.col("speaker")
        return F.concat(
            F.lit(BEGIN),
            F.when(own, "assistant")
            .when(F.array_contains(instructs, t["role"]), t["role"])
            .otherwise(F.concat(F.lit("user name="), t["role"])),
            F.lit("\n"),
        )

    def add(state: Column, t: Column) -> Column:
        begin = state["n"] + F.char_length(head(t))
        end = begin + F.char_length(t["text"]) + len(END)
        span = F.struct(begin.alias("begin"), end.alias("end"))
        spans = F.when(t["role"] == F.col("speaker"), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("n"), spans.alias("spans"))

    none = F.array().cast("array<struct<begin:int,end:int>>")
    return views.select(
        F.col("_conv").alias("conv_id"),
        "part",
        "speaker",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda t: F.concat(head(t), t["text"], F.lit(END))), "").alias("text"),
        F.array_join(F.transform("said", lambda t: F.when(t["role"] == F.col("speaker"), "1").otherwise("0")), "").alias("mask"),
        F.aggregate("said", F.struct(F.lit(0).alias("n"), none.alias("spans")), add, lambda s: s["spans"]).alias("spans"),
    )


def _long_views(turns: DataFrame, part_turns: int, instructs: Column) -> DataFrame:
    """``_conv, part, said, speaker`` of conversations that do not fit into a row."""
    order = [F.col("_turn").asc_nulls_last(), F.col("role"), F.col("text")]
    placed = materialise(number_within(turns, ["_key"], order, "at"))
    part = F.floor((F.col("at") - 1) / part_turns).cast("int")
    parts = materialise(
        placed.groupBy("_key", part.alias("part")).agg(
            F.first("_conv").alias("_conv"), F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("said")
        )
    )
    turn = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    said = F.transform("said", turn)
    first_word = F.array_position(F.transform("said", lambda t: ~F.array_contains(instructs, t["role"])), True)
    opening = F.when(first_word == 0, said).otherwise(F.slice(said, F.lit(1), first_word.cast("int") - 1))
    openings = parts.filter("part = 0").select("_key", opening.alias("opening"))
    speakers = placed.filter(~F.array_contains(instructs, F.col("role"))).select("_key", F.col("role").alias("speaker")).distinct()
    opened = F.when(F.col("part") == 0, said).otherwise(F.concat("opening", said))
    return (
        parts.join(broadcast_if_small(openings), "_key")
        .join(broadcast_if_small(materialise(speakers)), "_key")
        .select("_conv", "part", opened.alias("said"), "speaker")
    )
