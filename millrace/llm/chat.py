"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant, all others as named users and system turns as they are.  The result has one row per
(conversation, perspective, turn): the rendered segment, its place in the rendered dialogue and
the span that a loss mask leaves open (only the perspective's own words and their end marker).
Segments instead of one string per conversation keep memory bounded when one conversation holds a
large part of all rows: places come from a running sum inside blocks of turns and a second one
over block totals.

Defined results: a null or blank speaker is a user named ``unknown`` and no perspective; a null
text is empty; start markers inside a text are broken up, so that they cannot open a turn; turns
that tie are ordered by speaker and text; null conversation ids form one conversation; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = "<|im_start|>"
CLOSE = "<|im_end|>"
TURNS_PER_BLOCK = 128


def rotate_perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: str = "system",
) -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, start, mask_start, mask_end, end."""
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.nullif(F.trim(F.col(speaker_col)), F.lit("")), F.lit("unknown")).alias("speaker"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<\|im_", "<| im_").alias("said"),
    )
    people = (
        said.where(~F.col("speaker").isin(system, "unknown"))
        .groupBy("conv_id", "speaker")
        .agg(F.count(F.lit(1)).alias("own_turns"))
        .select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective"))
    )
    role = (
        F.when(F.col("speaker") == system, "system")
        .when(F.col("speaker") == F.col("perspective"), "assistant")
        .otherwise("user")
    )
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    rendered = (
        said.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv")))
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            F.floor(F.coalesce("turn", F.lit(0)) / TURNS_PER_BLOCK).alias("block"),
            role.alias("role"),
            name.alias("name"),
            F.length(head).cast("long").alias("head_length"),
            F.concat(head, "said", F.lit(f"{CLOSE}\n")).alias("segment"),
        )
        .withColumn("length", F.length("segment").cast("long"))
    )
    blocks = rendered.groupBy("conv_id", "perspective", "block").agg(F.sum("length").alias("block_length"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("perspective").alias("b_perspective"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("block_length").over(before), F.lit(0)).alias("block_start"),
    )
    inside = (
        Window.partitionBy("conv_id", "perspective", "block")
        .orderBy("turn", "speaker", "segment")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rendered.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(
        places,
        F.col("conv_id").eqNullSafe(F.col("b_conv"))
        & (F.col("perspective") == F.col("b_perspective"))
        & (F.col("block") == F.col("b_block")),
    )
    start = F.col("block_start") + F.col("inside")
    end = start + F.col("length")
    opened = start + F.col("head_length")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "role",
        "name",
        "segment",
        start.alias("start"),
        opened.alias("mask_start"),
        F.when(F.col("role") == "assistant", end - 1).otherwise(opened).alias("mask_end"),
        end.alias("end"),
    )
