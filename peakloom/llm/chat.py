"""Chat formatting with the perspective of every participant.

For each participant of a conversation the dialogue is rendered with that
participant as the assistant and the others as named users. The result has one
row per (conversation, perspective, turn): the rendered segment, where it lies
in the dialogue's text, and the span that carries loss. Segments in order make
the whole text, so no conversation is ever gathered into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.shared import text_of

ASSISTANT = "<|assistant|>"
USER = ('<|user name="', '"|>')
END = "<|end|>\n"
UNNAMED = "unknown"
#: Turn numbers per block in which offsets are summed.
BLOCK = 1024


def _plain(text: Column) -> Column:
    """The text with every <| broken up, so that no message can forge a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _quoted(name: Column) -> Column:
    """A speaker's name as it stands in a header: quotes escaped and every |> broken up, so that no name can close the header."""
    return F.replace(F.replace(name, F.lit('"'), F.lit('\\"')), F.lit("|>"), F.lit("| >"))


def perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, seg_start, seg_end, mask_start, mask_end.

    Turns are ordered by number, then speaker, then text, nulls first; rows that repeat are turns of their own.
    Offsets count code points from the start of the rendered dialogue, ends are exclusive. The mask covers the
    assistant's message and its end marker and is empty (start = end) for other segments. A null speaker is called "unknown",
    a null text is empty, and rows without conversation id are one conversation. In names and texts each <| is
    rendered as < |, in the headers' names also |> as | > and a quote with a backslash; nothing else is altered.
    Offsets are summed in blocks of turn numbers and then over blocks, so one very long conversation spreads over
    many tasks.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        _plain(F.coalesce(F.col(role), F.lit(UNNAMED))).alias("speaker"), _plain(text_of(F.col(text))).alias("said"),
    )
    seats = rows.select(F.col("conv_id").alias("at"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER[0]), _quoted(F.col("speaker")), F.lit(USER[1])))
    seen = rows.join(seats, F.col("conv_id").eqNullSafe(F.col("at"))).select(
        "conv_id", "perspective", "turn", "speaker", "said", own.alias("own"),
        F.concat(head, "said", F.lit(END)).alias("segment"), F.char_length(head).alias("head"),
        F.floor(F.col("turn") / BLOCK).alias("block"),
    ).withColumn("len", F.char_length("segment").cast("long"))
    key = ["conv_id", "perspective"]
    sums = seen.groupBy(*key, "block").agg(F.sum("len").alias("total"))
    before = Window.partitionBy(*key).orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"b_{c}") for c in (*key, "block")], F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "said").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("upto", F.sum("len").over(inside)).join(
        base, F.expr(" and ".join(f"{c} <=> b_{c}" for c in (*key, "block")))
    )
    end = F.col("base") + F.col("upto")
    start = end - F.col("len")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "segment", start.alias("seg_start"), end.alias("seg_end"),
        F.when(F.col("own"), start + F.col("head")).otherwise(end).alias("mask_start"), end.alias("mask_end"),
    )
