"""Perspective rotation of dialogues with column functions only: each participant is the assistant once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
PART_CHARS = 1 << 18  # of messages to a part: well above what dialogues hold
SLOT_TURNS = 1024  # turn numbers sorted together
MARKS = 40  # characters counted for the marks around a message


def _safe(text: Column) -> Column:
    """Marks inside a text are broken up, so that no text can open or close a message."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def perspectives(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    part_chars: int = PART_CHARS, slot_turns: int = SLOT_TURNS,
) -> DataFrame:
    """One row per conversation, part and participant who speaks in it: conv_id, participant, part, n_turns, text, loss_spans.

    Participants are the speakers but ``system``.  For each, the dialogue is rendered with its own messages as
    ``assistant``, those of others as ``user name=<speaker>``, and system messages as ``system``; loss_spans
    are the (start, end) places, in characters of ``text``, of its own messages with their closing mark, to be
    learned from; all else is masked.

    A dialogue is one part, number 0, unless its messages exceed ``part_chars`` characters (text, speaker and ``MARKS`` each).
    Then a message belongs to the part that its first character falls into, so that no row grows with a conversation;
    a single message is never cut.  Later parts begin with the system messages the dialogue begins with, as far as part 0
    has them; n_turns counts these too.  A part in which a participant says nothing has nothing for it to learn, and gives no row.

    Messages are ordered by turn, speaker and text, null first.  A null speaker is an unnamed user and no participant; a null
    text is an empty message; repeated rows are repeated messages; rows without a conversation are left out.
    Conversations without participants, and empty tables, give no rows.  Other columns are ignored.  A task sorts
    the messages of ``slot_turns`` turn numbers of a conversation; their sizes are added up over the slots.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.col(speaker).cast("string").alias("speaker"), _safe(F.col(text)).alias("text"),
    ).filter("conv_id is not null")
    rows = rows.withColumn("slot", F.coalesce(F.floor(F.col("turn") / slot_turns), F.lit(-(1 << 62))).cast("bigint"))
    size = F.length("text") + F.coalesce(F.length("speaker"), F.lit(0)) + MARKS
    rows = rows.withColumn("size", size.cast("bigint"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "speaker", "text")]
    inside = Window.partitionBy("conv_id", "slot").orderBy(*order)
    above = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # one row per conversation and slot carries the characters and messages before the slot
    slots = rows.groupBy("conv_id", "slot").agg(F.sum("size").alias("chars"), F.count("*").alias("messages")).select(
        "conv_id", "slot", F.coalesce(F.sum("chars").over(above), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("messages").over(above), F.lit(0)).alias("messages"),
    )
    numbered = (
        rows.withColumn("_number", F.row_number().over(inside))
        .withColumn("_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .join(slots, ["conv_id", "slot"])
        .select(
            "conv_id", "speaker", "text", (F.col("messages") + F.col("_number")).alias("number"),
            F.floor((F.col("chars") + F.col("_before")) / part_chars).cast("int").alias("part"),
        )
    )
    parts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("number", "speaker", "text"))).alias("messages"))
    # the leading system messages of part 0: those numbered below its first other message
    is_system = lambda m: F.coalesce(m["speaker"] == SYSTEM, F.lit(False))
    others = F.filter("messages", lambda m: ~is_system(m))
    heads = parts.filter("part = 0").select(
        "conv_id",
        F.when(F.size(others) > 0, F.filter("messages", lambda m: m["number"] < F.get(others, 0)["number"])).otherwise(F.col("messages")).alias("head"),
    ).filter(F.size("head") > 0)
    later = parts.filter("part > 0").join(heads, "conv_id", "left").withColumn(
        "messages", F.when(F.col("head").isNull(), F.col("messages")).otherwise(F.concat("head", "messages"))
    )
    whole = parts.filter("part = 0").unionByName(later.select("conv_id", "part", "messages"))
    speakers = F.filter(F.array_distinct(F.col("messages")["speaker"]), lambda name: name.isNotNull() & (name != SYSTEM))

    def header(message: Column) -> Column:
        name = message["speaker"]
        return (
            F.when(name == F.col("participant"), F.lit("assistant"))
            .when(name == SYSTEM, F.lit(SYSTEM))
            .when(name.isNull(), F.lit("user"))
            .otherwise(F.concat(F.lit("user name="), _safe(name)))
        )

    pieces = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(OPEN), header(m), F.lit("\n")).alias("head"),
            F.concat(m["text"], F.lit(CLOSE)).alias("body"),
            F.coalesce(m["speaker"] == F.col("participant"), F.lit(False)).alias("own"),
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["head"])
        end = start + F.length(piece["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(piece["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda state: state["spans"])
    return (
        whole.withColumn("participant", F.explode(speakers))
        .withColumn("pieces", pieces)
        .select(
            "conv_id", "participant", "part", F.size("messages").cast("bigint").alias("n_turns"),
            F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
            spans.alias("loss_spans"),
        )
    )
