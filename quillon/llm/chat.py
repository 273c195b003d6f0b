"""Multi-party chats from every participant's perspective, in DataFrame operations only.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant, all others as
named users, and loss masks on the assistant's turns. System turns stay system turns; the system is no participant.

Turns get their position in a conversation without gathering it: rows are range-partitioned, counted per
partition and conversation, and numbered within both. Dialogues longer than PIECE_TURNS are
rendered in pieces of that many turns, so that one conversation with a large share of all rows is many groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint

PIECE_TURNS = 256
SYSTEM = "system"
NAMELESS = "unknown"


def positioned(turns: DataFrame) -> DataFrame:
    """Add the 0-based `position` of each row within its conversation, by turn, speaker and text."""
    order = ["conv_id", "turn", "speaker", "content"]
    dealt = checkpoint(turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part", "conv_id").orderBy(*order[1:], "row")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "part").count().select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return dealt.withColumn("n", F.row_number().over(within)).join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("position", (F.col("n") - 1 + F.col("offset")).cast("long")).drop("row", "part", "n", "offset", "c", "p")


def perspectives(conversations: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """(conv_id, perspective, piece, n_turns, n_trained, text, mask) of conversations(conv_id, turn, role, text).

    text holds the piece's turns, each as a header, the content and an end mark; mask lists the [start, end) spans,
    in code points of text, on which loss is taken: the content and end mark of the perspective's own turns.
    A null or blank role is the participant 'unknown', a null text is empty, rows of a null
    conv_id are one conversation, null turns come first. Equal turns are ordered by speaker and text, and repeated rows are
    repeated turns. Markup within contents is broken by a space. Conversations with system turns only have no
    perspective; an empty table gives an empty result; other columns are ignored.
    """
    turns = positioned(
        conversations.select(
            "conv_id",
            "turn",
            F.when(F.trim(F.coalesce(F.col("role"), F.lit(""))) == "", NAMELESS).otherwise(F.trim("role")).alias("speaker"),
            F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"),
        )
    )
    who = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    name = F.replace(F.regexp_replace("speaker", r"[\s<>|]+", "_"), F.lit("<|"), F.lit("_"))
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    body = F.concat("content", F.lit("<|end|>\n"))
    said = seen.select("conv_id", "perspective", F.floor(F.col("position") / piece_turns).cast("long").alias("piece"), F.struct("position", own.alias("own"), head.alias("head"), body.alias("body")).alias("said"))
    pieces = said.groupBy("conv_id", "perspective", "piece").agg(F.sort_array(F.collect_list("said")).alias("said"))
    mask = F.aggregate(
        "said",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.char_length(s["head"]) + F.char_length(s["body"])).alias("at"),
            F.when(s["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.char_length(s["head"])).alias("start"), (a["at"] + F.char_length(s["head"]) + F.char_length(s["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return pieces.select(
        "conv_id",
        "perspective",
        "piece",
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda s: s["own"])).cast("long").alias("n_trained"),
        F.concat_ws("", F.transform("said", lambda s: F.concat(s["head"], s["body"]))).alias("text"),
        mask.alias("mask"),
    )
