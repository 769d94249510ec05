"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered with that speaker as ``assistant``, all others as
named users and system messages as they are; only the assistant's content and its end mark are trained on. A rendering
is a table of segments with character offsets, so a conversation of any length stays spread over tasks: messages are
range-partitioned in their order, lengths add up inside the parts first and then over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._shared import written

START, END = "<|im_start|>", "<|im_end|>\n"
#: Characters of a text by which messages of one turn and speaker are dealt to parts.
PREFIX = 64


def plain(text: Column) -> Column:
    """``text`` without the renderer's marks: a blank after their first character makes them ordinary text."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def rotate(conversations: DataFrame, system_roles: tuple[str, ...] = ("system",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, segment, seg_start, seg_end, train_start, train_end).

    One row for each participant (role that is not a system role) and message of a conversation; offsets count
    characters of the participant's rendering from 0. ``train_start`` = ``train_end`` = null where nothing is trained
    on. Messages are in order of turn (null first), speaker and text; a null role is the speaker ``unknown``, a null text
    is empty, a null conversation id is a conversation. Repeated rows are messages each. A conversation of system
    messages alone has no participant and no rows; an empty table gives an empty result; other columns are not read, so
    their names can't clash. A text of any length is one segment. Marks of the format inside of a text or a speaker's
    name become ordinary text (see ``plain``), and line ends of a name become blanks, so no message can end itself.
    """
    messages = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), plain(F.coalesce(F.col(text_col), F.lit(""))).alias("content")
    )
    # parts in order of the messages, however many of them have one turn or none; written, as ranges are sampled
    dealt = messages.repartitionByRange("conv_id", "turn", "speaker", F.substring("content", 1, PREFIX))
    messages = written(dealt.withColumn("block", F.spark_partition_id()), "messages")
    speakers = messages.filter(~F.col("speaker").isin(list(system_roles))).groupBy("conv_id", "speaker").agg(F.count("*").alias("_n"))
    speakers = written(speakers.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")), "speakers")
    seen = messages.join(speakers, messages["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")
    mine, system = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(list(system_roles))
    role = F.when(mine, "assistant").when(system, "system").otherwise("user")
    head = F.concat(F.lit(START), role, F.when(mine | system, F.lit("")).otherwise(F.concat(F.lit(" name="), F.translate(plain(F.col("speaker")), "\r\n", "  "))), F.lit("\n"))
    seen = seen.select("conv_id", "perspective", "turn", "speaker", "content", role.alias("role"), head.alias("head"), F.concat(head, F.col("content"), F.lit(END)).alias("segment"), "block")
    seen = seen.withColumn("n", F.length("segment").cast("long"))
    order = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "content")
    inside = written(seen.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")), "segments")
    line = Window.partitionBy("conv_id", "perspective").orderBy("block")
    blocks = inside.groupBy("conv_id", "perspective", "block").agg(F.sum("n").alias("total"))
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_perspective"), F.col("block").alias("_block"), (F.sum("total").over(line) - F.col("total")).alias("base"))
    same = inside["conv_id"].eqNullSafe(blocks["_conv"]) & (inside["perspective"] == blocks["_perspective"]) & (inside["block"] == blocks["_block"])
    placed = inside.join(blocks, same).withColumn("seg_start", F.col("base") + F.col("before"))
    mine = F.col("role") == "assistant"
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "role",
        "segment",
        "seg_start",
        (F.col("seg_start") + F.col("n")).alias("seg_end"),
        F.when(mine, F.col("seg_start") + F.length("head")).alias("train_start"),
        F.when(mine, F.col("seg_start") + F.col("n")).alias("train_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, spans) of renderings that fit a row each: whole texts and their trained spans."""
    parts = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("seg_start", "segment", "train_start", "train_end"))).alias("p"))
    trained = F.filter("p", lambda x: x["train_start"].isNotNull())
    return parts.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"), F.transform(trained, lambda x: F.struct(x["train_start"].alias("start"), x["train_end"].alias("end"))).alias("spans"))


def op5(spark, root):
    """Query op5_perspectives: every participant's rendering of every conversation."""
    return rotate(spark.read.parquet(f"{root}/conversations.parquet"))


SQL = """
WITH messages AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|im_', '< |im_') AS content FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM messages WHERE speaker <> 'system'
), seen AS (
  SELECT m.conv_id, perspective, turn, speaker, content,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM messages m JOIN speakers s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
), shaped AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || translate(replace(speaker, '<|im_', '< |im_'), chr(13) || chr(10), '  ') ELSE '' END || chr(10) AS head FROM seen
), segments AS (
  SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM shaped
), placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg_end FROM segments
)
SELECT conv_id, perspective, turn, speaker, role, segment, seg_end - length(segment) AS seg_start, seg_end,
       CASE WHEN role = 'assistant' THEN seg_end - length(segment) + length(head) END AS train_start,
       CASE WHEN role = 'assistant' THEN seg_end END AS train_end
FROM placed
"""
