"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant the dialogue is rendered with that speaker as assistant
and the others as named users; only the assistant's turns are trained on. A
rendered dialogue is kept as its segments, a row a turn, with offsets in the
whole: concatenated in order they are the text. So a conversation of any length
is spread over tasks. Offsets are running sums in two levels: inside chunks of
CHUNK turn numbers, and over the chunks' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import table

CHUNK = 256
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    """Text without a marker; every `<|` gets one more bar."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def plain(text: Column) -> Column:
    """The text that `escaped` was given."""
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def shown(speaker: Column) -> Column:
    """The speaker's name as markers carry it."""
    kept = F.regexp_replace(speaker, r"[^\p{L}\p{N}_.-]", "_")
    return F.when(kept == speaker, kept).otherwise(F.concat(kept, F.lit("~"), F.substring(F.md5(speaker.cast("binary")), 1, 8)))


def rotate(turns: DataFrame) -> DataFrame:
    """Segments of every (conversation, participant), from (conv_id, turn, role, text).

    Columns: conv_id, perspective, turn, speaker, segment, is_target, seg_start,
    mask_start, mask_end (characters, end exclusive; null outside targets).
    System turns keep their place in every rendering and are no participants; a
    null role speaks as `unknown`; a null text is empty. Turns of one number
    follow each other by role, then escaped text; null turns come first; repeated rows
    stay. A null conv_id is one conversation. Conversations of system turns
    alone, and empty tables, give no rows. Other columns are ignored.
    """
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        escaped(F.coalesce("text", F.lit(""))).alias("content"),
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).alias("chunk"),
    )
    parties = t.where("speaker <> 'system'").select(F.col("conv_id").alias("c1"), F.col("speaker").alias("perspective")).distinct()
    chunks = t.select(F.col("conv_id").alias("c2"), F.col("chunk").alias("k2")).distinct()
    views = chunks.join(parties, F.col("c2").eqNullSafe(F.col("c1"))).select("c2", "k2", "perspective")
    x = t.join(views, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("chunk") == F.col("k2"))).drop("c2", "k2")
    name = shown(F.col("speaker"))
    head = F.when(F.col("speaker") == F.col("perspective"), F.lit("<|assistant|>\n")).when(F.col("speaker") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    x = x.withColumn("head", head).withColumn("segment", F.concat("head", "content", F.lit(END))).withColumn("size", F.length("segment").cast("long"))
    inside = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "speaker", "content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy("conv_id", "perspective", "chunk").agg(F.sum("size").alias("total"))
    starts = totals.select(F.col("conv_id").alias("c3"), F.col("perspective").alias("p3"), F.col("chunk").alias("k3"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("chunk_start"))
    x = x.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    x = x.join(starts, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("perspective") == F.col("p3")) & (F.col("chunk") == F.col("k3")))
    seg = F.col("chunk_start") + F.col("within")
    target = F.col("speaker") == F.col("perspective")
    return x.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "segment",
        target.alias("is_target"),
        seg.alias("seg_start"),
        F.when(target, seg + F.length("head")).alias("mask_start"),
        F.when(target, seg + F.col("size")).alias("mask_end"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<||') AS content FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), x AS (
  SELECT t.*, p.perspective,
    CASE WHEN t.speaker = p.perspective THEN '<|assistant|>' || chr(10)
         WHEN t.speaker = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name=' || regexp_replace(t.speaker, '[^\\p{L}\\p{N}_.-]', '_', 'g')
           || CASE WHEN regexp_matches(t.speaker, '[^\\p{L}\\p{N}_.-]') THEN '~' || substr(md5(t.speaker), 1, 8) ELSE '' END || '|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, head || content || '<|end|>' || chr(10) AS segment FROM x
), o AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS seg_start FROM s
)
SELECT conv_id, perspective, turn, speaker, segment, speaker = perspective AS is_target, seg_start,
  CASE WHEN speaker = perspective THEN seg_start + length(head) END AS mask_start,
  CASE WHEN speaker = perspective THEN seg_start + length(segment) END AS mask_end
FROM o
"""
