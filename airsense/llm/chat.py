"""Chat formatting: every participant's view of a conversation.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant
and all others as named users. The rendering comes turn by turn: a segment of text with its place in
the whole and a mask that says which characters are trained on. Joined in order, the segments are
the dialogue. A conversation of any length is thus never gathered into one row; places are running
sums in two levels, over blocks of turns and within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airsense.llm.tables import read
from airsense.sources.stored import store

#: Turns of one block of running sums.
BLOCK = 512
SYSTEM = "system"


def header(speaker: Column, view: Column) -> Column:
    return F.when(speaker == SYSTEM, "<|system|>\n").when(speaker == view, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, position, role, segment, start, train_start, train_end, end.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored. Participants are the
    distinct roles of a conversation besides ``system``; a null role is the participant ``unknown``,
    a null text is empty. Turns are ordered by number (null last), then role and text; repeated rows stay. In
    the mask only the perspective's own words and their end mark are trained on: train_start to
    train_end, null for other turns. A conversation of system turns alone has no participant and no
    row.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(1 << 62)) / BLOCK))
    people = rows.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    views = rows.join(people, "conv_id").withColumn("head", header(F.col("role"), F.col("perspective")))
    views = views.withColumn("segment", F.concat("head", "text", F.lit("<|end|>\n"))).withColumn("size", F.length("segment").cast("long"))
    views = store(views, "chat-views")
    blocks = views.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "perspective", "block", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
    )
    order = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = views.select(
        "*", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("chars_in"), F.row_number().over(order).alias("number"),
    ).join(blocks, ["conv_id", "perspective", "block"])
    start = F.col("chars_before") + F.col("chars_in")
    own = F.col("role") == F.col("perspective")
    end = start + F.col("size")
    return placed.select(
        "conv_id", "perspective", "turn", (F.col("turns_before") + F.col("number") - 1).alias("position"),
        F.when(F.col("role") == SYSTEM, "system").when(own, "assistant").otherwise("user").alias("role"), "segment", start.alias("start"),
        F.when(own, start + F.length("head")).alias("train_start"), F.when(own, end - 1).alias("train_end"), end.alias("end"),
    )


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (SELECT t.conv_id, perspective, turn, speaker, text,
 CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
 FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id AND t.conv_id IS NOT NULL),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM v),
p AS (SELECT *, row_number() OVER w - 1 AS position, (sum(length(segment)) OVER w)::BIGINT AS "end" FROM s
 WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, position, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
 segment, "end" - length(segment) AS start, CASE WHEN speaker = perspective THEN "end" - length(segment) + length(head) END AS train_start,
 CASE WHEN speaker = perspective THEN "end" - 1 END AS train_end, "end" FROM p
"""
