"""Chat formatting by perspective rotation of conversations with several parties.

For every participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and all others as named users; the loss mask covers what the assistant says.  The
result has one row per (conversation, perspective, turn): the rendered segment, its character
range in the rendered dialogue, and the range to be learned (empty for others' turns), so a conversation of any length is
never gathered in one task.  ``dialogues`` joins the segments where conversations are short.

Start positions are running sums inside (conversation, perspective), computed over range
partitions (``with_cumulative_sums``), not in one window per conversation.

Defined cases: a null role speaks as ``unknown``; null text is the empty text; rows with a null
conv_id form one conversation of their own; null turns come first; turns of one number are
ordered by role, then text; repeated rows are rendered as often as they occur; a conversation
in which only ``context_roles`` speak has no perspective and gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import with_cumulative_sums

CONTEXT_ROLES = ("system",)
END = "<|end|>\n"


def perspectives(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """conv_id, speaker, turn, role, segment, seg_start, seg_end, mask_start, mask_end."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    # rows that are the same in everything stand once, with their number
    t = t.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_n"))
    t = t.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    cast = t.where(~F.col("role").isin(*context_roles)).select("_conv", F.col("role").alias("speaker")).distinct()
    own = F.col("role") == F.col("speaker")
    head = (F.when(own, F.lit("<|assistant|>\n"))
            .when(F.col("role").isin(*context_roles), F.concat(F.lit("<|"), "role", F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n"))))
    seen = t.join(cast, "_conv").withColumn("_head", head).withColumn("segment", F.concat("_head", "text", F.lit(END)))
    seen = seen.withColumn("_len", F.length("segment") * F.col("_n"))
    order = [F.col("turn"), F.col("role"), F.col("text")]
    done = with_cumulative_sums(seen, order, ["_len"], partition_cols=["_conv", "speaker"])
    size = F.length("segment")
    done = done.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("cum__len") - F.col("_len") + F.col("_k") * size
    return done.select(
        "conv_id", "speaker", "turn", "role", "segment", start.alias("seg_start"), (start + size).alias("seg_end"),
        F.when(own, start + F.length("_head")).otherwise(start + size).alias("mask_start"),
        (start + size).alias("mask_end"))


def dialogues(segments: DataFrame) -> DataFrame:
    """One row per (conv_id, speaker): the text and its learned ranges, for conversations that
    fit into one row."""
    g = segments.groupBy("conv_id", "speaker").agg(
        F.array_sort(F.collect_list(F.struct("seg_start", "segment", "mask_start", "mask_end"))).alias("s"))
    return g.select(
        "conv_id", "speaker", F.array_join(F.col("s.segment"), "").alias("text"),
        F.transform(F.filter("s", lambda x: x["mask_start"] < x["mask_end"]),
                    lambda x: F.struct(x["mask_start"], x["mask_end"])).alias("learned"))


PERSPECTIVES_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role NOT IN ('system')),
s AS (
  SELECT t.conv_id, c.speaker, t.turn, t.role, t.text,
         CASE WHEN t.role = c.speaker THEN '<|assistant|>' || chr(10)
              WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head
  FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM s),
r AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS seg_end FROM g)
SELECT conv_id, speaker, turn, role, segment, seg_end - length(segment) AS seg_start, seg_end,
       CASE WHEN role = speaker THEN seg_end - length(segment) + length(head) ELSE seg_end END AS mask_start,
       seg_end AS mask_end
FROM r
"""
