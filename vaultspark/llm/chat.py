"""Chat formatting: the dialogue from the perspective of each of its participants.

For every participant the whole dialogue is rendered with that speaker as the assistant and all
others as named users. A rendering is a sequence of segments, one row each, with their places in
the rendered text and the places that the loss is taken on; so a dialogue of any length is never
gathered. Places come from prefix sums in two steps, within ranges of the sorted turns and over the
ranges' totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, skew_join, table

#: Roles that are nobody: they are rendered alike for every participant and never are the assistant.
SYSTEM = ("system",)
END = "<|end|>\n"


def rotate(turns: DataFrame, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """(conv_id, perspective, seq, turn, role, name, content, char_start, char_end, mask_start, mask_end).

    `turns` is (conv_id, turn, role, text) with any other columns left out. Every distinct role of a
    conversation that is not null or of `system` is a perspective. Segments stand by turn (null
    last), then role (null first), then the text's MD5; equal rows follow each other. `content` is
    the segment: `<|assistant|>`, `<|system|>` or `<|user:NAME|>`, the text, and the end mark. The
    mask covers the text and end mark of the perspective's own segments and is null elsewhere. A
    null text is empty, a null role is the user `unknown`; rows with a null conv_id take no part.
    Places count code points of the whole rendered dialogue. Texts of any length stay whole; an
    empty table gives no rows, nor does a conversation in which nobody takes part.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    nobody = F.col("speaker").isin(*system) if system else F.lit(False)
    people = rows.where(F.col("speaker").isNotNull() & ~nobody).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.coalesce(nobody, F.lit(False)), "system").otherwise("user")
    name = F.when(role == "user", F.coalesce("speaker", F.lit("unknown")))
    seen = skew_join(rows, people, "conv_id").withColumns({"role": role, "name": name, "own": own})
    head = F.when(F.col("role") == "user", F.concat(F.lit("<|user:"), "name", F.lit("|>"))).otherwise(F.concat(F.lit("<|"), "role", F.lit("|>")))
    seen = seen.withColumns({"head": F.length(head), "content": F.concat(head, "text", F.lit(END)), "tie": F.md5("text")})
    order = ["conv_id", "perspective", F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_first(), "tie"]
    dealt = seen.drop("text").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed, _ = materialize(dealt, "turns")
    group = ["conv_id", "perspective"]
    size = F.length("content")
    totals = placed.groupBy(*group, "part").agg(F.sum(size).alias("chars"), F.count("*").alias("rows"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "part", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    within = Window.partitionBy(*group, "part").orderBy(*order[2:])
    local = placed.withColumns({"n": F.row_number().over(within), "upto": F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0))})
    end = F.col("chars0") + F.col("upto")
    found = local.join(starts, [*group, "part"]).withColumns({"char_end": end, "char_start": end - size, "seq": (F.col("rows0") + F.col("n")).cast("long")})
    return found.select(*group, "seq", "turn", "role", "name", "content", "char_start", "char_end", F.when(F.col("own"), F.col("char_start") + F.col("head")).alias("mask_start"), F.when(F.col("own"), F.col("char_end")).alias("mask_end"))


def op1(spark, sf_dir: str) -> DataFrame:
    """All conversations, once for each of their participants."""
    return rotate(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH t AS (
  SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'
), s AS (
  SELECT conv_id, perspective, turn, speaker, text, coalesce(speaker = perspective, FALSE) AS own,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM t JOIN p USING (conv_id)
), h AS (
  SELECT *, CASE WHEN role = 'user' THEN coalesce(speaker, 'unknown') END AS name,
         CASE WHEN role = 'user' THEN '<|user:' || coalesce(speaker, 'unknown') || '|>' ELSE '<|' || role || '|>' END AS head FROM s
), c AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS content FROM h
), w AS (
  SELECT *, row_number() OVER o AS seq, CAST(sum(length(content)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end FROM c
  WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn ASC NULLS LAST, speaker ASC NULLS FIRST, md5(text))
)
SELECT conv_id, perspective, seq, turn, role, name, content, char_end - length(content) AS char_start, char_end,
       CASE WHEN own THEN char_end - length(content) + length(head) END AS mask_start, CASE WHEN own THEN char_end END AS mask_end
FROM w
"""
