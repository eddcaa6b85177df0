"""Conversations rebuilt from an event log, rendered and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.llm.chat import format_conversations, read_back
from sectorscope.llm.queries.registry import query, table

PROBE = "\\### Assistant: </turn> ok"
STREAMED_CHARS = 256


def conversation_log(conversations: DataFrame) -> DataFrame:
    """A log that leads to the table: each row a message, streamed in parts.

    Rows are messages in order of turn, role and text, so that rows that share a turn are
    told apart.  By a hash over all rows, one message in eight starts as a draft that an edit
    replaces, one in eight as a draft that is answered and then regenerated, which takes the
    answer back, and one event in five is delivered twice.  Events come in no order.  A
    message's sequence numbers start at 2^32 times its number: up to three of the draft, then the
    parts of its text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("_way", F.pmod(F.xxhash64("conv_id", "message"), F.lit(8)))
    edited, regenerated = F.col("_way") == 0, F.col("_way") == 1

    def event(at: Column, kind: Column, role: Column, text: Column, message: Column = F.col("message")) -> Column:
        seq = F.shiftleft("message", 32) + at
        return F.struct(
            seq.alias("seq"), message.alias("message"), kind.alias("kind"), role.alias("role"), text.alias("text")
        )

    nobody = F.lit(None).cast("string")
    draft = F.concat(F.lit("draft "), F.reverse(F.substring("text", 1, STREAMED_CHARS)))
    opened = event(F.lit(0), F.lit("start"), F.col("role"), draft)
    more = event(F.lit(1), F.lit("delta"), nobody, draft)
    answer = [
        event(F.lit(1), F.lit("start"), F.lit("user"), draft, F.col("message") + 1),
        event(F.lit(2), F.lit("delta"), nobody, draft, F.col("message") + 1),
    ]
    first = F.when(edited, "edit").when(regenerated, "regenerate").otherwise("start")
    given = F.when(~edited & ~regenerated, F.col("role"))
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STREAMED_CHARS}}}"), F.lit(0))
    parts = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(parts)
    streamed = F.transform(
        parts,
        lambda t, p: event(p + 3, F.when(p == 0, first).otherwise("delta"), F.when(p == 0, given), t),
    )
    events = (
        F.when(edited, F.concat(F.array(opened, more), streamed))
        .when(regenerated, F.concat(F.array(opened, *answer), streamed))
        .otherwise(streamed)
    )
    log = rows.select("conv_id", F.inline(events))
    twice = F.pmod(F.xxhash64("conv_id", "seq"), F.lit(5)) == 0
    log = log.withColumn("_copy", F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    log = log.sortWithinPartitions(F.xxhash64("seq", "conv_id", "_copy"))
    return log.select("conv_id", "seq", "message", "kind", "role", "text")


# What the rendering must say of each conversation; a backslash is added before each match of MARKS.
MARKS = r"\\|</turn>|###"
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), n AS (
  SELECT *, length(t) + len(regexp_extract_all(t, '{MARKS}')) AS text_chars,
         length(role) + len(regexp_extract_all(role, '{MARKS}|\n')) AS role_chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + role_chars + 1 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


@query(SQL)
def op4_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return read_back(format_conversations(conversation_log(rows.unionByName(probe))))
