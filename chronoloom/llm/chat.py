"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, for every state, which roles may follow, and for every role the text before
and after a turn and which of the three parts count for the loss. A conversation whose turns walk
the machine is emitted as text segments with a loss flag each; any other one is emitted as one row
that says where it broke.

Defined results: turns are ordered by `turn`. A null role, text or turn, a role that the machine
doesn't know, and a turn number that occurs twice in a conversation (repeated rows too) are errors
at the first such row. An empty text is a turn with an empty segment. A conversation that ends in
a state that isn't final is whole but `complete` is false: its segments are emitted all the same.
Rows with a null conv_id are left out. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

TEMPLATE = {
    "begin": "<|startoftext|>",
    "start": "start",
    "final": ["assistant"],
    # state -> roles that may follow; a turn's role is the state after it
    "next": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    # role -> parts (kind, text or None for the turn's own text, loss)
    "parts": {
        "system": [("head", "<|system|>\n", False), ("body", None, False), ("tail", "<|end|>\n", False)],
        "user": [("head", "<|user|>\n", False), ("body", None, False), ("tail", "<|end|>\n", False)],
        "assistant": [("head", "<|assistant|>\n", False), ("body", None, True), ("tail", "<|end|>\n", True)],
    },
}


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, turn, role, part_no, part, text, loss, complete, error): segments in order.

    Concatenating text by (turn, part_no) gives the training string. A broken conversation has one
    row, with the turn and role at which it broke, a null text and an error.
    """
    base = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    whole = W.partitionBy("conv_id")
    before = F.when(F.row_number().over(order) == 1, F.lit(template["start"])).otherwise(F.lag("role").over(order))
    seen = base.withColumn("__state", before).withColumn("__last_turn", F.lag("turn").over(order)).withColumn("__n", F.row_number().over(order))
    legal = F.lit(False)
    for state, roles in template["next"].items():
        legal = legal | ((F.col("__state") == state) & F.col("role").isin(roles))
    error = (
        F.when(F.col("turn").isNull(), "null turn").when(F.col("turn") == F.col("__last_turn"), "repeated turn").when(F.col("role").isNull(), "null role")
        .when(~F.col("role").isin(list(template["parts"])), "unknown role").when(F.col("text").isNull(), "null text")
        .when(~F.coalesce(legal, F.lit(False)), "role out of order")
    )
    judged = seen.withColumn("__error", error).withColumn("__broke", F.min(F.when(F.col("__error").isNotNull(), F.col("__n"))).over(whole))
    judged = judged.withColumn("complete", F.last("role").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).isin(template["final"]))
    parts = F.lit(None)
    for role, how in template["parts"].items():
        segments = [F.struct(F.lit(i + 1).alias("part_no"), F.lit(k).alias("part"), (F.col("text") if t is None else F.lit(t)).alias("text"), F.lit(loss).alias("loss")) for i, (k, t, loss) in enumerate(how)]
        first = F.struct(F.lit(0).alias("part_no"), F.lit("begin").alias("part"), F.lit(template["begin"]).alias("text"), F.lit(False).alias("loss"))
        parts = F.when(F.col("role") == role, F.when(F.col("__n") == 1, F.array(first, *segments)).otherwise(F.array(*segments))).otherwise(parts)
    good = judged.where("__broke is null").withColumn("__s", F.explode(parts))
    good = good.select("conv_id", "turn", "role", F.col("__s.part_no").cast("long").alias("part_no"), "__s.part", "__s.text", "__s.loss", "complete", F.lit(None).cast("string").alias("error"))
    bad = judged.where("__n = __broke").select("conv_id", "turn", "role", F.lit(None).cast("long").alias("part_no"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("loss"), F.lit(False).alias("complete"), F.col("__error").alias("error"))
    return good.unionByName(bad)


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH s AS (
  SELECT conv_id, turn, role, text, row_number() OVER o AS n, lag(role) OVER o AS state, lag(turn) OVER o AS last_turn
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
e AS (
  SELECT *, CASE WHEN turn IS NULL THEN 'null turn' WHEN turn = last_turn THEN 'repeated turn' WHEN role IS NULL THEN 'null role'
    WHEN role NOT IN ('system', 'user', 'assistant') THEN 'unknown role' WHEN text IS NULL THEN 'null text'
    WHEN NOT coalesce(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN state IN ('system', 'assistant')
      WHEN role = 'assistant' THEN state = 'user' ELSE false END, false) THEN 'role out of order' END AS error
  FROM s),
b AS (
  SELECT *, min(CASE WHEN error IS NOT NULL THEN n END) OVER (PARTITION BY conv_id) AS broke,
    arg_max(role, n) OVER (PARTITION BY conv_id) = 'assistant' AS complete FROM e)
SELECT conv_id, turn, role, p.part_no::BIGINT AS part_no, p.part, p.text, p.loss, complete, NULL::VARCHAR AS error
FROM (
  SELECT *, unnest(list_filter([
    {'part_no': 0, 'part': 'begin', 'text': '<|startoftext|>', 'loss': false},
    {'part_no': 1, 'part': 'head', 'text': '<|' || role || '|>' || chr(10), 'loss': false},
    {'part_no': 2, 'part': 'body', 'text': text, 'loss': role = 'assistant'},
    {'part_no': 3, 'part': 'tail', 'text': '<|end|>' || chr(10), 'loss': role = 'assistant'}], lambda x: x.part_no > 0 OR n = 1)) AS p
  FROM b WHERE broke IS NULL)
UNION ALL
SELECT conv_id, turn, role, NULL, NULL, NULL, NULL, false, error FROM b WHERE n = broke
"""
