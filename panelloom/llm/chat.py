"""Preference formatting: one prompt, two masked completions.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns (same
role and text at each place) is rendered once as the prompt; the rest of either is its
completion. Spans mark, in characters of a completion, what a model is trained on: the
content and end mark of the assistant's turns; the rest is masked.

Defined cases: null roles and texts count as empty; turns with equal numbers are ordered by
role and text; a pair without one side has status no_chosen or no_rejected, an empty
prompt and all of the other side as its completion; equal conversations have status same
and empty completions; rows with a null id are of no pair and are left out; an empty table
gives no pairs; further columns are not carried. A conversation is one row: its turns have
to fit in a task's memory, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, AFTER_ROLE, CLOSE, GAP = "<|im_start|>", "\n", "<|im_end|>", "\n"
TRAINED_ROLE = "assistant"


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '{AFTER_ROLE}', t.text, '{CLOSE}{GAP}')), '')".replace("\n", "\\n")


def _spans(turns: str) -> str:
    """Array of structs (start, end); offsets run along the turns."""
    head, tail = f"{len(OPEN) + len(AFTER_ROLE)} + length(t.role)", f"length(t.text) + {len(CLOSE)}"
    return f"""aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)),
      (a, t) -> named_struct('at', a.at + {head} + {tail} + {len(GAP)}, 'spans',
        if(t.role = '{TRAINED_ROLE}', array_append(a.spans, named_struct('start', a.at + {head}, 'end', a.at + {head} + {tail})), a.spans)),
      a -> a.spans)"""


def preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen boolean, turn, role, text) -> one row a pair: status, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = turns.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), turn))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("chosen"), turn))).alias("r")
    )
    both = "least(size(c), size(r))"
    k = f"if({both} = 0, 0, coalesce(nullif(array_position(transform(sequence(1, greatest(1, {both})), i -> c[i - 1].role = r[i - 1].role and c[i - 1].text = r[i - 1].text), false), 0) - 1, {both}))"
    pairs = pairs.withColumn("prompt_turns", F.expr(k).cast("long"))
    rest = {x: f"slice({x}, cast(prompt_turns as int) + 1, greatest(size({x}), 1))" for x in "cr"}
    status = F.expr("case when size(c) = 0 then 'no_chosen' when size(r) = 0 then 'no_rejected' when prompt_turns = size(c) and prompt_turns = size(r) then 'same' else 'ok' end")
    return pairs.select(
        "pair_id", status.alias("status"), "prompt_turns", F.expr(_rendered("slice(c, 1, cast(prompt_turns as int))")).alias("prompt"),
        F.expr(_rendered(rest["c"])).alias("chosen"), F.expr(_rendered(rest["r"])).alias("rejected"),
        F.expr(_spans(rest["c"])).alias("chosen_spans"), F.expr(_spans(rest["r"])).alias("rejected_spans"),
    )


def with_other_ends(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> preference pairs: a conversation is chosen over itself with its last trained turn from conversation conv_id ^ 1.

    Where either has no such turn the pair has no rejected side.
    """
    turns = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    last = turns.filter(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    ends = last.select("conv_id", F.col("last.turn").alias("at"), F.col("last.text").alias("own")).join(last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other")), "conv_id")
    is_last = (F.col("role") == TRAINED_ROLE) & F.col("turn").eqNullSafe(F.col("at")) & (F.col("text") == F.col("own"))
    rejected = turns.join(ends, "conv_id").withColumn("text", F.when(is_last, F.col("other")).otherwise(F.col("text")))
    both = [t.select(F.col("conv_id").alias("pair_id"), F.lit(chosen).alias("chosen"), "turn", "role", "text") for t, chosen in ((turns, True), (rejected, False))]
    return both[0].unionAll(both[1])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation, paired with itself under another's end; spans as text, start-end by commas."""
    turns = with_other_ends(table(spark, sf_dir, "conversations"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return preferences(turns).select("pair_id", "status", "prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


def _sql() -> str:
    side = lambda s: f"coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE side = '{s}' AND pos > k), '')"
    spans = lambda s: f"coalesce(string_agg(CAST(CAST(before + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(before + head + length(text) + {len(CLOSE)} AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE side = '{s}' AND pos > k AND role = '{TRAINED_ROLE}'), '')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, turn, text FROM turns WHERE role = '{TRAINED_ROLE}' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) = 1
), sides AS (
  SELECT conv_id AS pair_id, 'c' AS side, turn, coalesce(role, '') AS role, text FROM turns UNION ALL
  SELECT t.conv_id, 'r', t.turn, coalesce(t.role, ''), CASE WHEN t.role = '{TRAINED_ROLE}' AND t.turn IS NOT DISTINCT FROM e.turn AND t.text = e.text THEN o.text ELSE t.text END
  FROM turns t JOIN ends e ON t.conv_id = e.conv_id JOIN ends o ON o.conv_id = xor(e.conv_id, 1)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS pos FROM sides
), n AS (
  SELECT pair_id, count(*) FILTER (WHERE side = 'c') AS nc, count(*) FILTER (WHERE side = 'r') AS nr FROM t GROUP BY pair_id
), diff AS (
  SELECT a.pair_id, min(a.pos) - 1 AS k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 'c' AND b.side = 'r'
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
), pre AS (
  SELECT n.pair_id, nc, nr, CAST(coalesce(k, least(nc, nr)) AS BIGINT) AS k FROM n LEFT JOIN diff ON n.pair_id = diff.pair_id
), b AS (
  SELECT t.*, nc, nr, k, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS body, {len(OPEN) + 1} + length(role) AS head FROM t JOIN pre ON t.pair_id = pre.pair_id
), o AS (
  SELECT *, coalesce(sum(CASE WHEN pos > k THEN length(body) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b
)
SELECT pair_id, CASE WHEN any_value(nc) = 0 THEN 'no_chosen' WHEN any_value(nr) = 0 THEN 'no_rejected' WHEN any_value(k) = any_value(nc) AND any_value(k) = any_value(nr) THEN 'same' ELSE 'ok' END AS status,
       any_value(k) AS prompt_turns, coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos <= k), '') AS prompt,
       {side("c")} AS chosen, {side("r")} AS rejected, {spans("c")} AS chosen_spans, {spans("r")} AS rejected_spans
FROM o GROUP BY pair_id
"""


SQL = _sql()
