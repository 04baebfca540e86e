"""Preference formatting.  DataFrame functions only.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns (same role and
text) is rendered once as the prompt; what follows in each is its completion, with the places that a
loss is taken over: the text and end mark of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNT = "assistant"
END = "<|end|>"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(f"{END}\n"))


def _mask(turns: Column) -> Column:
    """start:stop of the learnt parts in the rendered turns, in code points, comma-joined; each turn knows what is rendered before it in its conversation."""
    base = F.get(turns, F.lit(0))["before"]
    start = lambda t: t["before"] - base + F.length(t["role"]) + 5
    spans = F.transform(F.filter(turns, lambda t: t["role"] == LEARNT), lambda t: F.concat_ws(":", start(t).cast("string"), (start(t) + F.length(t["text"]) + len(END)).cast("string")))
    return F.array_join(spans, ",")


def preferences(turns: DataFrame, pair: Column, is_chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask of rows that are turns.

    Turns go by number, then role and text, so that repeated numbers have one order; null numbers come
    first.  A null role or text counts as empty.  A pair of which one side is missing has an empty prompt and an
    empty completion on that side; equal conversations have two empty completions.  Turns with a null
    pair belong to no conversation and give no row, and those with a null side count for neither.  A row holds one pair's two conversations, which a
    model must read whole in any case.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # One shuffle by pair serves the sums and the two sides.
    dealt = turns.select(pair.alias("pair_id"), is_chosen.alias("is_chosen"), turn.alias("t")).filter(F.col("pair_id").isNotNull()).repartition("pair_id")
    # A rendered turn is 13 longer than its role and text.
    earlier = Window.partitionBy("pair_id", "is_chosen").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("t.role") + F.length("t.text") + len(END) + 6).over(earlier), F.lit(0))
    dealt = dealt.withColumn("t", F.struct("t.turn", "t.role", "t.text", before.alias("before")))
    side = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("t"))))
    both = dealt.groupBy("pair_id").agg(side(F.col("is_chosen")).alias("c"), side(~F.col("is_chosen")).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, False)
    both = both.withColumn("n_common", F.when(differs == 0, F.size("c")).otherwise(differs - 1).cast("int"))
    rest = lambda name: F.slice(F.col(name), F.col("n_common") + 1, F.size(name))
    joined = lambda part: F.array_join(F.transform(part, _rendered), "")
    return both.select(
        "pair_id", "n_common", joined(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        joined(rest("c")).alias("chosen"), joined(rest("r")).alias("rejected"), _mask(rest("c")).alias("chosen_mask"), _mask(rest("r")).alias("rejected_mask"),
    )


#: Neighbouring conversations are the pairs of the registered query: the even one is chosen.
SQL = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), both_sides AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i,
    (c.i IS NOT NULL AND r.i IS NOT NULL AND c.role = r.role AND c.text = r.text) AS same
  FROM (SELECT * FROM t WHERE side = 0) c FULL JOIN (SELECT * FROM t WHERE side = 1) r ON c.pair_id = r.pair_id AND c.i = r.i
), common AS (
  SELECT pair_id, CAST(coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS INTEGER) AS n_common FROM both_sides GROUP BY pair_id
), turns AS (
  SELECT t.pair_id, side, i, n_common, role, i <= n_common AS shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
    length(role) + 5 AS lead, length(text) + 7 AS learnt
  FROM t JOIN common ON t.pair_id = common.pair_id
), placed AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + lead AS start FROM turns
)
SELECT pair_id, any_value(n_common) AS n_common,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND shared), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND NOT shared), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND NOT shared), '') AS rejected,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + learnt AS BIGINT), ',' ORDER BY i) FILTER (side = 0 AND NOT shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + learnt AS BIGINT), ',' ORDER BY i) FILTER (side = 1 AND NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""
