"""Chat formatting with cumulative snapshots collapsed, in DataFrame operations only.

A log often holds a conversation again after each turn. The prefix hash of a conversation's first i turns is the
running exclusive-or of 128-bit hashes of (position, role, text), so it rolls from turn to turn in one window.
A conversation whose last prefix hash is a proper prefix of another one is dropped by an anti-join; of equal
conversations the one with the smallest id stays. What remains is rendered turn by turn.

Windows are per conversation and stream; prefixes are deduplicated before the anti-join, so a first turn or a
conversation that a third of the table repeats is one row there. Defined results: turns are ordered by turn,
role and text, null first, so ties and repeated rows have one order; null role or text renders as an empty
string; null ``conv_id`` is one conversation; an empty table gives no rows; other columns are ignored. One
conversation is one rendered string, so it has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos from 1, last, and the hash of the turns up to pos as h1, h2."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    rows = rows.withColumn("last", F.lead("pos").over(order).isNull())
    parts = ["pos", F.isnull("role"), "role", F.isnull("text"), "text"]
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.bit_xor(F.xxhash64(F.lit(k), *parts)).over(upto))
    return rows.select("conv_id", "pos", "last", "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no other one extends."""
    rows = stored(prefixes(turns), "chat-prefixes")
    whole = rows.filter("last").groupBy(F.col("pos").alias("n_turns"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = rows.filter("not last").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def chat_format(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered."""
    kept = maximal(turns)
    own = turns.select(F.col("conv_id").alias("_c"), F.struct("turn", "role", "text").alias("t"))
    rows = own.join(kept, F.col("_c").eqNullSafe(F.col("conv_id"))).groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    blank = lambda x: F.coalesce(x, F.lit(""))
    shown = F.transform("ts", lambda t: F.concat(F.lit(START), blank(t["role"]), F.lit("\n"), blank(t["text"]), F.lit(END + "\n")))
    return rows.select("conv_id", "n_turns", "n_copies", F.array_join(shown, "").alias("rendered"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, role, text,
    row_number() OVER w AS pos,
    lead(1) OVER w IS NULL AS last,
    string_agg(coalesce('r' || replace(replace(role, '\\', '\\\\'), '|', '\\p'), 'n') || '|' || coalesce('t' || replace(replace(text, '\\', '\\\\'), '|', '\\p'), 'n') || '|', '')
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS pre
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), whole AS (
  SELECT pre, min(conv_id) AS conv_id, max(pos) AS n_turns, count(*) AS n_copies FROM t WHERE last GROUP BY pre
), kept AS (
  SELECT * FROM whole WHERE pre NOT IN (SELECT pre FROM t WHERE NOT last)
)
SELECT k.conv_id, k.n_turns::INTEGER AS n_turns, k.n_copies,
  string_agg('{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10), '' ORDER BY pos) AS rendered
FROM kept k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
