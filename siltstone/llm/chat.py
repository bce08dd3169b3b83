"""Chat formatting by cumulative-snapshot collapse; DataFrame functions only.

A logged conversation is often a snapshot: the same turns as a longer log, cut earlier. Every turn prefix gets
a rolling hash (two 64-bit hashes of position, role and text, summed over the turns so far as decimals; 128 bits
together). Whole conversations whose hash is a proper prefix of another are removed by an anti-join against the
distinct prefixes, equal ones keep the smallest id, and only what stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import table


def render(role, text):
    """One turn in the ChatML layout; a turn mark inside of role or text is parted by a space, so that no text opens or closes a turn."""
    plain = lambda c: F.replace(c, F.lit("<|im_"), F.lit("< |im_"))
    return F.concat(F.lit("<|im_start|>"), plain(role), F.lit("\n"), plain(text), F.lit("<|im_end|>\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text; other columns are ignored) -> conv_id, n_turns, text of each maximal conversation.

    Turns stand in order of turn (null last), role, text; null role or text is empty. Rows without conv_id are one
    conversation, kept as another's copy only if it has an id. Repeated rows are repeated turns. An empty table gives none.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    by_conv = W.partitionBy("conv_id")
    in_order = by_conv.orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rolling = lambda salt: F.sum(F.xxhash64(F.lit(salt), "pos", "role", "text").cast("decimal(20,0)")).over(by_conv.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    posed = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("pos", F.row_number().over(in_order)).drop("turn")
    prefixes = posed.select("conv_id", "pos", rolling("a").alias("h1"), rolling("b").alias("h2"), F.count("*").over(by_conv).cast("int").alias("n_turns"))
    whole = prefixes.where("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    kept = whole.join(proper, ["n_turns", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("kept"), "n_turns")
    rows = posed.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda t: render(t["role"], t["text"]))
    return rows.groupBy("conv_id").agg(F.max("n_turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("text"))


def op7_chat(spark, sf_dir):
    return collapse(table(spark, sf_dir, "conversations"))


#: The same in DuckDB, by the prefixes themselves.
SQL = r"""
WITH posed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations
), prefixes AS (
  SELECT conv_id, pos, n_turns,
         string_agg('[' || len(role) || '|' || role || '|' || text || ']', '') OVER (PARTITION BY conv_id ORDER BY pos) AS said,
         string_agg('<|im_start|>' || replace(role, '<|im_', '< |im_') || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS rendered
  FROM posed
), proper AS (SELECT DISTINCT pos, said FROM prefixes WHERE pos < n_turns)
SELECT min(conv_id) AS conv_id, n_turns, any_value(rendered) AS text
FROM prefixes p
WHERE pos = n_turns AND NOT EXISTS (SELECT 1 FROM proper q WHERE q.pos = p.n_turns AND q.said = p.said)
GROUP BY n_turns, said
"""
