"""Chat formatting by cumulative-snapshot collapse.

A chat log often holds one conversation several times, each time a turn longer.
Rolling hashes of every turn prefix find the logged conversations that are a
prefix of a longer one; an anti-join keeps the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"


def _element(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the values; null differs from every value."""
    flat = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *flat) for seed in (11, 23)]


def turn_prefixes(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> a row per turn with the rolling hash of the turns up to it.

    The hash of a prefix is the XOR of hashes of (position, role, text), so it
    is a running aggregate; positions make it depend on the order. Turns with
    one number are ordered by content hash; null numbers come first.
    """
    body = rows.select("conv_id", "turn", *[h.alias(n) for h, n in zip(_element(F.col("role"), F.col("text")), ("b1", "b2"))])
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "b1", "b2")
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = body.withColumn("pos", F.row_number().over(by_turn).cast("long")).withColumn("is_last", F.lead(F.lit(1)).over(by_turn).isNull())
    return placed.select(
        "conv_id", "pos", "is_last",
        F.bit_xor(F.xxhash64(F.lit(5), "pos", "b1")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(7), "pos", "b2")).over(so_far).alias("h2"),
    )


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_copies): conversations that no longer one starts with; of equal ones the smallest id."""
    prefixes = turn_prefixes(rows)
    whole = prefixes.where("is_last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = prefixes.where(~F.col("is_last")).select("pos", "h1", "h2").distinct()
    return whole.join(shorter, ["pos", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Collapse snapshots, then render: conv_id, n_turns, n_copies, rendered.

    n_copies counts the logged conversations equal to the kept one. Null role
    renders as `unknown`, null text as empty. Rows with a null conv_id are one
    conversation of their own. Repeated rows are turns like any other. Extra
    columns are ignored; an empty table gives an empty result.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    kept = maximal(rows).withColumnRenamed("conv_id", "kept_id")
    turns = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    b1, b2 = _element(F.col("role"), F.col("text"))
    listed = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", b1.alias("b1"), b2.alias("b2"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"),
        F.first("n_copies").alias("n_copies"),
    )
    shown = F.transform("turns", lambda t: F.concat(F.lit(TURN_OPEN), t["role"], F.lit("\n"), t["text"], F.lit(TURN_CLOSE)))
    return listed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(shown, "").alias("rendered"))


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'role': role, 'text': text} ORDER BY turn) AS turns
  FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:i] AS turns FROM c, range(1, n_turns) AS r(i)),
w AS (SELECT turns, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies FROM c GROUP BY turns)
SELECT conv_id, n_turns, n_copies,
       array_to_string(list_transform(turns, lambda t: '<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM w WHERE turns NOT IN (SELECT turns FROM p)
"""
