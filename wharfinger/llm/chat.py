"""Logged conversations: snapshots that a longer one continues are dropped, the rest rendered.

A turn's hash depends on its place, role and text; the exclusive-or of a conversation's first
k hashes identifies its prefix of k turns. A conversation goes if its own hash is that of a
longer one's prefix, or of an equal one with a smaller id. Prefixes are made distinct before
they meet the conversations, so a first turn that many share is one row.

Defined results: turns are ordered by turn (null first), role and text; rows without conv_id
belong to no conversation and are left out; repeated rows are turns of their own; a null role
is rendered as "unknown", a null text as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def turn_hash(salt: int) -> Column:
    parts = [F.lit(salt), F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(*parts)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, and h1 and h2 of the turns up to pos."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    run = W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.bit_xor(turn_hash(k)).over(run))
    return rows.withColumn("n_turns", F.count(F.lit(1)).over(W.partitionBy("conv_id")))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_equal (how many conversations are equal to it) of those kept."""
    rows = prefixes(turns).select("conv_id", "pos", "n_turns", "h1", "h2")
    whole = rows.where("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    shorter = rows.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(shorter, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal and chat: the kept conversations with marked turns."""
    one = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = prefixes(turns).select("conv_id", "pos", one.alias("turn"))
    chats = rows.join(maximal(turns), "conv_id").groupBy("conv_id", "n_turns", "n_equal").agg(F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("t"))
    return chats.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_equal").cast("long").alias("n_equal"), F.array_join(F.col("t.turn"), "").alias("chat"))
