"""State carried from row to row: forward fill, stitching, runs, the firm that "ditto" means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def carry_forward(df: DataFrame, value: Column, name: str, part: str, order: str) -> DataFrame:
    """The last value that is not null, up to and with the row."""
    w = W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def stitch(df: DataFrame, continues: Column, part: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """Joins rows that continue the one before (at most `gap` places above) into logical
    lines: part, the first place, how many rows, and the texts joined by a space."""
    w = W.partitionBy(part).orderBy(order)
    last = F.lag(order).over(w)
    starts = ~(continues & last.isNotNull() & (F.col(order) - last <= gap))
    island = F.sum(starts.cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = df.withColumn("_island", island).groupBy(part, "_island").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_l"))
    return rows.select(part, F.element_at("_l", 1)[order].alias(order), F.size("_l").cast("long").alias("n_lines"), F.array_join(F.col(f"_l.{text}"), " ").alias(text))


def runs(df: DataFrame, part: str, order: str, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive places."""
    island = F.col(order) - F.row_number().over(W.partitionBy(part).orderBy(order))
    out = df.select(part, order, island.alias("_i")).groupBy(part, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least).drop("_i")


def resolve_ditto(df: DataFrame, kind: str, name: str, part: str, order: str) -> DataFrame:
    """Rows of kind "ditto" take the last named one before them in their part; without one
    their kind is "none"."""
    before = W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    found = F.last(F.when(F.col(kind) == "named", F.col(name)), ignorenulls=True).over(before)
    out = df.withColumn("_f", found)
    ditto = F.col(kind) == "ditto"
    out = out.withColumn("resolved", F.when(F.col(kind) == "named", F.col(name)).when(ditto, F.col("_f")))
    return out.withColumn("resolved_kind", F.when(ditto & F.col("_f").isNotNull(), "named").when(ditto, "none").otherwise(F.col(kind))).drop("_f")
