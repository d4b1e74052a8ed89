"""Repeated records: removal within an issue, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def signature(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in order; dropDuplicates would keep any."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def without_husks(df: DataFrame, *fields: str) -> DataFrame:
    """Drops rows all of whose fields are empty."""
    full = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in fields]
    keep = full[0]
    for x in full[1:]:
        keep = keep | x
    return df.where(keep)


def removed_report(df: DataFrame, kept: DataFrame, file: str, k: int = 20) -> DataFrame:
    """Rows before, kept and removed of the k files that lost most."""
    a, b = df.groupBy(file).agg(F.count(F.lit(1)).alias("n")), kept.groupBy(file).agg(F.count(F.lit(1)).alias("kept"))
    out = a.join(b, file, "left").fillna(0, ["kept"]).withColumn("removed", F.col("n") - F.col("kept"))
    return out.orderBy(F.desc("removed"), file).limit(k)


def exact_repeats(df: DataFrame, file: str, text: str, least: int = 2) -> DataFrame:
    """Texts that a file holds `least` times or more (5: a reading loop)."""
    n = df.groupBy(file, text).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= least).withColumn("extra", F.col("n") - 1)


def key_repeats(df: DataFrame, text: str, *keys: str, needed: tuple[str, ...] = (), parts: int = 0) -> DataFrame:
    """Keys, without case, that occur with several texts; the needed keys (the first, if none is named) must be there.
    parts: partitions over which keys and texts are dealt before they are grouped, as texts hardly repeat."""
    named = [F.lower(F.trim(F.col(k).cast("string"))).alias(k) for k in keys]
    rows = df.select(*named, F.substring(text, 1, 100).alias("t"))
    for k in needed or keys[:1]:
        rows = rows.where(F.col(k) != "")
    if parts:
        rows = rows.repartition(parts, *keys, "t")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("n_texts"))
    return out.where("n >= 2 and n_texts > 1")
