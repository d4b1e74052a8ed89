"""Mixing sources to target weights.

Each document gets a hash-random key. Its bucket is a range of keys within its source, so
buckets are in key order and no source, however large, meets in one task: sizes are summed
for each (source, bucket), those sums are accumulated over a source's buckets, and the
running sum within a bucket is added. Where the running sum of a source meets its budget,
the mix is cut; a budget above the source's size takes whole epochs first.

Defined results: null text has size 0; a null source is a source of its own, last in order;
ties of keys fall by doc_id, size and a hash of the text; repeated rows are taken each for itself; a row
without doc_id has the key of its text, so that such rows spread; rows that repeat a doc_id share its key; texts
of any length count whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wharfinger.llm.scratch import Scratch

BUCKET_ROWS = 8192


def word_count(text: Column) -> Column:
    """Number of maximal runs without 0x20 and 0x09-0x0D: places where a run begins."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t-\r]+", "w")
    return (F.length(plain) - F.length(F.replace(plain, F.lit("w"), F.lit("")))).cast("long")


def random_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """60 bits of an md5 of the doc_id, or of the text where there is none; another engine can repeat the draw."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name).cast("binary")), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds target: weight times a common level, but at most `most` times source_size; the
    targets add up to share times all sizes, as far as the caps let them. One row a source
    comes in, so the ordered windows see as many rows as there are sources."""
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sources.withColumn("_cap", cap).withColumn("_ratio", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    everything, up_to = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("_ratio").rangeBetween(W.unboundedPreceding, W.currentRow)
    level = F.try_divide(F.col("_goal") - (F.sum("_cap").over(up_to) - F.sum("_cap").over(W.partitionBy("_ratio"))), F.sum("weight").over(everything) - F.sum("weight").over(up_to) + F.sum("weight").over(W.partitionBy("_ratio")))
    ranked = ranked.withColumn("_goal", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("_level", level)
    ranked = ranked.withColumn("_final", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("weight") * F.col("_final"), F.col("_cap")))
    return ranked.withColumn("target", target).select(*sources.columns, "target")


def cycled_weights(sources: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Adds weight: the sources in code-point order, null last, take the weights in turn."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def plan_mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole passes that take the document)
    and part (words that the last pass takes of it), with docs' column _row if it has one.

    weights: (source, weight); without it sources take 5, 2, 1 in turn."""
    row = [c for c in docs.columns if c == "_row"]
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("_key"), F.xxhash64("text").alias("_digest"), *row)
    slim = Scratch(docs.sparkSession).save(sized.select("doc_id", "source", "_size", "_key", "_digest"), "sizes")  # words are counted once
    if not row:
        sized = slim
    totals = slim.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        totals = cycled_weights(totals)
    else:
        given = weights.select(F.col("source").alias("_s"), "weight")
        totals = totals.join(given, totals["source"].eqNullSafe(given["_s"]), "left").drop("_s").fillna(0.0, ["weight"])
    goals = water_fill(totals, share, most).withColumn("_buckets", F.ceil(F.col("_rows") / F.lit(bucket_rows)))
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target", "_buckets")
    placed = sized.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("_bucket", F.floor(F.col("_key") / F.lit(2.0**60) * F.col("_buckets")))
    sums = slim.join(goals, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_bucket", F.floor(F.col("_key") / F.lit(2.0**60) * F.col("_buckets")))
    sums = sums.groupBy(F.col("source").alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("_size").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_sum")).drop("_sum")
    inner = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "_size", "_digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = placed.withColumn("_in", F.sum("_size").over(inner) - F.col("_size"))
    run = run.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("_before") - F.col("_in")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), left)).cast("long")
    return run.withColumn("epochs", epochs).withColumn("part", part).withColumnRenamed("_size", "size").drop("_key", "_digest", "_buckets", "_bucket", "_in", "_s", "_b", "_before")


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words that the mix takes."""
    plan = plan_mix(docs.select("doc_id", "source", "text"), **how)
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return plan.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, docs' columns: a row for each time that a document is taken. The one
    document of a source at which its budget ends is cut after its last word within budget."""
    plan = plan_mix(docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), **how)
    whole = F.when(F.col("epochs") > 0, F.array_repeat(F.col("size"), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<bigint>"))
    rows = plan.select("_row", "size", F.explode(F.concat(whole, F.filter(F.array("part"), lambda x: x > 0))).alias("take"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.concat(F.lit(" "), "_row.text"), F.lit(r"[ \t-\r]+[^ \t-\r]+"), F.lit(0)), 1, F.col("take").cast("int")), "")
    text = F.when(F.col("take") < F.col("size"), F.substr(first, F.lit(2))).otherwise(F.col("_row.text"))
    rows = rows.select("_row", text.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
