"""Importance resampling towards a target text by hashed n-grams.

The words of a text are exploded with their places; over a document's rows lead() puts the
following words behind each, one order of n-gram after the other, and each n-gram is hashed to
a bucket. A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, in
thousandths. A document's weight is the mean gain of its n-grams; with Gumbel noise drawn from its id it is
a score, and the highest scores are a sample without replacement in proportion to exp(weight).

Texts are dealt by row before they are exploded, so the words of a document are together without
another shuffle and n-grams never leave their task but as counts by bucket and sums by document.
The gains, one row a bucket, are broadcast: BUCKETS bounds them. Ranks come from a sort by ranges.

Defined results: null or wordless text has no n-grams, weight 0; a null doc_id draws its noise as the
empty id and comes last among ties; rows that repeat a doc_id are documents of their own; ties of all
returned columns may fall either way; an empty target or corpus leaves the smoothed shares alone; texts of
any length are read whole, one document's words in one task.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wharfinger.llm.running import running
from wharfinger.llm.scratch import Scratch, free_name

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDERS, BUCKETS = 2, 10_000


def grams(texts: DataFrame, keys: list[str], orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """keys, bucket of each n-gram, and word (it is a single word), for texts with _row, a number
    of its own for each row; a text without words has one row with a null bucket."""
    low = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    dealt = texts.select("_row", *keys, "text").repartition("_row")
    words = dealt.select("_row", *keys, F.posexplode_outer(F.regexp_extract_all(low, F.lit(WORD), F.lit(0))).alias("_pos", "_word"))
    place = W.partitionBy("_row").orderBy("_pos")
    runs = [F.col("_word")]
    for k in range(1, orders):
        runs.append(F.concat(runs[-1], F.lit(" "), F.lead("_word", k).over(place)))  # null beyond the last word
    words = words.select("_row", *keys, F.array(*runs).alias("_runs"))
    flat = words.select("_row", *keys, F.posexplode("_runs").alias("_order", "_gram")).where("_gram is not null or _order = 0")
    return flat.select("_row", *keys, F.pmod(F.crc32(F.col("_gram").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"), ((F.col("_order") == 0) & F.col("_gram").isNotNull()).alias("word"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, from tables with one row for each n-gram. At most `buckets` rows meet in the windows."""
    counts = [t.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(c)) for t, c in ((corpus, "s"), (target, "t"))]
    both = counts[0].join(counts[1], "bucket", "full").fillna(0, ["s", "t"])
    total = lambda c: F.sum(c).over(W.partitionBy(F.lit(0))).cast("double") + F.lit(float(buckets))
    ratio = (F.col("t") + 1).cast("double") * total("s") / ((F.col("s") + 1).cast("double") * total("t"))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str = "7") -> Column:
    """Thousandths of a Gumbel draw from 32 bits of a sha256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scores(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, orders: int = ORDERS, buckets: int = BUCKETS, seed: str = "7", row: str | None = None) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of each row of docs, and _row if
    `row` names a column that tells rows apart. Of the documents with least_words or more words
    `percent` of 100 are drawn, highest scores first, ties to the smaller doc_id."""
    scratch = Scratch(docs.sparkSession)
    number = F.col(row) if row else F.monotonically_increasing_id()
    ours = scratch.save(grams(docs.select("doc_id", "text", number.alias("_row")), ["doc_id"], orders, buckets), "grams")
    theirs = grams(target.select("text", F.monotonically_increasing_id().alias("_row")), [], orders, buckets)
    gain = scratch.save(gains(ours, theirs, buckets), "gains")
    each = ours.join(F.broadcast(gain), "bucket", "left").groupBy("_row", "doc_id").agg(F.count("bucket").alias("n_features"), F.count_if("word").alias("_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    mean = F.when(F.col("n_features") > 0, (F.col("_sum") - F.pmod("_sum", "n_features")) / F.col("n_features")).otherwise(F.lit(0)).cast("long")
    each = each.withColumn("weight", mean).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_fit", F.col("_words") >= least_words)
    each = scratch.save(each.select("_row", "doc_id", "n_features", "weight", "score", "_fit"), "scored")
    drawn = each.where("_fit").count() * percent // 100
    ranked = running(each, [F.col("_fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("_row")], scratch, "ranked")
    rank = F.when(F.col("before") < drawn, F.col("before") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), *(["_row"] if row else []))


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, all columns, in no order."""
    at = free_name(docs, "_at")
    held = Scratch(docs.sparkSession).save(docs.withColumn(at, F.monotonically_increasing_id()), "rows")
    drawn = scores(held, target, row=at, **how).where("rank is not null").select(F.col("_row").alias(at))
    return held.join(drawn, at, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
