"""The star-schema tables seen as arrivals, page lines and logged events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART_ROWS, FEW_ROWS = 250_000, 4_000_000  # rows that a task sorts or groups at once; fewer in all are left to Spark


def parts(df: DataFrame) -> int:
    """Partitions with some 250,000 rows of a table each, 0 for one that Spark may deal as it likes. Counts by the files' footers."""
    n = df.count()
    return -(-n // PART_ROWS) if n > FEW_ROWS else 0


def arrival_parts(spark: SparkSession, sf_dir: str) -> int:
    return parts(table(spark, sf_dir, "lineitem"))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df in n partitions by its keys; as it is, if n is 0. What it is joined with on these follows."""
    return df.repartition(n, *keys) if n else df


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: what arrived, whence, where, for whom and when. A large table is dealt by
    its rows, so that the share of a task doesn't grow with it."""
    n = arrival_parts(spark, sf_dir)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    supplier = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("ship"), F.col("n_name").alias("origin"), F.col("r_name").alias("origin_region"))
    customer = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("merchant"), F.col("n_name").alias("dest"), F.col("r_name").alias("coast"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(dealt(customer, n, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    words = F.split("p_name", " ")
    part = table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.array("p_type", F.element_at(words, -1))).alias("forms"), F.element_at(words, 1).alias("species"))
    rows = table(spark, sf_dir, "lineitem").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(dealt(supplier, n, "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(dealt(part, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    year = F.year("l_shipdate")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("record_id"),
        year.alias("year"), F.month("l_shipdate").alias("month"), F.date_format("l_shipdate", "yyyy-MM").alias("issue"),
        "origin", "origin_region", "dest", "coast", "forms", "species", (F.col("l_linestatus") == "F").alias("steam"), "ship", "merchant",
        F.when(year <= 1997, "early").when(year >= 1999, "late").alias("period"), (year % 2 == 1).alias("good_year"),
        F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("arrived"),
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, line_no from 1 on, and text of each line of the documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_file"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("source_file", (F.col("p") + 1).alias("line_no"), "text")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, seq and name, where "view" stands for the name before it."""
    events = table(spark, sf_dir, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("user_id", "event_id", seq.alias("seq"), "ts", "event_type", "value", F.when(F.col("event_type") == "view", "ditto").otherwise("named").alias("kind"))
