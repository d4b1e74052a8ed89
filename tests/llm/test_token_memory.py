"""What a task of the token files holds at once."""

from pyspark.sql import functions as F

from wharfinger.llm import queries, token_files
from wharfinger.llm.scratch import Scratch


def test_shards_and_parts_are_small(spark):
    """A shard has 2 MB of text at most, a part about 16 MB: a worker of the pipeline held too much with twice that."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(15000)), lambda i: F.concat(F.lit("word"), (i % 97).cast("string"))))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), words.alias("text"))
    size = len(docs.first()["text"])
    path = f"{Scratch(spark).path}/small"
    token_files.write_tokens(docs, path, queries.word_tokenizer(), 1, by_word=True)
    shards = spark.read.parquet(path)
    assert shards.agg(F.max("n_docs")).first()[0] * size <= 2 << 20
    assert shards.groupBy("part").agg(F.sum("n_docs").alias("n")).agg(F.max("n")).first()[0] * size <= 24 << 20
    assert shards.agg(F.sum("n_docs")).first()[0] == 300
