"""The corpus pipeline: each stage works on what its predecessor kept.

Rules reject low-quality documents, near-duplicates leave one document of each group,
documents with benchmark passages go, sources are mixed to their budgets, and what is left is
written as token ids and read back. Stages return the columns of documents, the last one the
place of each document among all ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wharfinger.llm import decontam, mixing, neardup, quality, token_files
from wharfinger.llm.queries import word_tokenizer
from wharfinger.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; of the others the lines that fail go."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked on shingles of five words the one with the least doc_id stays."""
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten words of a benchmark item occur go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their budgets: a document comes as often as the mix takes it."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the files written."""
    path = f"{Scratch(spark).path}/tokens"
    token_files.write_tokens(docs, path, word_tokenizer(), end_id=1, by_word=True)
    return token_files.read_tokens(spark, path, ids=False)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_output", token_output)]
ORACLE_SQL = None  # SQL has no tokenizer; tests hold the stages against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written as Parquet for the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
