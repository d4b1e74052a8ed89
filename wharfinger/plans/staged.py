"""Stages of the arrivals work one after the other, each over what has no output yet.

A stage's output is a folder of batches. A batch holds the rows that the stage made (rows) and the
documents that it saw with their status and error (documents), and is moved into place whole, so a run that
dies leaves committed batches or none, and the next run takes up what is missing: the documents that the
stage before has and this one has not. Documents that failed are not worked on but go on with their error to the end.

A stage whose result depends on all documents together (repeats over pages, names merged over all records) is
marked ALL, as is then every stage after it: when it has not seen a document it is made anew over everything, and
its last output alone counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfinger.sources.files import not_done, succeeded

DOCUMENTS = "source_file string, status string, error string"
ALL = "all"
Stage = Callable[[DataFrame], DataFrame]


class Staged:
    """Stage outputs under a folder that all machines reach, on a file system that renames folders at once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self, stage: str) -> list[str]:
        fs = self._place(stage).getFileSystem(self._conf)
        if not fs.exists(self._place(stage)):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(self._place(stage)))
        whole = [n for n in names if n.startswith(f"{ALL}-")]
        return [f"{self.path}/{stage}/{n}" for n in whole[-1:] or names if n.startswith(("batch-", f"{ALL}-"))]

    def documents(self, stage: str) -> DataFrame:
        """source_file, status and error of what the stage has seen."""
        found = [f"{b}/documents" for b in self.batches(stage)]
        return self.spark.read.schema(DOCUMENTS).parquet(*found) if found else self.spark.createDataFrame([], DOCUMENTS)

    def rows(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{b}/rows" for b in self.batches(stage)])

    def commit(self, stage: str, documents: DataFrame, rows: DataFrame, whole: bool = False) -> None:
        staged = f"_staged-{uuid.uuid4().hex}"
        documents.select("source_file", "status", "error").write.parquet(f"{self.path}/{staged}/documents")
        rows.write.parquet(f"{self.path}/{staged}/rows")
        fs = self._place(stage).getFileSystem(self._conf)
        fs.mkdirs(self._place(stage))
        made = [b.rsplit("/", 1)[1] for b in self.batches(stage)]
        name = f"{ALL}-{int(made[0].split('-')[1]) + 1 if made else 0:09d}" if whole else f"batch-{uuid.uuid4().hex}"
        if fs.exists(self._place(f"{stage}/{name}")) or not fs.rename(self._place(staged), self._place(f"{stage}/{name}")):
            raise OSError(f"{stage}: the batch was not moved into place")

    def run(self, documents: DataFrame, rows: DataFrame, stages: list[tuple]) -> tuple[DataFrame, DataFrame]:
        """(documents, rows) after the last stage. A stage is (name, function) or (name, function, ALL). documents:
        source_file, status, error; rows have source_file, and every stage keeps it. A document is in rows of its own or of none."""
        whole = False
        for name, stage, *how in stages:
            whole = whole or ALL in how
            todo = not_done(documents, self.documents(name))
            if not self.batches(name) or not todo.isEmpty():
                work = documents if whole else todo
                good = succeeded(work).select("source_file")
                self.commit(name, work, stage(rows.join(good, "source_file", "left_semi")), whole)
            documents, rows = self.documents(name), self.rows(name)
        return documents, rows


def failed(documents: DataFrame) -> DataFrame:
    """The documents that were not worked on, with their errors."""
    return documents.where(F.coalesce(F.col("status") != "success", F.lit(True)))
