"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A change is a signed row: an insert counts a document and its tokens, a delete takes both
away, a revised count takes the old tokens away and adds the new. A batch is summed by key,
written to a folder of its own name and moved, whole, to batch=<name>: the move is the commit, and
of two writers of one batch the second finds it taken. So a batch counts once and wholly or not at
all. compact() sums the committed batches into base=<k>, itself moved into place, which keeps their
names, so that they stay committed. Totals are the last base and the batches it does not hold.

Defined results: null text has no tokens; null source, language or version is a key of its
own; a key whose rows have all gone is left out; repeated rows count each.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


def signed(rows: DataFrame, old: str | None = None, new: str | None = None) -> DataFrame:
    """Changes of rows with KEYS: old and new name the columns with the counts before and after."""
    parts = []
    if old:
        parts.append(F.struct(F.lit(-1).cast("long").alias("docs"), (-F.col(old)).cast("long").alias("tokens")))
    if new:
        parts.append(F.struct(F.lit(1).cast("long").alias("docs"), F.col(new).cast("long").alias("tokens")))
    return rows.select(*KEYS, F.explode(F.array(*parts)).alias("c")).select(*KEYS, "c.docs", "c.tokens")


class Rollup:
    """A table of totals under a folder that all machines reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, kind: str) -> set[str]:
        """Names of the folders kind=<name>."""
        fs = self._place().getFileSystem(self._conf)
        if not fs.exists(self._place()):
            return set()
        found = (s.getPath().getName() for s in fs.listStatus(self._place()))
        return {unquote(n[len(kind) + 1 :]) for n in found if n.startswith(f"{kind}=")}

    def _move(self, staged: str, name: str) -> bool:
        """Moves a written folder into place; False, and no trace of it, if the name is taken."""
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        fs = self._place().getFileSystem(self._conf)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._place().toUri(), self._conf).rename(self._place(staged), self._place(name), options)
        except Py4JJavaError:
            if not fs.exists(self._place(name)):
                raise
            fs.delete(self._place(staged), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed rows; False if it had been committed before."""
        if batch in self._committed():
            return False
        staged = f"_staged-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/{staged}")
        return self._move(staged, f"batch={quote(batch, safe='')}")

    def _base(self) -> int:
        return max(map(int, self._names("base")), default=0)

    def _held(self, base: int) -> set[str]:
        """The batches that a base sums; names alone."""
        return {r["batch"] for r in self.spark.read.parquet(f"{self.path}/base={base}/batches").collect()} if base else set()

    def _committed(self) -> set[str]:
        return self._held(self._base()) | self._names("batch")

    def compact(self) -> bool:
        """Sums what is committed into a new base; False if another one did so meanwhile. Batches
        committed while it runs stay as they are."""
        k = self._base()
        held = self._held(k)
        loose = self._names("batch") - held
        names = sorted(held | loose)
        staged = f"_staged-{uuid.uuid4().hex}"
        self._sums(k, loose).write.parquet(f"{self.path}/{staged}/sums")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{self.path}/{staged}/batches")
        return self._move(staged, f"base={k + 1}")

    def _sums(self, base: int, loose: set[str]) -> DataFrame:
        folders = [f"{self.path}/batch={quote(n, safe='')}" for n in sorted(loose)]
        rows = self.spark.read.schema(SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], SUMS)
        if base:
            rows = rows.union(self.spark.read.schema(SUMS).parquet(f"{self.path}/base={base}/sums"))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """KEYS, n_docs and n_tokens over the committed batches."""
        k = self._base()
        sums = self._sums(k, self._names("batch") - self._held(k))
        return sums.select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
