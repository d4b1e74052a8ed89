"""Written tables in the folder that all machines share, to cut lineage between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """A folder of its own under the session's checkpoint folder. It goes when Python ends;
    drop() frees what is no longer read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):  # each machine would write to a disk of its own
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="wharfinger"))
        self.path = f"{context.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        context = self.spark.sparkContext
        if context._jsc is None:
            return
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
