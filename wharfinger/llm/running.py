"""Running sums of a whole table in a given order, without a task that sees all of it.

Rows are sorted by ranges; a task adds up its own range, and what the ranges before it hold is
added after. The last column of the order should tell rows apart, so that equal rows, however
many, are dealt over several ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.window import Window as W

from wharfinger.llm.scratch import Scratch

PART_ROWS = 1 << 18  # of a range
BROADCAST_PARTS = 500_000  # 16 bytes each


def running(rows: DataFrame, by: list[Column], scratch: Scratch, name: str, weight: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """rows and before: the sum of a long column over all rows that come earlier, or their number
    without one. rows should be a written table: it is counted, sampled and sorted."""
    parts = max(1, -(-rows.count() // part_rows))
    schema = StructType([*rows.schema.fields]).add("_part", IntegerType()).add("_in", LongType()).add("_w", LongType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            w = b[weight].to_numpy() if weight else np.ones(len(b), np.int64)
            run = total + np.cumsum(w)
            total = int(run[-1]) if len(run) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(run - w), pa.array(w)], [*b.schema.names, "_part", "_in", "_w"])

    held = scratch.save(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(work, schema), name)
    sums = held.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    starts = sums.select("_part", (F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_sum")).alias("_start"))
    out = held.join(starts.hint("broadcast" if parts <= BROADCAST_PARTS else "merge"), "_part")
    return out.select(*rows.columns, (F.col("_start") + F.col("_in")).alias("before"))
