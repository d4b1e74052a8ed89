"""Shards by virtual slots.

A record hashes to one of some thousands of slots, and a map says which shard has a slot. Only the map
changes: a version of it is a folder with the slots that the edit moved, written whole and moved
into place, so readers keep the version they began with and two edits cannot both be the next one.
Growing takes slots only into the new shard; levelling moves slots from heavy shards to light ones by
the bytes that slots hold, summed before the shuffle.

The map of n shards that only ever grew depends on n and the number of slots alone, so a doc_id and the
number of shards decide the shard. The map has one row a slot, which bounds what the driver edits
and what is broadcast (at most MOST_SLOTS rows).

Defined results: a row without doc_id is placed by its text, null as the empty one; rows that repeat
a doc_id share a shard; null text has no bytes (each row counts one besides); places in a shard follow slot,
doc_id (null last), text_crc32 and size, rows equal in all of these either way round; an empty table
has empty shards; texts of any length are whole.
"""

from __future__ import annotations

import heapq
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfinger.llm.running import running
from wharfinger.llm.scratch import Scratch, free_name

SLOTS, MOST_SLOTS = 4096, 1 << 16
EDITS = "slot int, shard int"


def slot_of(doc_id: Column, text: Column, n_slots: int = SLOTS, seed: str = "slot") -> Column:
    """60 bits of an md5 modulo the number of slots."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(bits, F.lit(n_slots)).cast("int")


def record_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def slot_loads(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """slot, records and bytes of the slots in use."""
    sized = docs.select(slot_of(F.col("doc_id"), F.col("text"), n_slots).alias("slot"), record_size(F.col("text")).alias("size"))
    return sized.groupBy("slot").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"))


def grown(shards: list[int], n: int) -> dict[int, int]:
    """The edit that gives shard n its part: {slot: n}. Each older shard keeps its first slots, as
    many as make the shards equal, the earlier ones having one more where they don't divide."""
    seen, edit = [0] * n, {}
    for slot, shard in enumerate(shards):
        seen[shard] += 1
        if seen[shard] > len(shards) // (n + 1) + (shard < len(shards) % (n + 1)):
            edit[slot] = n
    return edit


def levelled(shards: list[int], load: dict[int, int], n: int, slack: float) -> dict[int, int]:
    """An edit after which no shard should have more than (1 + slack) of the mean bytes: the
    largest slot that fits the lightest shard leaves the heaviest, until none does."""
    total, own = [0] * n, [[] for _ in range(n)]
    for slot, shard in enumerate(shards):
        if load.get(slot):
            total[shard] += load[slot]
            own[shard].append((load[slot], slot))
    for held in own:
        held.sort()
    most, edit = sum(total) / n * (1 + slack), {}
    light = [(b, s) for s, b in enumerate(total)]
    heapq.heapify(light)
    for heavy in sorted(range(n), key=lambda s: -total[s]):
        for size, slot in reversed(own[heavy]):
            if total[heavy] <= most:
                break
            while light[0][0] != total[light[0][1]]:
                heapq.heapreplace(light, (total[light[0][1]], light[0][1]))
            to = light[0][1]
            if to != heavy and total[to] + size < total[heavy] and total[to] + size <= most:
                total[heavy] -= size
                total[to] += size
                heapq.heapreplace(light, (total[to], to))
                edit[slot] = to
    return edit


class SlotMap:
    """Versions of a map from slots to shards, under a folder that all machines reach."""

    def __init__(self, spark: SparkSession, path: str, n_slots: int = SLOTS) -> None:
        if not 0 < n_slots <= MOST_SLOTS:
            raise ValueError(f"1 to {MOST_SLOTS} slots")
        self.spark, self.path, self.n_slots = spark, path, n_slots
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        fs = self._place().getFileSystem(self._conf)
        names = [s.getPath().getName() for s in fs.listStatus(self._place())] if fs.exists(self._place()) else []
        return sorted(int(n[8:]) for n in names if n.startswith("version="))

    def at(self, version: int | None = None) -> DataFrame:
        """slot and shard as of a version, the last one without it."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known or version not in (None, known[-1]):
            raise ValueError(f"no version {version}")
        edits = self.spark.read.schema(EDITS + ", version int").option("basePath", self.path).parquet(*[f"{self.path}/version={v}" for v in known])
        return edits.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))

    def _shards(self, version: int | None = None) -> list[int]:
        return [r["shard"] for r in sorted(self.at(version).collect())]

    def commit(self, edit: dict[int, int], after: int) -> int:
        """Writes the moved slots as version after + 1; ValueError if another edit was first. The
        move into place is whole where the folder's file system renames folders at once, as HDFS does."""
        staged, name = f"_staged-{uuid.uuid4().hex}", f"version={after + 1}"
        rows = self.spark.createDataFrame(sorted(edit.items()), EDITS)
        rows.coalesce(1).write.parquet(f"{self.path}/{staged}")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._place().toUri(), self._conf).rename(self._place(staged), self._place(name), options)
        except Py4JJavaError as e:
            self._place().getFileSystem(self._conf).delete(self._place(staged), True)
            raise ValueError(f"version {after + 1} is taken") from e
        return after + 1

    def create(self, n_shards: int) -> int:
        """The first version: that of a map which grew to n_shards one by one."""
        shards = [0] * self.n_slots
        for n in range(1, n_shards):
            for slot, to in grown(shards, n).items():
                shards[slot] = to
        return self.commit(dict(enumerate(shards)), 0)

    def grow(self) -> int:
        """One more shard, which takes slots from all others."""
        shards = self._shards()
        return self.commit(grown(shards, max(shards) + 1), self.versions()[-1])

    def level(self, loads: DataFrame, slack: float = 0.02) -> int:
        """Moves slots so that shards have near equal bytes; loads are slot_loads(). A slot is never cut, so
        one that is heavier than a shard should be stays the only one of note in its shard."""
        shards = self._shards()
        load = {r["slot"]: r["bytes"] for r in loads.select("slot", "bytes").collect()}
        edit = levelled(shards, load, max(shards) + 1, slack)
        return self.commit(edit, self.versions()[-1])

    def place(self, slotted: DataFrame, version: int | None = None, name: str = "shard") -> DataFrame:
        """slotted, which has a column slot, and the shard of each row."""
        return slotted.join(F.broadcast(self.at(version).withColumnRenamed("shard", name)), "slot")


def placed(docs: DataFrame, slot_map: SlotMap, version: int | None = None, later: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (the place in the shard, from 0 without
    gaps) and grown_shard (the shard by the version `later`) of each row."""
    scratch = Scratch(docs.sparkSession)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    slim = docs.select("doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), slot_of(F.col("doc_id"), F.col("text"), slot_map.n_slots).alias("slot"), F.monotonically_increasing_id().alias("_row"))
    slim = slot_map.place(slim, version)
    slim = slot_map.place(slim, later, "grown_shard") if later is not None else slim.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = scratch.save(slim.withColumnRenamed("slot", "virtual_slot"), "placed")
    order = [F.col("shard"), F.col("virtual_slot"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size"), F.col("_row")]
    run = running(rows, order, scratch, "ordered")
    firsts = run.groupBy("shard").agg(F.min("before").alias("_first"))
    return run.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("before") - F.col("_first")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, version: int | None = None, files: int = 1) -> str:
    """Writes docs' rows in one folder a shard, `files` files each, dealt by slot and row, so that no
    slot, however heavy, is one task's. Returns the name of the folders' column: shard, with
    underscores if docs has one."""
    slot, shard, row = (free_name(docs, c) for c in ("slot", "shard", "_row"))
    slotted = docs.withColumn(slot, slot_of(F.col("doc_id"), F.col("text"), slot_map.n_slots)).withColumn(row, F.monotonically_increasing_id())
    at = slot_map.at(version).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    n = (max(slot_map._shards(version)) + 1) * files
    slotted.join(F.broadcast(at), slot).repartitionByRange(n, shard, slot, row).drop(slot, row).write.partitionBy(shard).parquet(path)
    return shard
