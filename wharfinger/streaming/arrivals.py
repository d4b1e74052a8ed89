"""Arrivals as they come in: repeats within a watermark, counts by window, ditto by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def first_seen(stream: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys])


def windowed_counts(stream: DataFrame, time: str, late: str, size: str, *keys: str) -> DataFrame:
    """Rows of each tumbling window and key, once the watermark has passed the window."""
    n = stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("window.start").alias("start"), *keys, "n")


class Ditto(StatefulProcessor):
    """Of a part: the last named row, and the rows that wait for the watermark. One timer is set, at the
    first row that waits or, where none does, when the name is too old to be meant."""

    def __init__(self, idle: int) -> None:
        self.idle = idle  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "name string, at long")
        self.waiting = handle.getListState("waiting", "at long, place long, kind string, name string")

    def _wake(self, at: int) -> None:
        due, timers = -(-at // 1000), list(self.handle.listTimers())
        if not timers or due < min(timers):
            self.handle.registerTimer(due)
            for t in timers:
                self.handle.deleteTimer(t)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            names = (b[c].astype(object).where(b[c].notna(), None).tolist() for c in ("kind", "name"))
            self.waiting.appendList(list(zip(b["at"].tolist(), b["place"].tolist(), *names, strict=True)))
            self._wake(int(b["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, rows = timerValues.getCurrentWatermarkInMs() * 1000, sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        name, seen = self.last.get() if self.last.exists() else (None, None)
        found = []
        for at, place, kind, own in due:
            if seen is not None and at - seen > self.idle:
                name = None
            name, seen = own if kind == "named" else name, at
            found.append((key[0], place, kind, name if kind in ("named", "ditto") else None))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if due:
            self.last.update((name, seen))
        elif not later:  # nothing came for so long
            self.last.clear()
            return
        at = later[0][0] if later else seen + self.idle + 1000
        self.handle.registerTimer(max(-(-at // 1000), expiredTimerInfo.getExpiryTimeInMs() + 1))  # the one that went off goes after this
        if found:
            yield pd.DataFrame(found, columns=["part", "place", "kind", "resolved"])


def resolve_ditto(stream: DataFrame, part: str, kind: str, name: str, order: str, time: str, late: str, idle: str) -> DataFrame:
    """part, order, kind and the name that each row means: its own if it is named, for ditto that of the last
    named row of its part. Rows come in any order up to `late` (an interval); they wait for the watermark and go in order of
    time and place, so the names are those of the batch form whatever the micro-batches. A name is
    forgotten when its part has no row for `idle`, and with it all state of the part. Rows without part, time or place
    have no order and are left out. Needs the RocksDB state store."""
    spark = stream.sparkSession
    length = spark.range(1).selectExpr(f"unix_micros(timestamp'1970-01-02 00:00:00' + interval {idle}) - unix_micros(timestamp'1970-01-02 00:00:00')").first()[0]
    cols = [F.col(part).cast("string").alias("part"), F.col(order).cast("long").alias("place"), F.col(kind).alias("kind"), F.col(name).alias("name"), F.col(time).alias("time"), F.unix_micros(time).alias("at")]
    rows = stream.select(*cols).where("part is not null and place is not null and at is not null").withWatermark("time", late)
    out = rows.groupBy("part").transformWithStateInPandas(Ditto(length), "part string, place long, kind string, resolved string", "append", "EventTime")
    return out.select(F.col("part").alias(part), F.col("place").alias(order), F.col("kind").alias(kind), "resolved")
