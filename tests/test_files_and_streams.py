"""Readers, writers and the streaming forms."""

import datetime
import json
import random

from wharfinger.operators import sequences
from wharfinger.sources import files
from wharfinger.streaming import arrivals as live


def test_text_and_json(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  1→LONDON\n  2→Vesta-Riga\n")
    got = [tuple(r) for r in files.ocr_lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()]
    assert got[:2] == [("a.txt", 1, "LONDON"), ("a.txt", 2, "Vesta-Riga")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/good.json").write_text(json.dumps({"status": "success"}))
    (tmp_path / "j/bad.json").write_text("{")
    good, bad = files.json_documents(spark, str(tmp_path / "j"), "status string")
    assert [r["source_file"] for r in files.succeeded(good).collect()] == ["good.json"]
    assert [r["source_file"] for r in bad.collect()] == ["bad.json"]


def test_points_and_series(spark, tmp_path):
    f = {"features": [{"properties": {"Name": "Riga"}, "geometry": {"coordinates": [24.1, 56.9]}}, {"properties": {"Name": "Riga"}, "geometry": {"coordinates": [24.2, 57.0]}}]}
    (tmp_path / "g.json").write_text(json.dumps(f))
    assert [tuple(r) for r in files.geo_points(spark, str(tmp_path / "g.json")).collect()] == [("Riga", 57.0, 24.2)]
    wide = spark.createDataFrame([("x", 1.0, 2.0)], ["s", "1881", "1882"])
    assert sorted(map(tuple, files.long_series(wide, "s", ["1881", "1882"]).collect())) == [("x", 1881, 1.0), ("x", 1882, 2.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 3), ("c", 2)], ["k", "n"])
    files.write_ordered_csv(df, str(tmp_path / "csv"), "n", "k")
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text().split() == ["k,n", "b,3", "a,2", "c,2"]
    files.write_dataset(df, str(tmp_path / "p"), "n")
    assert spark.read.parquet(str(tmp_path / "p")).where("n = 2").count() == 2
    assert [r["k"] for r in files.not_done(df, df.where("n = 2"), "k").collect()] == ["b"]
    assert {(r["i"], r["n"]) for r in files.indexed(df, "k", "i").collect()} == {(0, 2), (1, 3), (2, 2)}


def stream(spark, tmp_path, df, query):
    df.write.parquet(str(tmp_path / "in"))
    out = query(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("seen").collect()


def test_streamed_ditto_is_the_batch_one(spark, tmp_path):
    """Shuffled micro-batches give the batch form's names; parts that are idle leave no state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    schema = "p string, s int, k string, n string, at timestamp"
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for p in "uvwxyz":
        for s in range(40):
            kind = rng.choice(["named", "ditto", "ditto", "none"])
            rows.append((p, s, kind, f"{p}{s}" if kind == "named" else None, start + datetime.timedelta(minutes=s // 2 * 6)))  # two rows at a time: ties fall by place
    want = {(r["p"], r["s"]): r["resolved"] for r in sequences.resolve_ditto(spark.createDataFrame(rows, schema), "k", "n", "p", "s").collect()}
    rows.append(("late", 0, "ditto", None, start + datetime.timedelta(hours=5)))
    rows.append(("none", None, "named", "x", start))
    batch = sorted(rows[:-2], key=lambda r: r[4] + datetime.timedelta(minutes=rng.randrange(50)))
    hour, held = "1 hour", []
    feed, cp = tmp_path / "in", str(tmp_path / "cp")
    feed.mkdir()
    out = live.resolve_ditto(spark.readStream.schema(schema).parquet(str(feed)), "p", "k", "n", "s", "at", hour, hour)
    seen = {}
    far = [[(f"far{i}", 0, "named", "q", start + datetime.timedelta(hours=9 + 9 * i))] for i in range(2)]

    def keep(df, i):
        for r in df.collect():
            assert (r["p"], r["s"]) not in seen
            seen[r["p"], r["s"]] = r["resolved"]

    for part in [batch[:60], batch[60:120], batch[120:180], batch[180:] + rows[-2:], *far]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(feed))
        q = out.writeStream.foreachBatch(keep).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(120)
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert {k: v for k, v in seen.items() if k[0] in "uvwxyz"} == want
    assert max(held) >= 12 and held[-1] <= 3  # a name and a list of each part, then those of the last rows


def test_streamed_first_seen(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:01:00', 'a' UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'b'").coalesce(1)
    assert sorted(r["k"] for r in stream(spark, tmp_path, df, lambda x: live.first_seen(x, "ts", "1 hour", "k"))) == ["a", "b"]
