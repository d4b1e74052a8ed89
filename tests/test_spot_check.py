"""The spot check of a few files against plain code, and the coverage report on rows without any."""

import hashlib

from pyspark.sql import functions as F

from wharfinger.operators import audit, names


def test_spot_check(spark):
    lines = [(f, n) for f in ("a/1", "a/2", "b/1") for n in range(1, 13)]
    read = {("a/1", 1), ("a/1", 5), ("a/1", 6), ("b/1", 12)}
    records = [("a/1", 1, "Ida 2", "Riga", None), ("a/1", 5, "Ida", "Riga-deals", "Price"), ("a/1", 6, "Ida", "Riga", "Price"), ("b/1", 12, "X" * 41, None, "2 Co"), ("zz", 1, "9", "9", "9")]
    files = spark.createDataFrame([("a/1", "a"), ("a/2", "a"), ("b/1", "b"), ("c/0", "c")], "source_file string, source string")
    got = {r["source_file"]: r for r in audit.spot_check(files, spark.createDataFrame(lines, "source_file string, line_no int"), spark.createDataFrame(records, "source_file string, line_no int, ship string, origin string, consignee string")).collect()}
    brief = {f: tuple(r[c] for c in ("n_lines", "read", "missed", "long_runs", "longest_run", "suspicious")) for f, r in got.items()}
    assert brief == {"a/1": (12, 3, 9, 2, 6, 2), "a/2": (12, 0, 12, 1, 12, 0), "b/1": (12, 1, 11, 1, 11, 1), "c/0": (0, 0, 0, 0, 0, 0)} and len(read) == 4
    why = spark.createDataFrame(records, "f string, n int, ship string, origin string, consignee string").select(audit.suspicions(F.col("ship"), F.col("origin"), F.col("consignee")).alias("w")).collect()
    assert [r["w"] for r in why] == [["digits_in_ship_name"], ["cargo_in_origin"], [], ["digits_in_consignee", "long_ship_name"], ["digits_in_ship_name", "digits_in_consignee"]]


def test_hashed_sample(spark):
    rows = [(f"{g}{i}", g) for g in "ab" for i in range(30)] + [("c1", "c")]
    got = {(r["f"], r["g"]) for r in audit.hashed_sample(spark.createDataFrame(rows, "f string, g string"), 4, "f", "g").collect()}
    want = {x for g in "abc" for x in sorted((r for r in rows if r[1] == g), key=lambda r: hashlib.md5(r[0].encode()).hexdigest())[:4]}
    assert got == want


def test_coverage_of_nothing_and_of_ties(spark):
    schema = "o_status string, o_normalized string, d_status string, d_normalized string"
    assert names.coverage(spark.createDataFrame([], schema), ("o", "d")).count() == 0
    rows = [("unmapped", "x", "mapped", "A"), ("unmapped", "y", "canonical", "B"), ("mapped", "A", "error", "E"), ("mapped", "A", "mapped", "A")]
    got = {tuple(r)[:4]: r["percent"] for r in names.coverage(spark.createDataFrame(rows, schema), ("o", "d"), top=1, missing=1).collect()}
    assert got[("unmapped", "o", "x", 1)] == 25.0 and got[("known", "o", "A", 2)] == 50.0 and ("unmapped", "o", "y", 1) not in got
    assert {k[2:]: v for k, v in got.items() if k[0] == "pair"} == {("both", 1): 25.0, ("d only", 2): 50.0, ("o only", 1): 25.0}
