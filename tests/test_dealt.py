"""Large tables are dealt by their rows: the same answers, and a task's share that doesn't grow."""

import re

import pytest
from conftest import SF
from same import assert_same

import __spark_entry__
from wharfinger.operators import graph
from wharfinger.sources import adapters


@pytest.mark.parametrize("name", ["graph_nodes", "key_dups", "longlived_routes"])
def test_dealt_by_rows(spark, duck, monkeypatch, name):
    monkeypatch.setattr(adapters, "FEW_ROWS", 1000)
    monkeypatch.setattr(adapters, "PART_ROWS", 500)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    df = __spark_entry__.queries()[name](spark, SF)
    exchanges = re.findall(r"RepartitionByExpression \[([^\]]*)\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())
    assert {int(k) for _, k in exchanges} == {n}
    assert any(re.search("record_id|year|t#", keys) for keys, _ in exchanges)  # the groups too, not the joins alone
    assert_same(df, duck, __spark_entry__.oracle_sql()[name])


def test_few_rows_are_left_to_spark(spark):
    assert adapters.parts(spark.range(1000)) == 0
    assert adapters.parts(spark.range(9_000_001)) == 37


def test_nodes_count_rows_and_goods_count_records(spark):
    """A record that came twice is two arrivals of its ship, but one of its goods, as in the SQL."""
    df = spark.createDataFrame([("a", "P", "Q", ["oak", "fir"], "S", "M", "pine")] * 2, "record_id string, origin string, dest string, forms array<string>, ship string, merchant string, species string")
    for parts in (0, 3):
        n = {(r["kind"], r["name"]): r["n"] for r in graph.nodes(df, parts).collect()}
        assert n["Ship", "S"] == n["Merchant", "M"] == n["Species", "pine"] == 2
        assert n["Commodity", "oak"] == n["Commodity", "fir"] == 1
