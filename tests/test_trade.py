"""Lists, official names, port checks, graph tables and aliases on small rows."""

from pyspark.sql import functions as F

from wharfinger.operators import audit, graph, names, repeats, trade


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_last_list_counts(spark):
    lists = spark.createDataFrame([("A", "x", 0), ("A", "y", 1), ("B", "x", 0)], ["name", "group", "ordinal"])
    df = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "port string")
    assert rows(trade.with_group(df, "port", lists, "g")) == [("A", "y"), ("B", "x"), ("C", None), (None, None)]
    assert rows(trade.with_group(df, "port", lists.limit(0), "g")) == [("A", None), ("B", None), ("C", None), (None, None)]


def test_official_names(spark):
    df = spark.createDataFrame([(" Nova Scotia ", "Deals of oak pipe"), ("World", "Fir hewn"), ("Norway and Iceland", "Oak, not sawn"), (None, None), ("Chile", "Wainscot")], "s string, c string")
    got = [tuple(r) for r in df.select(trade.official_country(F.col("s")), trade.official_kind(F.col("c"))).collect()]
    assert got == [("Canada", None), (None, "hewn"), ("Norway", "sawn"), (None, None), ("Other", "other")]


def test_official_loads(spark):
    cells = [(1880, "X", "loads", "A", 2.5, "hewn"), (1880, "X", "loads", "C", 9.0, "hewn"), (1880, "X", "loads", None, 1.0, "sawn"), (1880, "X", "tons", "A", 7.0, "sawn"), (1881, "X", "loads", "C", 3.0, "sawn"), (1881, "X", "loads", "A", 3.0, "other")]
    df = spark.createDataFrame(cells, "year int, country string, unit string, grade string, quantity double, k string")
    assert rows(trade.official_loads(df, F.col("k"))) == [(1880, "X", 2.5, 1.0, 1), (1881, "X", 0.0, 0.0, 1)]


def test_subregions_of_nothing(spark):
    empty = spark.createDataFrame([], "year int, country string, sub string")
    assert rows(trade.subregion_shares(empty, "year", "country", "sub", "X")) == []


def test_port_checks(spark):
    fixes = spark.createDataFrame([("QUEBE", "Quebec"), ("ST", "")], "value string, fix string")
    variants = spark.createDataFrame([("RIGS", "Riga")], "value string, canonical string")
    names_ = ["quebe ", "ST", "Rigs", "AB", "A1", "London (", "Imports-oak", "1, 2", "   ", None, "Riga"]
    got = audit.port_checks(spark.createDataFrame([(n,) for n in names_], "p string"), "p", fixes, ("IMPORTS",), variants)
    found = {r["port"]: (r["category"], tuple(r["issues"])) for r in got.collect()}
    assert found == {
        "quebe ": ("truncated", ("truncated",)), "ST": ("truncated", ("truncated",)), "Rigs": ("ocr_variant", ("ocr_variant",)), "AB": ("unmatched_short", ("unmatched_short",)), "A1": ("ok", ()),
        "London (": ("unmatched_short", ("unmatched_short",)), "Imports-oak": ("port_cargo_combined", ("port_cargo_combined", "header_as_port")), "1, 2": ("header_as_port", ("header_as_port",)), "   ": ("empty", ()), "": ("empty", ()), "Riga": ("ok", ()),
    }
    assert rows(audit.fix_rules(got)) == [("error_exclusions", "1, 2", None), ("error_exclusions", "Imports-oak", None), ("ocr_normalization", "RIGS", "Riga"), ("port_cargo_split", "Imports-oak", "Imports"), ("truncation_completion", "QUEBE", "Quebec")]


def test_graph_tables_are_written_and_seen(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", "B", "s", "m", ["deals", "deals"], "oak", 1880, 3.0), ("2", "A", "", "s", None, [], None, 1880, None)], "record_id string, origin string, dest string, ship string, merchant string, forms array<string>, species string, year int, quantity double")
    made = graph.tables(df)
    graph.load(made, f"file://{tmp_path}/g")
    assert len(made) == 13
    assert rows(spark.sql("SELECT * FROM graph_port")) == [("A", 2, 0), ("B", 0, 1)]
    assert rows(spark.sql("SELECT * FROM graph_carried")) == [("1", "deals", 3.0)]
    assert rows(spark.sql("SELECT * FROM graph_consigned_to")) == [("1", "m")]
    assert rows(spark.sql("SELECT * FROM graph_route")) == [("A", "B", 1880, 1)]
    assert rows(spark.sql("SELECT record_id FROM graph_shipment")) == [("1",), ("2",)]


def test_long_aliases(spark):
    """A path of 70 steps, a tail of 40 into a cycle of 3, and a name that stands for itself."""
    path = [(f"p{i:02}", f"p{i + 1:02}") for i in range(70)]
    tail = [(f"t{i:02}", f"t{i + 1:02}") for i in range(39)] + [("t39", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("x", "x")]
    got = {r["variant"]: r["canonical"] for r in names.resolve_aliases(spark.createDataFrame(path + tail, ["variant", "canonical"])).collect()}
    assert all(got[v] == "p70" for v, _ in path)
    assert got["c1"] == got["c2"] == got["c3"] == "c1" and got["x"] == "x" and got["t39"] == "c1" and got["t00"] == "c1"


def test_key_repeats_need_their_keys(spark):
    df = spark.createDataFrame([("S", "1", "a"), ("s ", "1", "b"), ("S", "", "a"), ("S", "", "b"), ("", "1", "a"), ("", "1", "b")], ["ship", "date", "text"])
    assert rows(repeats.key_repeats(df, "text", "ship", "date", needed=("ship", "date"))) == [("s", "1", 2, 2)]
