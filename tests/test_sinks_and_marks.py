"""Sinks of the graph and the cube, readers by name and by companion, first marks, authorities."""

import json

from pyspark.sql import functions as F

from wharfinger.functions import rules, text
from wharfinger.operators import audit, counts, graph, names
from wharfinger.sources import files


def lines(path):
    return [json.loads(x) for part in sorted(path.glob("part-*")) for x in part.read_text().splitlines()]


ROWS = "record_id string, origin string, dest string, ship string, merchant string, forms array<string>, species string, year int"


def arrived(spark):
    return spark.createDataFrame([("1", "Riga", "Hull", "Ida", "Price", ["deals"], "fir", 1885), ("2", "Riga", "Hull", "Ida", "Wood", ["deals", "props"], "oak", 1885), ("3", "Memel", "Riga", "Ada", "Wood", ["props"], "fir", 1887)], ROWS)


def test_graph_file(spark, tmp_path):
    df = arrived(spark)
    node, edge = graph.with_ids(graph.nodes(df), graph.edges(df))
    files.graph_json(node, edge, str(tmp_path / "g"), {"title": "Arrivals", "shipments": 3})
    n, e, (meta,) = lines(tmp_path / "g/nodes"), lines(tmp_path / "g/edges"), lines(tmp_path / "g/meta")
    assert meta == {"meta": {"title": "Arrivals", "shipments": 3}, "node_count": len(n), "edge_count": len(e)}
    assert {"id": "port:Riga", "type": "Port", "label": "Riga", "shipments_out": 2, "shipments_in": 1} in n
    assert {"source": "merchant:Wood", "target": "port:Hull", "type": "RECEIVED_AT", "year": 1885, "shipments": 1} in e
    assert {x["source"] for x in e} | {x["target"] for x in e} <= {x["id"] for x in n}


def test_compact_cube_file(spark, tmp_path):
    parts = counts.compact(counts.cube_levels(arrived(spark), "forms", "form", "origin", "dest", "year"))
    files.compact_json(*parts, str(tmp_path / "c"))
    ports, forms = [x["port"] for x in lines(tmp_path / "c/ports")], [x["form"] for x in lines(tmp_path / "c/forms")]
    assert ports == ["Hull", "Memel", "Riga"] and forms == ["deals", "props"]
    assert lines(tmp_path / "c/cells/level=route") == [[1, 2, -1, 1887, 1], [1, 2, 1, 1887, 1], [2, 0, -1, 1885, 2], [2, 0, 0, 1885, 2], [2, 0, 1, 1885, 1]]
    assert lines(tmp_path / "c/cells/level=imports") == [[0, -1, 1885, 2], [0, 0, 1885, 2], [0, 1, 1885, 1], [2, -1, 1887, 1], [2, 1, 1887, 1]]


def test_csv_parts_and_companions(spark, tmp_path):
    (tmp_path / "p.csv").write_text('port,n\n"St. John, N.B.",3\nRiga,\n')
    assert [tuple(r) for r in files.csv_rows(spark, str(tmp_path / "p.csv"), "port string, n int").collect()] == [("St. John, N.B.", 3), ("Riga", None)]
    rows = spark.createDataFrame([("1885_p1", 1, "a"), ("1885_p1", 2, "b"), ("1887_p1", 1, "c")], "source_file string, line_no int, text string")
    assert sorted(r["text"] for r in files.only(rows, "1885").collect()) == ["a", "b"]
    labels = spark.createDataFrame([("1885_p1", 2, "OTHER"), ("1890_p1", 1, "OTHER")], "source_file string, line_no int, line_type string")
    assert [tuple(r) for r in files.companions(rows, labels).collect()] == [("1885_p1", 2, "b", "OTHER")]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("c")).first()["c"]


def test_years_of_names(spark):
    for name, last, bounded in (("18750101p.10", "1875", 1875), ("19050101 of 1899", "1899", 1905), ("20010101 of 1850", "unk", 1850), ("Jan 1 1885, 1891", "1891", 1885), ("none", "unk", None), ("", "unk", None)):
        assert (one(spark, text.last_year(F.col("v")), name), one(spark, text.bounded_year(F.col("v")), name)) == (last, bounded)


def test_first_marks(spark):
    for value, want in (("Price & sons", "& Sons"), ("Order, agents", r"\bOrder\b"), ("Border", None), ("", None), (None, None)):
        assert one(spark, rules.first_mark(F.col("v"), rules.CONSIGNEE_PATTERNS), value) == want
    assert one(spark, rules.first_mark(F.col("v"), rules.AMOUNT_PATTERNS), "12 red Boards") == rules.AMOUNT_PATTERNS[3]
    assert one(spark, rules.names_consignee(F.col("v")), None) is None and one(spark, rules.begins_with_date(F.col("v")), "3 dec Anna")


def test_port_headers(spark):
    for value, want in (("hull.\nIda", ["HULL"]), ("News of Leith\nIda", ["LEITH"]), ("London, Docks\n", []), ("Ida\nBO'NESS", ["BO'NESS"]), ("GOOLE\nx\nHULL", ["HULL", "GOOLE"]), ("", []), (None, [])):
        assert one(spark, audit.port_headers(F.col("v")), value) == want


def test_reviewed_authority(spark):
    manual = spark.createDataFrame([("Gefle", "Gävle", 0), ("gefle", "Late", 1), ("Riga", "Riga", 2), ("X", None, 3)], "variant string, canonical string, ordinal int")
    reviewed = spark.createDataFrame([("riga ", "map", "RIGA", 0), ("Blot", " Error", "", 1), ("Hull", "ACCEPT", "", 2), ("", "MAP", "y", 3), ("z", "MAP", " ", 4), (None, None, None, 5)], "original string, action string, map_to string, ordinal int")
    defaults = spark.createDataFrame([("RIGA", "no", 0), ("MEMEL", "Memel", 1), ("MEMEL", "second", 2)], "variant string, canonical string, ordinal int")
    mapping, errors = names.reviewed_authority(manual, reviewed, defaults)
    assert {tuple(r) for r in mapping.collect()} == {("Gefle", "Gävle"), ("GEFLE", "Late"), ("gefle", "Late"), ("Riga", "Riga"), ("RIGA", "RIGA"), ("riga", "RIGA"), ("MEMEL", "Memel")}
    assert {r["name"] for r in errors.collect()} == {"Blot", "BLOT", "blot", *names.NEVER_PORTS}


def test_repaired_names_beside_spoilt_ones(spark):
    rows = [("GÃ¤vle", "GÃ¤vle"), ("Gefle", "Gävle"), ("Ã…bo", "Abo"), ("Åland", "x"), ("Ã\x85land", "y")]
    got = {tuple(r) for r in names.with_repaired(spark.createDataFrame(rows, "variant string, canonical string")).collect()}
    assert got == {("GÃ¤vle", "Gävle"), ("Gävle", "Gävle"), ("Gefle", "Gävle"), ("Ã…bo", "Abo"), ("Åland", "x"), ("Ã\x85land", "y")}
