"""Lines with known readings, and the stages that carry state."""

import difflib

from pyspark.sql import functions as F

from wharfinger.functions import grammar, rules, text
from wharfinger.operators import names, repeats, sequences, series
from wharfinger.plans import arrivals


def item(quantity, unit, commodity):
    return (quantity, unit, commodity)


def brief(r):
    return r["ship"], r["steam"], r["origin"], [item(c["quantity"], c["unit"], c["commodity"]) for c in r["cargo"]], r["consignee"], r["confidence"]


DASH = {
    "Cleveland-Mobile-474 pcs. hewn pitch pine, 219 pcs. sawn pitch pine-Price, Potter, & Co.": ("Cleveland", False, "Mobile", [("474", "pcs.", "hewn pitch pine"), ("219", "pcs.", "sawn pitch pine")], "Price, Potter, & Co", "high"),
    "Presto (s)-Soderhamn-11 fms. firewood-Order": ("Presto", True, "Soderhamn", [("11", "fms.", "firewood")], "Order", "high"),
    "Vesta-Riga-deals-Order": ("Vesta", False, "Riga", [(None, None, "deals")], "Order", "high"),
    "X-Y-10 fms. pit-props-Order": ("X", False, "Y", [("10", "fms.", "pit-props")], "Order", "high"),
}


def read(spark, *lines, ports=None):
    known = None if ports is None else spark.createDataFrame([(p.lower(),) for p in ports], "name string")
    rows = grammar.parse_lines(spark.createDataFrame(list(enumerate(lines)), "id int, line string"), "line", known).collect()
    return [brief(r) for r in sorted(rows, key=lambda r: (r["id"], lines[r["id"]].index(r["raw_text"])))]


def test_dash_lines(spark):
    assert read(spark, *DASH) == list(DASH.values())


SHAPES = {
    "Ida—Memel—40 lds. oak—Order": ("Ida", False, "Memel", [("40", "lds.", "oak")], "Order", "high"),
    "Ida - Memel - 40 lds. oak - Order": ("Ida", False, "Memel", [("40", "lds.", "oak")], "Order", "high"),
    "Ida-Memel": ("Ida", False, "Memel", [], None, "medium"),
    "Ida-40 deals": ("Ida", False, "", [("40", None, "deals")], None, "medium"),
    "474 pcs. hewn, 3 lds. oak, Price & Co.": ("", False, "", [("474", "pcs.", "hewn"), ("3", "lds.", "oak")], "Price & Co.", "low"),
    "Ida-Riga-10 deals, Wood & Co.; 1,000 staves, Order": ("Ida", False, "Riga", [("10", None, "deals"), ("1,000", None, "staves")], "Wood & Co.", "high"),
    "Ida": ("Ida", False, "", [], None, "low"),
    "Foo-bar-deals-Riga-ends": ("Foo-bar", False, "deals", [(None, None, "ends")], None, "high"),
    "Ida-Riga-12 1/2 fms. lathwood, &c., qty. of staves": ("Ida", False, "Riga", [("12 1/2", "fms.", "lathwood"), ("qty.", None, "of staves")], None, "high"),
}


def test_shapes_of_dash_lines(spark):
    assert read(spark, *SHAPES) == list(SHAPES.values())


def test_at_lines(spark):
    got = read(spark, "Primrose (s) @ Riga,—5,555 sleepers, Order. Christiana @ Drammen,—146 doz. battens, C. J. Im Thurn & Co.")
    assert got == [("Primrose", True, "Riga", [("5,555", None, "sleepers")], "Order", "high"), ("Christiana", False, "Drammen", [("146", "doz.", "battens")], "C. J. Im Thurn & Co.", "high")]
    tail = read(spark, "Caroline @ Gothenburg,—1,135 doz. deals, Order. Neptionus @ Sannesund,—151 t. firewood, Order. A quantity of sapanwood was brought")
    assert tail[1] == ("Neptionus", False, "Sannesund", [("151", "t.", "firewood")], "Order", "high")
    headed = read(spark, "Mahogany. — Ida @ Belize, &c.,—301 logs, Price & Co. Ada @ Tonala,—40, Order")
    assert headed == [("Ida", False, "Belize", [("301", "logs.", "mahogany")], "Price & Co.", "high"), ("Ada", False, "Tonala", [("40", None, "mahogany")], "Order", "high")]


def test_lines_without_separators(spark):
    got = read(spark, "Busy Bee (s) Rotterdam 1 case woodware", "Black Eagle Sheerness Lavender yard", "Ida New York 40 deals Wood & Co.", "Ida Nowhere 40 deals", "Ida Riga ,, 40 deals", ports=["rotterdam", "sheerness", "york", "new york", "riga"])
    assert got[0] == ("Busy Bee", True, "Rotterdam", [("1", None, "case woodware")], None, "medium")
    assert got[1] == ("Black Eagle", False, "Sheerness", [], None, "medium")
    assert got[2] == ("Ida", False, "New York", [("40", None, "deals")], "Wood & Co.", "medium")
    assert [r[2] for r in got[3:]] == ["", ""]


def test_gazetteer(spark):
    coords = spark.createDataFrame([("St. John's",), ("Rg",), ("12 34",), ("Riga",)], ["name"])
    mapping = spark.createDataFrame([("RIGA", "Riga"), ("Order", "Russia"), ("Dantzic", "Danzig")], ["variant", "canonical"])
    assert sorted(r["name"] for r in grammar.gazetteer(coords, mapping).collect()) == ["dantzic", "danzig", "riga", "st john s"]


def test_places_of_names(spark):
    coords = spark.createDataFrame([("riga", 1.0, 2.0, 1), ("RIGA", 3.0, 4.0, 0), ("Memel", 5.0, 6.0, 2), ("Memel", None, 7.0, 0)], "name string, lat double, lon double, ordinal int")
    got = names.located(spark.createDataFrame([("riga",), ("Riga",), ("MEMEL",), ("Nowhere",), (None,)], "p string"), "p", coords, "o").collect()
    assert {r["p"]: (r["o_lat"], r["o_lon"]) for r in got} == {"riga": (1.0, 2.0), "Riga": (3.0, 4.0), "MEMEL": (5.0, 6.0), "Nowhere": (None, None), None: (None, None)}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


COMMODITIES = {
    "deals and battens": (["deals", "battens"], [], "ok"), "deal ends": (["deal ends", "deals"], [], "ok"), "pit-props": (["pit props"], [], "ok"), "hewn": (["timber"], [], "ok"),
    "mining timber": (["mining timber"], [], "ok"), "hewn pitch pine": ([], ["pitch pine"], "ok"), "": ([], [], "empty"), "from Quebec": ([], [], "origin_leak"), "Smith & Co.": ([], [], "merchant_leak"), "handspikes": ([], [], "unclassified"),
}


def test_commodities(spark):
    df = spark.createDataFrame([(c,) for c in COMMODITIES], ["c"]).withColumn("n", rules.clean_commodity(F.col("c")))
    df = df.withColumn("f", rules.labels(F.col("n"), rules.form_rules())).withColumn("s", rules.labels(F.col("n"), rules.species_rules()))
    got = {r["c"]: (r["f"], r["s"], r["x"]) for r in df.withColumn("x", rules.commodity_status(F.col("n"), F.col("f"), F.col("s"))).collect()}
    assert got == COMMODITIES


def test_firms(spark):
    want = {"Messrs. Price and Co": "named", "to order": "order", "The Master": "master", "&c.": "none", "Ditto.": "ditto"}
    df = spark.createDataFrame([(k,) for k in want], ["x"])
    assert {r["x"]: r["k"] for r in df.select("x", rules.firm_kind(F.col("x")).alias("k")).collect()} == want
    assert one(spark, rules.clean_firm(F.col("v")), v="Messrs. Price and Co") == "Price & Co."


def test_dates(spark):
    for name, want in {"18760108TTJt_p001": "1876-01-08", "A - May 1 1875 - B": "1875-05-01", "A Augus 7 1875 B": "1875-08-07"}.items():
        assert one(spark, text.issue_date(F.col("v")), v=name) == want
    for (date, y, m), want in {("Dec. 28", 1885, 1): "1884-12-28", ("Feb. 30", 1885, 3): "1885-02-30", ("Sept. 3", 1885, 9): ""}.items():
        assert one(spark, text.arrival_iso(F.col("a"), F.col("b"), F.col("c")), a=date, b=y, c=m) == want


def test_quantities(spark):
    want = {"26,744": (26744.0, "ok"), "50-60": (50.0, "range"), "1/2": (0.5, "fraction"), "12 1/2": (None, "non_numeric"), "qty.": (None, "non_numeric"), "2,000,000": (2e6, "extremely_large"), "": (None, "empty")}
    value, issue = text.quantity(F.col("s"))
    got = spark.createDataFrame([(k,) for k in want], ["s"]).select("s", value.alias("v"), issue.alias("i")).collect()
    assert {r["s"]: (r["v"], r["i"]) for r in got} == want


def test_continuation(spark):
    want = {"219 pcs. sawn pitch pine": True, "25 Fauna-Riga": False, "; 180 deals": True, "40 redwood ends": True, "12 Lds. oak": False, "Price & Co., 40": True, "élan": True, "40 Swedes": False}
    df = spark.createDataFrame([(k,) for k in want], ["t"])
    assert {r["t"]: r["c"] for r in df.select("t", arrivals.is_continuation(F.col("t")).alias("c")).collect()} == want


def test_ditto_chain(spark):
    df = spark.createDataFrame([("f", 1, "ditto", None), ("f", 2, "named", "A"), ("f", 3, "ditto", None), ("f", 4, "order", None), ("f", 5, "ditto", None)], "p string, s int, k string, n string")
    got = sequences.resolve_ditto(df, "k", "n", "p", "s").orderBy("s").collect()
    assert [(r["resolved"], r["resolved_kind"]) for r in got] == [(None, "none"), ("A", "named"), ("A", "named"), (None, "order"), ("A", "named")]


def test_fuzzy_merge_is_difflib(spark):
    forms = [("Price, Potter & Walker", 150), ("Price, Poter & Walker", 3), ("Pride & Co. Limited", 2), ("Zeta Brothers", 4)]
    got = names.fuzzy_merge(spark.createDataFrame(forms, "canonical string, n long")).collect()
    ratio = difflib.SequenceMatcher(None, "price, poter & walker", "price, potter & walker").ratio()
    assert [(r["canonical"], r["target"], r["ratio"]) for r in got] == [("Price, Poter & Walker", "Price, Potter & Walker", round(ratio, 6))]


def test_alias_cycle(spark):
    got = names.resolve_aliases(spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D"), ("D", "E")], ["variant", "canonical"])).collect()
    assert {r["variant"]: r["canonical"] for r in got} == {"A": "A", "B": "A", "C": "E", "D": "E"}


def test_mojibake(spark):
    assert one(spark, names.repair_mojibake(F.col("v")), v="GÃ¶teborg") == "Göteborg"
    assert one(spark, names.repair_mojibake(F.col("v")), v="Göteborg") == "Göteborg"


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "X"), ("a", 1, "X"), ("b", 1, "X")], ["g", "o", "t"])
    once = repeats.keep_first(df, [F.col("g"), F.col("t")], ["o"])
    assert sorted(map(tuple, once.collect())) == [("a", 1, "X"), ("b", 1, "X")]
    assert sorted(map(tuple, repeats.keep_first(once, [F.col("g"), F.col("t")], ["o"]).collect())) == sorted(map(tuple, once.collect()))


def test_more_breaks_never_cost_more(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    y = np.concatenate([np.arange(10.0), np.full(10, 20.0), 30 - np.arange(10.0)]) + rng.normal(0, 0.01, 30)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "p string, t int, v double")
    best = series.best_breaks(series.segment_errors(df, "t", "v", "p", least=4), "p", 3).orderBy("m").collect()
    assert all(b["cost"] <= a["cost"] + 1e-9 for a, b in zip(best, best[1:]))
    assert best[2]["breaks"] == [10, 20]
    want = min(sum(np.polyfit(np.arange(a, b), y[a:b], 1, full=True)[1].sum() for a, b in ((0, i), (i, 30))) for i in range(4, 27))
    assert abs(best[1]["cost"] - want) < 1e-6


def test_page_to_arrivals(spark):
    lines = [("18850103J_p001", n, t, k) for n, t, k in [
        (1, "LONDON", "PORT_HEADER"), (2, "Dec. 28 Vesta-Riga-1,000 deals, 50 battens-", "SHIPPING_DATA"), (3, "and sleepers-Price & Co.", "SHIPPING_DATA"),
        (4, "29 Presto (s)-Soderhamn-11 fms. firewood-Ditto", "SHIPPING_DATA"), (5, "HULL", "PORT_HEADER"), (6, "30 Anna-Memel-40 lds. oak-Order", "SHIPPING_DATA"), (7, "30 Anna-Memel-40 lds. oak-Order", "SHIPPING_DATA")]]
    df = spark.createDataFrame(lines, "source_file string, line_no int, text string, line_type string")
    records = arrivals.deduplicate(arrivals.parse(df.drop("line_type"), df.drop("text")))
    firms = arrivals.enrich_firms(arrivals.enrich_cargo(records))
    mapping = spark.createDataFrame([("RIGA", "Riga", 0)], "variant string, canonical string, ordinal int")
    errors, coords = spark.createDataFrame([("order",)], "name string"), spark.createDataFrame([("Memel", 55.7, 21.1, 0), ("London", 51.5, -0.1, 1)], "name string, lat double, lon double, ordinal int")
    got = [(r["line_no"], r["date"], r["ship"], r["origin_normalized"], r["dest"], r["firm"], r["port_status"]) for r in arrivals.enrich_ports(firms, mapping, errors, coords).orderBy("line_no").collect()]
    assert got == [(2, "Dec. 28", "Vesta", "Riga", "LONDON", "Price & Co.", "both"), (4, "Dec. 29", "Presto", "Soderhamn", "LONDON", "Price & Co.", "destination_only"), (6, "Dec. 30", "Anna", "Memel", "HULL", None, "origin_only")]


def test_distinct_lines_are_read_once(spark):
    """Lines that repeat give each row its records; the patterns of goods run over distinct lines only."""
    lines = ["Vesta (s)-Riga-20 pcs. deals, 3 lds. oak-Order", "Ann @ Riga,—5 lds. oak, Order", None, "Hope Riga 9 deals", ""]
    df = spark.createDataFrame([(i, lines[i % 5]) for i in range(50)], "id int, line string").repartition(3, "id")
    ports = spark.createDataFrame([("riga",)], "name string")
    for known in (None, ports):
        plain, once = grammar.parse_lines(df, "line", known), grammar.parse_distinct(df, "line", known)
        assert once.columns == plain.columns
        assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))


def test_line_queries_read_distinct_lines(spark):
    from wharfinger import catalog

    for name in ("dash_parse", "at_parse", "rescue"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "_records" in plan, name
