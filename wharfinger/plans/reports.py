"""Queries of the graph's tables, port checks with their rules, the summary and sets of breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.functions import rules as r
from wharfinger.operators import audit as a
from wharfinger.operators import graph as g
from wharfinger.operators import repeats
from wharfinger.operators import series as s
from wharfinger.plans.checks import SPOILT, spoilt_fields
from wharfinger.plans.statistics import levels_sql, monthly
from wharfinger.sources.adapters import arrivals, page_lines, table
from wharfinger.sources.files import saved

#: Places of the ports for the graph: every other nation has one.
PLACED = "(SELECT n_name AS name, n_nationkey::DOUBLE AS lat, -1.0::DOUBLE * n_nationkey AS lon FROM nation WHERE n_nationkey % 2 = 0)"

GRAPH = {
    "Port": f"SELECT name, lat, lon, coalesce(a, 0)::BIGINT AS shipments_out, coalesce(b, 0)::BIGINT AS shipments_in FROM (SELECT origin AS name, count(*) AS a FROM arr GROUP BY ALL) FULL JOIN (SELECT dest AS name, count(*) AS b FROM arr GROUP BY ALL) USING (name) LEFT JOIN {PLACED} USING (name)",
    "Ship": "SELECT ship AS name, count(*) AS shipments FROM arr GROUP BY ALL",
    "Merchant": "SELECT merchant AS name, count(*) AS shipments FROM arr GROUP BY ALL",
    "Commodity": "SELECT form, count(*) AS shipments FROM lab GROUP BY ALL",
    "Species": "SELECT species AS name, count(*) AS shipments FROM arr GROUP BY ALL",
    "Shipment": "SELECT record_id, year, month, issue, origin_region, coast, steam, period, good_year, strftime(arrived, '%Y-%m-%d') AS iso FROM arr",
    "ARRIVED_FROM": "SELECT record_id, origin AS target FROM arr",
    "ARRIVED_AT": "SELECT record_id, dest AS target FROM arr",
    "BY_SHIP": "SELECT record_id, ship AS target FROM arr",
    "CONSIGNED_TO": "SELECT record_id, merchant AS target FROM arr",
    "CARRIED": "SELECT record_id, form, quantity FROM lab",
    "CARRIED_SPECIES": "SELECT record_id, species AS target FROM arr",
    "ROUTE": "SELECT origin, dest AS destination, year, count(*) AS shipments FROM arr GROUP BY ALL",
}


def graph(spark, d):
    key = F.col("n_nationkey").cast("double")
    placed = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), key.alias("lat"), (key * -1.0).alias("lon"))
    rows = arrivals(spark, d).withColumn("iso", F.date_format("arrived", "yyyy-MM-dd")).drop("arrived")
    return g.tables(rows, placed)


def graph_table(name):
    def one(spark, d):
        return graph(spark, d)[name]

    return one


for _name, _sql in GRAPH.items():
    query(_sql, arrivals=True, name=f"kg_{_name.lower()}")(graph_table(_name))


#: Ports with goods behind them, cut short, misread or taken from headings, from each line item.
PORTS = ("Riga-deals", "QUEBE", "LON (", "Nor", "Imports of the week", "12, 1885", "Goteburg", "riga", "", "Memel, etc.", None)
FIXES = (("QUEBE", "Quebec"), ("LON (", "London"), ("ST", ""))
HEADERS = ("IMPORTS", "ARRIVED AT")
VARIANTS = (("GOTEBURG", "Gothenburg"),)


def ports(spark, d):
    port = F.element_at(F.array(*map(F.lit, PORTS)), (F.col("l_partkey") % len(PORTS) + 1).cast("int"))
    return table(spark, d, "lineitem").select(port.alias("port"))


def checked(spark, d):
    fixes, variants = spark.createDataFrame(FIXES, "value string, fix string"), spark.createDataFrame(VARIANTS, "value string, canonical string")
    return a.port_checks(ports(spark, d), "port", fixes, HEADERS, variants)


EXPECTED = """x(p, category, issues, clean, fix, canonical) AS (VALUES ('Riga-deals', 'port_cargo_combined', ['port_cargo_combined'], 'Riga', NULL, NULL), ('QUEBE', 'truncated', ['truncated'], NULL, 'Quebec', NULL), ('LON (', 'truncated', ['truncated'], NULL, 'London', NULL),
 ('Nor', 'unmatched_short', ['unmatched_short'], NULL, NULL, NULL), ('Imports of the week', 'header_as_port', ['header_as_port'], NULL, NULL, NULL), ('12, 1885', 'header_as_port', ['header_as_port'], NULL, NULL, NULL), ('Goteburg', 'ocr_variant', ['ocr_variant'], NULL, NULL, 'Gothenburg'),
 ('riga', 'ok', [], NULL, NULL, NULL), ('', 'empty', [], NULL, NULL, NULL), ('Memel, etc.', 'port_cargo_combined', ['port_cargo_combined'], 'Memel', NULL, NULL))"""


@query(
    f"""WITH {EXPECTED}, n AS (SELECT coalesce([{", ".join("NULL" if v is None else repr(v) for v in PORTS)}][(l_partkey % {len(PORTS)} + 1)::INT], '') AS port, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT port, n, category, array_to_string(issues, ',') AS issues, clean, fix, canonical FROM n JOIN x ON port = p"""
)
def port_checks(spark, d):
    return checked(spark, d).withColumn("issues", F.array_join("issues", ","))


@query(
    """SELECT * FROM (VALUES ('port_cargo_split', 'Riga-deals', 'Riga'), ('port_cargo_split', 'Memel, etc.', 'Memel'), ('truncation_completion', 'QUEBE', 'Quebec'), ('truncation_completion', 'LON (', 'London'),
 ('error_exclusions', 'Imports of the week', NULL), ('error_exclusions', '12, 1885', NULL), ('ocr_normalization', 'GOTEBURG', 'Gothenburg')) t(rule, value, replacement)"""
)
def port_rule_maps(spark, d):
    return a.fix_rules(checked(spark, d))


REPEATED = "SELECT count(*) AS n, count(*) >= 5 AS loop FROM ln GROUP BY source_file, text HAVING count(*) >= 2"
FLAGS = {
    "empty_origin": ("l_suppkey % 11 = 0", "HIGH"),
    "empty_cargo": ("l_partkey % 13 = 0", "HIGH"),
    "low_confidence": ("l_quantity < 5", "HIGH"),
    "port_cargo_combined": ("(contains(lower(port), '-timber') OR contains(lower(port), ', etc.'))", "MEDIUM"),
    "truncated_ports": ("length(port) <= 3", "MEDIUM"),
    "headers_as_ports": ("port = 'Order'", "MEDIUM"),
    "cargo_in_ship_name": ("(contains(lower(ship), 'pcs.') OR contains(lower(ship), 'deals'))", "MEDIUM"),
    "quantity_anomalies": ("l_quantity > 45", "LOW"),
    "missing_units": ("l_tax = 0", "LOW"),
}


@query(
    f"WITH s AS (SELECT *, {SPOILT} FROM lineitem), rep AS ({REPEATED}), m(metric, n, priority) AS ("
    + " UNION ALL ".join(f"SELECT '{k}', count(*) FILTER ({x}), '{p}' FROM s" for k, (x, p) in FLAGS.items())
    + " UNION ALL SELECT 'exact_duplicates', coalesce(sum(n - 1), 0)::BIGINT, 'HIGH' FROM rep UNION ALL SELECT 'reading_loops', coalesce(sum(n) FILTER (loop), 0)::BIGINT, 'HIGH' FROM rep) SELECT metric, n, round(n * 100 / (SELECT count(*) FROM lineitem), 1) AS percent, priority FROM m",
    lines=True,
)
def quality_summary(spark, d):
    """All eleven metrics; lines repeated in a page are counted beside the line items."""
    port, ship = F.col("port"), F.col("ship")
    flags = {k: (F.expr(x), p) for k, (x, p) in FLAGS.items()}
    flags["port_cargo_combined"] = (r.port_and_goods(port).isNotNull(), "MEDIUM")
    flags["cargo_in_ship_name"] = (r.has_keyword(F.lower(ship)), "MEDIUM")
    again = repeats.exact_repeats(page_lines(spark, d), "source_file", "text")
    return a.summary(spoilt_items(spark, d), flags, {"exact_duplicates": (again.select(F.col("extra").alias("n")), "HIGH"), "reading_loops": (again.where("n >= 5"), "HIGH")})


def spoilt_items(spark, d):
    port, ship = spoilt_fields()
    return table(spark, d, "lineitem").select("*", port.alias("port"), ship.alias("ship"))


@query("SELECT year, count(*) AS n, count(*) FILTER (quantity < 5) AS bad, round(avg((quantity < 5)::INT::DOUBLE), 6) AS rate FROM arr GROUP BY year", arrivals=True)
def error_rate_by_year(spark, d):
    return a.rates_by(arrivals(spark, d), "year", F.col("quantity") < 5)


@query(
    f"""WITH {levels_sql(4)}, each AS (SELECT *, unnest(range(1, m + 1)) AS k FROM best),
around AS (SELECT origin_region, k, cost, breaks[k] AS brk, CASE WHEN k = 1 THEN 0 ELSE breaks[k - 1] END AS lo, CASE WHEN k = m THEN n ELSE breaks[k + 1] END AS hi FROM each),
moved AS (SELECT r.origin_region, k, cost, brk, a.j AS place, a.ssr + b.ssr AS two FROM around r JOIN e a ON a.origin_region = r.origin_region AND a.i = lo + 1 JOIN e b ON b.origin_region = r.origin_region AND b.i = a.j + 1 AND b.j = hi),
whole AS (SELECT *, cost - max(two) FILTER (place = brk) OVER (PARTITION BY origin_region, k) + two AS ssr FROM moved)
SELECT origin_region, k::INT AS k, place::INT AS place, round(ssr, 4) AS ssr FROM whole WHERE ssr <= 1.01 * cost""",
    arrivals=True,
)
def break_confidence_4(spark, d):
    """Of each of the breaks, 0 to 4, that BIC chooses, the others held."""
    e = saved(s.segment_errors(monthly(spark, d), "t", "v", "origin_region", least=8))
    every = saved(s.best_breaks(e, "origin_region", 4))
    return s.break_sets(e, every.join(s.by_bic(every, "origin_region").select("origin_region", "m"), ["origin_region", "m"]), "origin_region")


@query(
    """WITH a AS (SELECT year, avg(quantity) AS v FROM arr WHERE steam AND year < 2001 GROUP BY year), b AS (SELECT year, avg(quantity) AS v FROM arr WHERE NOT steam AND year > 1995 GROUP BY year), c AS (SELECT year, avg(quantity) AS v FROM arr WHERE coast = 'ASIA' AND year <> 1998 GROUP BY year)
SELECT year, round(a.v, 6) AS a, round(b.v, 6) AS b, round(c.v, 6) AS c, round(a.v / b.v, 6) AS a_to_b, round(b.v / c.v, 6) AS b_to_c FROM a FULL JOIN b USING (year) FULL JOIN c USING (year)""",
    arrivals=True,
)
def triangulation_of_three(spark, d):
    rows = arrivals(spark, d).select("year", "steam", "coast", "quantity")
    one = lambda on: rows.where(on).groupBy("year").agg(F.avg("quantity").alias("v"))
    return s.side_by_side({"a": one("steam and year < 2001"), "b": one("not steam and year > 1995"), "c": one("coast = 'ASIA' and year <> 1998")}, "year", "v", [("a", "b"), ("b", "c")])
