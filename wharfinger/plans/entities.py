"""Names, labels and the graph."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.functions import rules as r
from wharfinger.operators import graph as g
from wharfinger.operators import names
from wharfinger.sources.adapters import arrival_parts, arrivals, table

# A small authority over the nations' names, to run the cascade on: variants in two cases,
# errors, and coordinates by name.
MAPPING = [("NATION_0", "Alba", 0), ("nation_1", "Bera", 1), ("Nation 2.", "Cora", 2), ("NATION_2", "Cora", 3), ("NATION_3", "NATION_3", 4)]
ERRORS = [("nation_4",), ("order",)]
COORDS = [("NATION_5", 54.0, 10.0, 0), ("nation_6", 45.0, 0.0, 1), ("NATION  7", 60.0, 20.0, 2), ("NATION_8", 30.5, 20.0, 3)]


def authority(spark):
    return spark.createDataFrame(MAPPING, "variant string, canonical string, ordinal int"), spark.createDataFrame(ERRORS, "name string"), spark.createDataFrame(COORDS, "name string, lat double, lon double, ordinal int")


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


PORTS = f"""map(variant, canonical, ordinal) AS (VALUES {values(MAPPING)}), err(name) AS (VALUES ('nation_4'), ('order')), geo(name, lat, lon, ordinal) AS (VALUES {values(COORDS)}),
raw AS (SELECT DISTINCT CASE WHEN origin = 'NATION_9' THEN '' WHEN origin = 'NATION_7' THEN 'Nation, 7 (s)' WHEN origin = 'NATION_10' THEN 'NATION 2' ELSE origin END AS n FROM arr),
sq AS (SELECT n, lower(trim(regexp_replace(regexp_replace(n, '\\s*\\(s\\)\\s*$', ''), '[.,''\\s]+', ' ', 'g'))) AS q FROM raw)"""


def raw_origin():
    o = F.col("origin")
    return F.when(o == "NATION_9", "").when(o == "NATION_7", "Nation, 7 (s)").when(o == "NATION_10", "NATION 2").otherwise(o)


#: c, with what each list has for a name, and after it the choice among them.
CASCADE = f"""c AS (SELECT n,
  (SELECT any_value(canonical) FROM map WHERE variant = n) AS m, (SELECT arg_max(canonical, ordinal) FROM map WHERE lower(variant) = lower(n)) AS mi,
  (SELECT any_value(name) FROM geo WHERE name = n) AS c, (SELECT arg_min(name, ordinal) FROM geo WHERE lower(name) = lower(n)) AS ci,
  (SELECT arg_min(canonical, ordinal) FROM map WHERE lower(trim(regexp_replace(variant, '[.,''\\s]+', ' ', 'g'))) = q) AS ms,
  (SELECT arg_min(name, ordinal) FROM geo WHERE lower(trim(regexp_replace(name, '[.,''\\s]+', ' ', 'g'))) = q) AS cs,
  lower(n) IN (SELECT lower(name) FROM err) AS e FROM sq)"""
CHOSEN = """SELECT n AS port, CASE WHEN n = '' OR e THEN n ELSE coalesce(m, mi, c, ci, ms, cs, n) END AS port_normalized,
  CASE WHEN n = '' THEN 'empty' WHEN e THEN 'error' WHEN coalesce(m, mi) IS NOT NULL THEN 'mapped' WHEN coalesce(c, ci) IS NOT NULL THEN 'canonical' WHEN ms IS NOT NULL THEN 'mapped' WHEN cs IS NOT NULL THEN 'canonical' ELSE 'unmapped' END AS port_status FROM c"""


@query(f"WITH {PORTS}, {CASCADE} {CHOSEN}", arrivals=True)
def port_cascade(spark, d):
    rows = arrivals(spark, d).select(raw_origin().alias("port")).distinct()
    return names.normalise(rows, "port", *authority(spark))


@query(
    f"""WITH {PORTS.replace("ELSE origin END AS n FROM arr)", "ELSE origin END AS n FROM arr UNION SELECT dest FROM arr)")}, {CASCADE}, chosen AS ({CHOSEN}),
two AS (SELECT record_id, CASE WHEN origin = 'NATION_9' THEN '' WHEN origin = 'NATION_7' THEN 'Nation, 7 (s)' WHEN origin = 'NATION_10' THEN 'NATION 2' ELSE origin END AS o, dest FROM arr),
placed AS (SELECT a.port_status AS os, a.port_normalized AS o, b.port_status AS ds, b.port_normalized AS d FROM two JOIN chosen a ON a.port = two.o JOIN chosen b ON b.port = two.dest),
n AS (SELECT 'origin' AS side, os AS status, o AS value, count(*) AS n FROM placed GROUP BY ALL UNION ALL SELECT 'dest', ds, d, count(*) FROM placed GROUP BY ALL),
named AS (SELECT CASE WHEN status = 'unmapped' THEN 'unmapped' ELSE 'known' END AS section, side, value, sum(n) AS n FROM n GROUP BY ALL),
parts AS (
  SELECT 'status' AS section, side, status AS value, sum(n) AS n FROM n GROUP BY ALL
  UNION ALL SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY section, side ORDER BY n DESC, value) <= 5
  UNION ALL SELECT 'pair', 'both', CASE WHEN os IN ('mapped', 'canonical') AND ds IN ('mapped', 'canonical') THEN 'both' WHEN os IN ('mapped', 'canonical') THEN 'origin only' WHEN ds IN ('mapped', 'canonical') THEN 'dest only' ELSE 'neither' END, count(*) FROM placed GROUP BY ALL)
SELECT section, side, value, n::BIGINT AS n, round(100.0::DOUBLE * n / (SELECT count(*) FROM placed), 2) AS percent FROM parts""",
    arrivals=True,
)
def port_coverage_report(spark, d):
    """Both sides' statuses, pairs, and the five names of each side that occur most often."""
    rows = arrivals(spark, d).select(raw_origin().alias("origin"), "dest")
    for side in ("origin", "dest"):
        rows = names.normalise(rows, side, *authority(spark))
    return names.coverage(rows, ("origin", "dest"), top=5, missing=5)


@query(
    """WITH s AS (SELECT merchant, CASE WHEN year % 2 = 0 THEN upper(merchant) ELSE replace(merchant, '#', '# ') END AS name, record_id FROM arr),
k AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, name, count(*) AS n, min(record_id) AS f FROM s GROUP BY ALL)
SELECT key, arg_min(name, (-n, f)) AS canonical, sum(n)::BIGINT AS n, count(*) AS n_forms FROM k GROUP BY key""",
    arrivals=True,
)
def exact_merge(spark, d):
    name = F.when(F.col("year") % 2 == 0, F.upper("merchant")).otherwise(F.replace("merchant", F.lit("#"), F.lit("# ")))
    return names.exact_merge(arrivals(spark, d).select(name.alias("name"), "record_id"), "name", "record_id")


@query()
def fuzzy_merge(spark, d):
    """Names of parts with their maker, as they are and as they are misread (an e as a c, a t as an f, a letter
    left out), with the counts of line items: the rare misreadings meet the names that they come from."""
    k, name = F.pmod("p_partkey", F.lit(40)), F.concat_ws(" ", "p_name", "p_type")
    read = F.when(k == 0, F.replace(name, F.lit("e"), F.lit("c"))).when(k == 1, F.replace(name, F.lit("t"), F.lit("f"))).when(k == 2, F.concat(F.substring(name, 1, 4), F.substring(name, 6, 99))).otherwise(name)
    parts = table(spark, d, "part").select("p_partkey", read.alias("canonical"))
    n = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    often = n.agg(F.expr("percentile(n, 0.75)").cast("long")).first()[0]  # of some hundred names
    return names.fuzzy_merge(n, big=max(often or 1, 1), shortest=8, least=0.9)


@query(f"WITH {PORTS}, k AS (SELECT lower(variant) AS x FROM map UNION SELECT lower(name) FROM err UNION SELECT lower(name) FROM geo) SELECT origin AS port, count(*) AS n FROM arr WHERE lower(origin) NOT IN (SELECT x FROM k) GROUP BY ALL", arrivals=True)
def unmapped_anti(spark, d):
    m, e, c = authority(spark)
    known = m.select(F.col("variant").alias("name")).union(e.select("name")).union(c.select("name"))
    return names.unmapped(arrivals(spark, d).select(F.col("origin").alias("port")), "port", known)


ALIASES = "alias AS (SELECT 'S' || s_suppkey AS variant, 'S' || (s_suppkey * 7 % 40 + (s_suppkey // 40) * 3) AS canonical FROM supplier)"


@query(
    f"""WITH RECURSIVE {ALIASES}, w AS (SELECT variant, [variant, canonical] AS path FROM alias
  UNION ALL SELECT w.variant, list_append(path, a.canonical) FROM w JOIN alias a ON a.variant = path[-1] WHERE len(list_distinct(path)) = len(path)),
t AS (SELECT variant, arg_max(path, len(path)) AS path FROM w GROUP BY variant)
SELECT variant, CASE WHEN len(list_distinct(path)) < len(path) THEN list_min(path) ELSE path[-1] END AS canonical FROM t"""
)
def alias_closure(spark, d):
    k = F.col("s_suppkey")
    alias = table(spark, d, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("variant"), F.concat(F.lit("S"), (k * 7 % 40 + F.floor(k / 40) * 3).cast("string")).alias("canonical"))
    return names.resolve_aliases(alias)


@query(
    """WITH s AS (SELECT s_name AS variant, 'A' AS canonical, 0 AS p FROM supplier UNION ALL SELECT upper(s_name), 'B', 1 FROM supplier),
f AS (SELECT variant, canonical, 0 AS q, p FROM s UNION ALL SELECT upper(variant), canonical, 1, p FROM s UNION ALL SELECT lower(variant), canonical, 1, p FROM s)
SELECT variant, canonical FROM f QUALIFY row_number() OVER (PARTITION BY variant ORDER BY q, p, canonical) = 1"""
)
def authority_merge(spark, d):
    s = table(spark, d, "supplier")
    a = s.select(F.col("s_name").alias("variant"), F.lit("A").alias("canonical"))
    return names.merge_authorities(a, s.select(F.upper("s_name").alias("variant"), F.lit("B").alias("canonical")))


@query(
    """WITH s AS (SELECT s_name AS variant, 'A' AS canonical, 0 AS p FROM supplier UNION ALL SELECT upper(s_name), 'B', 1 FROM supplier UNION ALL SELECT 'New ' || s_name, 'B', 1 FROM supplier),
f AS (SELECT variant, canonical, 0 AS q, p FROM s UNION ALL SELECT upper(variant), canonical, 1, p FROM s UNION ALL SELECT lower(variant), canonical, 1, p FROM s)
SELECT variant, canonical FROM f QUALIFY row_number() OVER (PARTITION BY variant ORDER BY q, p, canonical) = 1"""
)
def authority_merge_all(spark, d):
    """All suppliers; the second source has them in capitals, and further names."""
    s = table(spark, d, "supplier")
    more = s.select(F.explode(F.array(F.upper("s_name"), F.concat(F.lit("New "), "s_name"))).alias("variant"), F.lit("B").alias("canonical"))
    return names.merge_authorities(s.select(F.col("s_name").alias("variant"), F.lit("A").alias("canonical")), more)


@query(
    """WITH s AS (SELECT s_name AS x, s_suppkey AS k FROM supplier),
cs AS (SELECT unnest([x, upper(x), lower(x)]) AS variant, 'A' AS canonical, 1 AS p, -k AS o FROM s UNION ALL
  SELECT unnest([upper(x), lower(x)]), 'B' || k, 0, -k FROM s WHERE k % 3 = 0 UNION ALL SELECT variant, canonical, 2, o FROM (SELECT unnest([upper(x), 'New ' || x]) AS variant, 'C' AS canonical, k AS o FROM s)),
e AS (SELECT unnest([x || '?', upper(x || '?'), lower(x || '?')]) AS name FROM s WHERE k % 3 = 1 UNION SELECT unnest(['Order', 'ORDER', 'order', '(s)', 'Ditto', 'ditto']))
SELECT 'map' AS kind, variant AS name, canonical FROM (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY variant ORDER BY p, o, canonical) = 1) UNION ALL SELECT DISTINCT 'error', name, NULL FROM e"""
)
def authority_reviewed(spark, d):
    """Suppliers as a manual list, a reviewed list with actions, and defaults."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    manual = s.select(F.col("s_name").alias("variant"), F.lit("A").alias("canonical"), k.alias("ordinal"))
    action = F.element_at(F.array(F.lit(" map"), F.lit("Error "), F.lit("ACCEPT")), (k % 3 + 1).cast("int"))
    original = F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("s_name"))).when(k % 3 == 1, F.concat("s_name", F.lit("?"))).otherwise(F.col("s_name"))
    reviewed = s.select(original.alias("original"), action.alias("action"), F.concat(F.lit("B"), k.cast("string")).alias("map_to"), k.alias("ordinal"))
    defaults = s.select(F.explode(F.array(F.upper("s_name"), F.concat(F.lit("New "), "s_name"))).alias("variant"), F.lit("C").alias("canonical"), k.alias("ordinal"))
    mapping, errors = names.reviewed_authority(manual, reviewed, defaults)
    return mapping.select(F.lit("map").alias("kind"), F.col("variant").alias("name"), "canonical").union(errors.select(F.lit("error"), "name", F.lit(None).cast("string")))


@query()
def mojibake(spark, d):
    """Texts of the documents spoilt as if read in Latin-1, and repaired."""
    text = F.col("text")
    spoilt = F.decode(text.cast("binary"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", spoilt.alias("spoilt"), names.repair_mojibake(spoilt).alias("repaired"), text.alias("text"))


@query("SELECT record_id, list_filter(['small', 'large'], lambda x: x = species) || list_filter(['ring', 'bolt'], lambda x: list_contains(forms, x)) AS labels FROM arr", arrivals=True)
def rule_labels(spark, d):
    rows = arrivals(spark, d).select("record_id", F.concat_ws(" ", "species", F.array_join("forms", " ")).alias("t"))
    return rows.select("record_id", r.labels(F.col("t"), [("small", r"^small\b"), ("large", r"^large\b"), ("ring", r"\bring\b"), ("bolt", r"\bbolt\b")]).alias("labels"))


COMMODITIES = [
    "deals and battens", "deal ends", "pit-props", "hewn", "mining timber", "hewn pitch pine", "", "from Quebec", "Smith & Co.", "handspikes", "sawn oak logs", "box-boards", "red pine balks", "sleeper blocks", "white wood planks", "lignum vitae", "firwood oak",
    "fir firwood", "rose wood", "maple blocks and ends", "(Props) &c. do.", "half-sleepers, tim.", "and fire wood", "Waney Pine [ditto]", "masts c. spars", "gun-stocks", "D. Brown", "crossings, riekers", "squared baulks", "batten ends, bats", "pulp", "wood turnery",
]


def matches_sql(text: str, rx: str) -> str:
    """A pattern's match in an engine without look-behind: what it forbids before is taken out first, with what it would match."""
    forbidden = re.findall(r"\(\?<!([a-z ]+)\)", rx)
    plain = re.sub(r"\(\?<![a-z ]+\)", "", rx)
    return f"regexp_matches({text}, '{plain}')" if not forbidden else f"regexp_matches(regexp_replace({text}, '(?:{'|'.join(forbidden)}){plain.removeprefix(chr(92) + 'b')}', '', 'g'), '{plain}')"


def labels_sql(text: str, rules: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {matches_sql(text, rx)} THEN '{n}' END" for n, rx in rules) + "], lambda x: x IS NOT NULL)"


def commodity_sql() -> str:
    clean = "regexp_replace(lower(trim(commodity)), '[()\\[\\]\"]', ' ', 'g')"
    for rx, to in r.FOLDS:
        clean = f"regexp_replace({clean}, '{rx}', '{to}', 'g')"
    phrases = ", ".join(f"'{x}'" for x in COMMODITIES)
    any_of = lambda v: "list_has_any(forms, [" + ", ".join(f"'{x}'" for x in v) + "])"
    return f"""WITH k AS (SELECT [{phrases}][(l_partkey % {len(COMMODITIES)} + 1)::INT] AS commodity, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, trim(regexp_replace({clean}, '\\s+', ' ', 'g'), ' ,.;:-') AS normalized FROM k),
l AS (SELECT *, {labels_sql("normalized", r.form_rules())} AS forms, {labels_sql("normalized", r.species_rules())} AS species FROM c)
SELECT *, CASE WHEN normalized = '' THEN 'empty' WHEN len(forms) + len(species) > 0 THEN 'ok' WHEN regexp_matches(normalized, '^from\\s') THEN 'origin_leak' WHEN regexp_matches(normalized, '{r.MERCHANT_LEAK}') THEN 'merchant_leak' ELSE 'unclassified' END AS status,
  {", ".join(f'{any_of(v)} AS "{k}"' for k, v in r.VALUE_ADDED.items())} FROM l"""


@query(commodity_sql())
def commodity_rules(spark, d):
    """Each line item with a commodity phrase: cleaned, labelled, and its status."""
    phrase = F.element_at(F.array(*map(F.lit, COMMODITIES)), (F.pmod(F.col("l_partkey"), F.lit(len(COMMODITIES))) + 1).cast("int"))
    kinds = table(spark, d, "lineitem").groupBy(phrase.alias("commodity")).agg(F.count(F.lit(1)).alias("n"))
    norm = kinds.withColumn("normalized", r.clean_commodity(F.col("commodity")))
    out = norm.withColumn("forms", r.labels(F.col("normalized"), r.form_rules())).withColumn("species", r.labels(F.col("normalized"), r.species_rules()))
    out = out.withColumn("status", r.commodity_status(F.col("normalized"), F.col("forms"), F.col("species")))
    return out.select("*", *[v.alias(k) for k, v in r.value_added(F.col("forms")).items()])


FIRMS = "CASE c_custkey % 6 WHEN 0 THEN 'Messrs. ' || c_name || ' and Co' WHEN 1 THEN 'to order' WHEN 2 THEN 'The Master' WHEN 3 THEN '&c.' WHEN 4 THEN 'Ditto.' ELSE c_name || ' Bros' END"


@query(
    f"""WITH f AS (SELECT c_custkey, c_name, {FIRMS} AS firm FROM customer)
SELECT c_custkey, firm, CASE c_custkey % 6 WHEN 0 THEN 'named' WHEN 1 THEN 'order' WHEN 2 THEN 'master' WHEN 3 THEN 'none' WHEN 4 THEN 'ditto' ELSE 'named' END AS kind,
  CASE c_custkey % 6 WHEN 0 THEN c_name || ' & Co.' WHEN 5 THEN c_name || ' Bros.' END AS name FROM f"""
)
def placeholder_class(spark, d):
    k, n = F.col("c_custkey") % 6, F.col("c_name")
    firm = F.when(k == 0, F.concat(F.lit("Messrs. "), n, F.lit(" and Co"))).when(k == 1, "to order").when(k == 2, "The Master").when(k == 3, "&c.").when(k == 4, "Ditto.").otherwise(F.concat(n, F.lit(" Bros")))
    rows = table(spark, d, "customer").select("c_custkey", firm.alias("firm"))
    kind = r.firm_kind(F.col("firm"))
    return rows.select("c_custkey", "firm", kind.alias("kind"), F.when(kind == "named", r.clean_firm(F.col("firm"))).alias("name"))


BOX = """CASE WHEN lat IS NULL THEN 'Other' WHEN lat BETWEEN 49.5 AND 61.5 AND lon BETWEEN -11.5 AND 2.2 THEN 'Britain & Ireland' WHEN lon < -30 AND lat >= 43.5 THEN 'British North America' WHEN lon < -30 THEN 'USA & Gulf'
  WHEN lat >= 54 AND lon BETWEEN 4 AND 32 AND NOT (lat < 57.5 AND lon < 14) THEN 'Scandinavia' WHEN lat BETWEEN 53 AND 57.6 AND lon BETWEEN 8 AND 24 THEN 'Germany & Prussia' WHEN (lat >= 53.5 AND lon > 19) OR (lon > 24 AND lat > 40) THEN 'Russia & Baltic'
  WHEN lat < 30 THEN 'Africa & Tropics' WHEN lat < 44 AND lon > -12 THEN 'Iberia & Mediterranean' WHEN (lat BETWEEN 42 AND 52 AND lon BETWEEN -6 AND 9) OR (lat BETWEEN 50 AND 54 AND lon > 2.2 AND lon <= 8) THEN 'France & Low Countries' ELSE 'Other' END"""


@query(f"WITH p AS (SELECT event_id, 20 + event_id * 37 % 450 / 10.0 AS lat, -90 + event_id * 53 % 1300 / 10.0 AS lon FROM events) SELECT event_id, {BOX} AS region FROM p")
def region_case(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", (F.lit(20) + e * 37 % 450 / 10.0).alias("lat"), (F.lit(-90) + e * 53 % 1300 / 10.0).alias("lon"))
    return rows.select("event_id", r.region(F.lit(""), F.col("lat"), F.col("lon")).alias("region"))


@query(
    """SELECT 'Port' AS kind, coalesce(o.name, i.name) AS name, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, NULL::BIGINT AS n FROM (SELECT origin AS name, count(*) AS n_out FROM arr GROUP BY ALL) o FULL JOIN (SELECT dest AS name, count(*) AS n_in FROM arr GROUP BY ALL) i USING (name)
UNION ALL SELECT 'Ship', ship, NULL, NULL, count(*) FROM arr GROUP BY ship UNION ALL SELECT 'Merchant', merchant, NULL, NULL, count(*) FROM arr GROUP BY merchant
UNION ALL SELECT 'Commodity', form, NULL, NULL, count(DISTINCT record_id) FROM lab GROUP BY form UNION ALL SELECT 'Species', species, NULL, NULL, count(*) FROM arr GROUP BY species""",
    arrivals=True,
)
def graph_nodes(spark, d):
    return g.nodes(arrivals(spark, d), arrival_parts(spark, d))


@query(
    """SELECT 'ROUTE' AS kind, origin AS source, dest AS target, year, count(*) AS shipments FROM arr GROUP BY ALL UNION ALL SELECT 'IMPORTED', dest, form, year, count(*) FROM lab GROUP BY ALL
UNION ALL SELECT 'EXPORTED', origin, form, year, count(*) FROM lab GROUP BY ALL UNION ALL SELECT 'RECEIVED_AT', merchant, dest, year, count(*) FROM arr GROUP BY ALL""",
    arrivals=True,
)
def graph_edges(spark, d):
    return g.edges(arrivals(spark, d))


@query("SELECT origin, count(DISTINCT record_id) AS n FROM lab WHERE dest = 'NATION_3' AND form = 'ring' GROUP BY ALL ORDER BY n DESC, origin LIMIT 10", arrivals=True)
def pattern_suppliers(spark, d):
    return g.suppliers(arrivals(spark, d), "NATION_3", "ring")


@query("SELECT merchant, count(*) AS n FROM arr WHERE origin = 'NATION_1' AND dest = 'NATION_3' GROUP BY ALL", arrivals=True)
def pattern_merchants(spark, d):
    return g.firms_between(arrivals(spark, d), "NATION_1", "NATION_3")


@query("SELECT origin AS source, dest AS target, count(*) AS shipments FROM arr WHERE year = 1997 GROUP BY ALL ORDER BY shipments DESC, source, target LIMIT 15", arrivals=True)
def pattern_routes(spark, d):
    return g.busiest(g.edges(arrivals(spark, d)), 1997, 15)


@query("SELECT record_id, strftime(arrived, '%Y-%m-%d') AS iso, origin, dest FROM arr WHERE ship = (SELECT min(s_name) FROM supplier)", arrivals=True)
def pattern_career(spark, d):
    first = table(spark, d, "supplier").agg(F.min("s_name").alias("ship"))
    return g.career(arrivals(spark, d), F.broadcast(first))  # one row


@query("SELECT form, year, count(DISTINCT record_id) AS n FROM lab GROUP BY ALL", arrivals=True)
def pattern_commodity_year(spark, d):
    rows = arrivals(spark, d)
    return g.carried(rows).join(rows.select("record_id", "year"), "record_id").groupBy(F.col("target").alias("form"), "year").agg(F.countDistinct("record_id").alias("n"))
