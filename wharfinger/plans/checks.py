"""Queries of the field checks, the levels of the cube, issue dates and coasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.functions import grammar, text
from wharfinger.functions import rules as r
from wharfinger.operators import audit as a
from wharfinger.operators import counts as c
from wharfinger.sources.adapters import arrivals, page_lines, table

LEVELS = """SELECT '{0}' AS level, {1} AS origin, {2} AS dest, year, NULL::VARCHAR AS form, count(*) AS n FROM arr GROUP BY ALL
UNION ALL SELECT '{0}', {1}, {2}, year, form, count(*) FROM lab GROUP BY ALL"""
NONE = "NULL::VARCHAR"


@query(" UNION ALL ".join(LEVELS.format(*x) for x in (("route", "origin", "dest"), ("imports", NONE, "dest"), ("exports", "origin", NONE))), arrivals=True)
def cube_levels(spark, d):
    return c.cube_levels(arrivals(spark, d), "forms", "form", "origin", "dest", "year")


@query("SELECT issue, count(*) AS n, count(*) FILTER (len(forms) = 1 OR quantity < 8) AS empty, round(count(*) FILTER (len(forms) = 1 OR quantity < 8) / count(*), 3) AS rate FROM arr GROUP BY issue HAVING empty > 0.2::DOUBLE * n", arrivals=True)
def high_empty_files(spark, d):
    return a.many_empty(arrivals(spark, d), "issue", (F.size("forms") == 1) | (F.col("quantity") < 8))


#: Names with goods, dates, amounts and consignees in the wrong field, from each line item.
SPOILT = """CASE l_orderkey % 5 WHEN 0 THEN 'Port ' || l_suppkey || '-Timber, 4' WHEN 1 THEN 'Port ' || l_suppkey || ' & Co.' WHEN 2 THEN 'Port, etc. ' || l_suppkey WHEN 3 THEN 'Border ' || l_suppkey ELSE 'Order' END AS port,
CASE l_partkey % 6 WHEN 0 THEN 'Jan. ' || l_suppkey WHEN 1 THEN '3 dec Anna' WHEN 2 THEN 'Anna 40 pcs. oak' WHEN 3 THEN '5/6 Ida' WHEN 4 THEN '12 red deals' ELSE 'Vesta ' || l_suppkey || ' pcs' END AS ship"""


def spoilt_fields():
    k, n = F.col("l_suppkey").cast("string"), F.lit
    port = F.when(F.col("l_orderkey") % 5 == 0, F.concat(n("Port "), k, n("-Timber, 4"))).when(F.col("l_orderkey") % 5 == 1, F.concat(n("Port "), k, n(" & Co."))).when(F.col("l_orderkey") % 5 == 2, F.concat(n("Port, etc. "), k)).when(F.col("l_orderkey") % 5 == 3, F.concat(n("Border "), k)).otherwise("Order")
    ship = F.element_at(F.array(F.concat(n("Jan. "), k), n("3 dec Anna"), n("Anna 40 pcs. oak"), n("5/6 Ida"), n("12 red deals"), F.concat(n("Vesta "), k, n(" pcs"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    return port, ship


def spoilt(spark, d):
    port, ship = spoilt_fields()
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", port.alias("port"), ship.alias("ship"))


@query(
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {SPOILT} FROM lineitem)
SELECT l_orderkey, l_linenumber, regexp_matches(lower(port), '& co|& sons?|& cie|\\b(order|limited|agents?)\\b|\\b(bros|ltd)') AS consignee_in_port,
 regexp_matches(lower(ship), '^((jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\\.?\\s*[0-9]|[0-9]{{1,2}}\\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|[0-9]{{1,2}}/[0-9]{{1,2}}|[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.)') AS date_in_ship,
 regexp_matches(lower(ship), '[0-9]\\s*(pcs\\.|lds\\.|stds\\.|loads|pieces|tons|cwt\\.|fathoms)|^[0-9]+\\s+\\w+\\s+(deals|boards)') AS amount_in_ship FROM s"""
)
def misplaced_fields(spark, d):
    return spoilt(spark, d).select("l_orderkey", "l_linenumber", r.names_consignee(F.col("port")).alias("consignee_in_port"), r.begins_with_date(F.col("ship")).alias("date_in_ship"), r.holds_amount(F.col("ship")).alias("amount_in_ship"))


@query(
    f"""WITH s AS (SELECT {SPOILT} FROM lineitem), p AS (SELECT port, CASE WHEN contains(lower(port), '-timber') THEN strpos(lower(port), '-timber') WHEN contains(lower(port), ', etc.') THEN strpos(lower(port), ', etc.') END AS i FROM s)
SELECT 'port_cargo_split' AS rule, port AS value, trim(port[1:i - 1]) AS port, trim(port[i:], ' -,') AS goods, count(*) AS n FROM p WHERE i IS NOT NULL GROUP BY ALL"""
)
def port_fix_rules(spark, d):
    """The rule that splits each port written with its goods."""
    rows = spoilt(spark, d).withColumn("fix", r.port_and_goods(F.col("port"))).where("fix is not null")
    return rows.groupBy(F.lit("port_cargo_split").alias("rule"), F.col("port").alias("value"), F.col("fix.port").alias("port"), F.col("fix.goods").alias("goods")).agg(F.count(F.lit(1)).alias("n"))


#: File names of an issue in the three spellings, from each order.
FILES = """CASE o_orderkey % 4 WHEN 0 THEN (1870 + o_custkey % 40) || lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0') || '08J_p001' WHEN 1 THEN 'Journal March ' || (o_custkey % 28 + 1) || ', 18' || (50 + o_custkey % 50) || ' p2' WHEN 2 THEN 'Journal 18' || (50 + o_custkey % 50) ELSE 'Journal' END"""


def file_names(spark, d):
    k, n, text_ = F.col("o_orderkey"), F.col("o_custkey"), lambda x: x.cast("string")
    name = F.when(k % 4 == 0, F.concat(text_(1870 + n % 40), F.lpad(text_(k % 12 + 1), 2, "0"), F.lit("08J_p001"))).when(k % 4 == 1, F.concat(F.lit("Journal March "), text_(n % 28 + 1), F.lit(", 18"), text_(50 + n % 50), F.lit(" p2"))).when(k % 4 == 2, F.concat(F.lit("Journal 18"), text_(50 + n % 50))).otherwise("Journal")
    return table(spark, d, "orders").select("o_orderkey", name.alias("source_file"))


@query(
    f"""WITH f AS (SELECT o_orderkey, {FILES} AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(s, '^[0-9]{{8}}') THEN s[1:4]::INT ELSE nullif(regexp_extract(s, '(18[0-9][0-9]|1900)'), '')::INT END AS year,
 CASE WHEN regexp_matches(s, '^[0-9]{{8}}') THEN s[5:6]::INT WHEN contains(s, 'March') THEN 3 END AS month, coalesce(nullif(regexp_extract(s, '18[7-9][0-9]'), ''), 'unknown') AS audit_year FROM f"""
)
def issue_months(spark, d):
    rows = file_names(spark, d)
    year, month = text.issue_month(F.col("source_file"))
    return rows.select("o_orderkey", year.alias("year"), month.alias("month"), text.audit_year(F.col("source_file")).alias("audit_year"))


@query(
    f"""WITH f AS (SELECT o_orderkey, {FILES} AS s FROM orders),
n AS (SELECT CASE WHEN o_orderkey % 4 = 0 AND s[1:4]::INT <= 1900 THEN s[1:4] || '-' || s[5:6] || '-08' WHEN o_orderkey % 4 = 1 THEN regexp_extract(s, '18[0-9][0-9]') || '-03-' || lpad(regexp_extract(s, 'March ([0-9]+)', 1), 2, '0') END AS new, CASE WHEN o_orderkey % 3 = 0 THEN '1800-01-01' END AS old FROM f)
SELECT count(*) FILTER (new IS DISTINCT FROM old) AS stamped, count(*) FILTER (new IS DISTINCT FROM old AND new IS NULL) AS unresolvable FROM n"""
)
def issue_backfill(spark, d):
    rows = file_names(spark, d).withColumn("issue_date", F.when(F.col("o_orderkey") % 3 == 0, "1800-01-01"))
    return a.stamped(rows, "source_file", "issue_date", text.issue_date(F.col("source_file")))[1]


@query("SELECT c_custkey, CASE WHEN lon < -5.3 AND lat > 51.3 AND lat < 55.5 THEN 'Ireland' WHEN lon > -2.8 THEN 'GB east' ELSE 'GB west' END AS coast FROM (SELECT c_custkey, 50 + c_custkey % 9::DOUBLE AS lat, c_custkey % 12 - 10.0::DOUBLE AS lon FROM customer)")
def coast_of_point(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (50 + F.col("c_custkey") % 9).cast("double").alias("lat"), (F.col("c_custkey") % 12 - 10).cast("double").alias("lon"))
    return rows.select("c_custkey", r.coast(F.col("lat"), F.col("lon")).alias("coast"))


@query("SELECT DISTINCT lower(trim(regexp_replace(v, '[.,''\\s]+', ' ', 'g'))) AS name FROM (SELECT n_name AS v FROM nation UNION ALL SELECT s_name FROM supplier UNION ALL SELECT r_name FROM region) WHERE length(v) >= 3 AND regexp_matches(v, '[A-Za-z]{3}') AND lower(trim(regexp_replace(v, '[.,''\\s]+', ' ', 'g'))) NOT IN ('russia', 'england', 'scotland', 'ireland', 'america', 'france', 'canada', 'order', 'quebec and montreal')")
def port_gazetteer(spark, d):
    region, supplier = table(spark, d, "region").select("r_name"), table(spark, d, "supplier").select("s_name")
    mapping = supplier.select(F.col("s_name").alias("variant"), F.lit(None).cast("string").alias("canonical")).union(region.select(F.lit(None).cast("string"), "r_name"))
    return grammar.gazetteer(table(spark, d, "nation").select(F.col("n_name").alias("name")), mapping)


@query("SELECT source_file, reg AS style FROM (SELECT source_file, CASE WHEN a = 0 AND b = 0 THEN 'not_found' WHEN a > 3 * b THEN 'individual' WHEN b > 3 * a THEN 'aggregated' WHEN a > 0 AND b > 0 THEN 'mixed' ELSE 'unclear' END AS reg FROM (SELECT source_file, sum(len(regexp_extract_all(text, '@|\\(s\\)|-[A-Z][a-z]+-'))) AS a, sum(len(regexp_extract_all(lower(text), '\\b(total|various|sundry)\\b'))) AS b FROM ln GROUP BY source_file))", lines=True)
def reporting_styles(spark, d):
    """How each page names its ships; its lines are put together first."""
    whole = page_lines(spark, d).groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.select("source_file", a.reporting_style(F.col("text")).alias("style"))


def first_mark_sql(value: str, patterns: tuple[str, ...]) -> str:
    """rules.first_mark in SQL."""
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '(?i){p}') THEN '{p}'" for p in patterns) + " END"


@query(
    f"""WITH s AS (SELECT {SPOILT} FROM lineitem),
m AS (SELECT unnest([struct_pack(field := 'consignee_in_port', pattern := {first_mark_sql("port", r.CONSIGNEE_PATTERNS)}), struct_pack(field := 'date_in_ship', pattern := {first_mark_sql("ship", r.DATE_PATTERNS)}), struct_pack(field := 'amount_in_ship', pattern := {first_mark_sql("ship", r.AMOUNT_PATTERNS)})]) AS m FROM s)
SELECT m.field AS field, m.pattern AS pattern, count(*) AS n FROM m WHERE m.pattern IS NOT NULL GROUP BY ALL"""
)
def misplaced_patterns(spark, d):
    """How often each pattern is the first that a misplaced field has."""
    marks = [("consignee_in_port", "port", r.CONSIGNEE_PATTERNS), ("date_in_ship", "ship", r.DATE_PATTERNS), ("amount_in_ship", "ship", r.AMOUNT_PATTERNS)]
    found = F.array(*[F.struct(F.lit(name).alias("field"), r.first_mark(F.col(c), p).alias("pattern")) for name, c, p in marks])
    return spoilt(spark, d).select(F.explode(found).alias("m")).where("m.pattern is not null").groupBy("m.field", "m.pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH f AS (SELECT {FILES} || CASE WHEN o_orderkey % 3 = 0 THEN ' of ' || (1865 + o_custkey % 50) ELSE '' END AS s FROM orders),
y AS (SELECT coalesce(regexp_extract_all(s, '18[789][0-9]')[-1], 'unk') AS last_year,
  CASE WHEN try_cast(regexp_extract(s, '^([0-9]{{4}})', 1) AS INT) BETWEEN 1870 AND 1910 THEN regexp_extract(s, '^([0-9]{{4}})', 1)::INT ELSE nullif(regexp_extract(s, '18[0-9]{{2}}'), '')::INT END AS bounded_year FROM f)
SELECT last_year, bounded_year, count(*) AS n FROM y GROUP BY ALL"""
)
def file_years(spark, d):
    """Files by the years that the spot check and the bounded reading find in their names, some of which hold two."""
    names = file_names(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    name = F.concat("source_file", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" of "), (1865 + F.col("o_custkey") % 50).cast("string"))).otherwise(""))
    return names.groupBy(text.last_year(name).alias("last_year"), text.bounded_year(name).alias("bounded_year")).agg(F.count(F.lit(1)).alias("n"))


def header_sql(port: str) -> str:
    p = port.replace("'", "''")
    return f"CASE WHEN regexp_matches(t, '(?im)^{p}\\.?\\s*$') OR regexp_matches(t, '(?i){p}\\s*\\n') THEN '{p}' END"


HEADERS = "list_value(" + ", ".join("'" + p.replace("'", "''") + "'" for p in a.MAJOR_PORTS) + ")"


@query(
    f"""WITH p AS (SELECT source, CASE doc_id % 4 WHEN 0 THEN lower(h) || '.' || chr(10) WHEN 1 THEN h || ', Docks' || chr(10) WHEN 2 THEN 'At ' || h || chr(10) ELSE '' END || text || CASE WHEN doc_id % 4 = 3 THEN chr(10) || h ELSE '' END AS t
  FROM (SELECT *, ({HEADERS})[doc_id % 26 + 1] AS h FROM documents)),
f AS (SELECT source, unnest(list_filter([{", ".join(map(header_sql, a.MAJOR_PORTS))}], lambda x: x IS NOT NULL)) AS port FROM p)
SELECT source, port, count(*) AS pages FROM f GROUP BY ALL"""
)
def port_header_survey(spark, d):
    """Pages of each source by the ports whose headers they have; a header is put to each text, in four ways of which three count."""
    k, line = F.col("doc_id") % 4, F.lit("\n")
    h = F.element_at(F.array(*map(F.lit, a.MAJOR_PORTS)), (F.col("doc_id") % 26 + 1).cast("int"))
    head = F.when(k == 0, F.concat(F.lower(h), F.lit("."), line)).when(k == 1, F.concat(h, F.lit(", Docks"), line)).when(k == 2, F.concat(F.lit("At "), h, line)).otherwise("")
    whole = F.concat(head, "text", F.when(k == 3, F.concat(line, h)).otherwise(""))
    pages = table(spark, d, "documents").select("source", F.explode(a.port_headers(whole)).alias("port"))
    return pages.groupBy("source", "port").agg(F.count(F.lit(1)).alias("pages"))


@query(
    f"""WITH c AS ({" UNION ALL ".join(LEVELS.format(*x) for x in (("route", "origin", "dest"), ("imports", NONE, "dest"), ("exports", "origin", NONE)))}),
p AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT origin AS x FROM c UNION SELECT dest FROM c) WHERE x IS NOT NULL),
f AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT form AS x FROM c WHERE form IS NOT NULL))
SELECT level, o.i::INT AS o, e.i::INT AS d, coalesce(f.i, -1)::INT AS f, year, n FROM c LEFT JOIN p o ON o.x = origin LEFT JOIN p e ON e.x = dest LEFT JOIN f ON f.x = form""",
    arrivals=True,
)
def compact_cube(spark, d):
    return c.compact(cube_levels(spark, d))[2]
