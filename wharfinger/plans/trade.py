"""Queries of countries, sub-regions, coasts and official tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.operators import trade as t
from wharfinger.sources.adapters import arrivals, table

#: Two lists of nations: all of them by key, then every fifth again, which counts for those.
LISTS = """lists AS (SELECT n_name AS port, CASE WHEN n_nationkey % 5 = 0 THEN 'Gulf' WHEN n_nationkey % 3 = 0 THEN 'North' ELSE 'South' END AS sub FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 <> 0),
sub AS (SELECT arr.*, sub FROM arr LEFT JOIN lists ON port = origin)"""


def lists(spark, d):
    key, n = F.col("n_nationkey"), table(spark, d, "nation")
    first = n.where(key % 7 != 0).select(F.col("n_name").alias("name"), F.when(key % 3 == 0, "North").otherwise("South").alias("group"), F.lit(0).alias("ordinal"))
    return first.union(n.where(key % 5 == 0).select("n_name", F.lit("Gulf"), F.lit(1)))


def regional(spark, d):
    return t.with_group(arrivals(spark, d), "origin", lists(spark, d), "sub")


@query(f"WITH {LISTS} SELECT origin, sub, count(*) AS n FROM sub GROUP BY ALL", arrivals=True)
def country_of_port(spark, d):
    return regional(spark, d).groupBy("origin", "sub").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LISTS}, x AS (SELECT year, lists.sub AS coast, count(*) AS n FROM arr LEFT JOIN lists ON port = dest GROUP BY ALL) SELECT year, coast, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM x", arrivals=True)
def coast_of_dest(spark, d):
    from wharfinger.operators.counts import count_by, share_of

    rows = t.with_group(arrivals(spark, d).select("year", "dest"), "dest", lists(spark, d), "coast")
    return share_of(count_by(rows, "year", "coast"), "n", "year")


SOURCES = ("Russia, Northern Ports", " Canada ", "New Brunswick", "United States of America: Gulf", "Prussia", "World", "Belgium", "Swedenborg", None)
GOODS = ("Timber, hewn: Fir", "Wood, not sawn", "Deals, Battens", "Dye woods: oak", "Staves of all kinds", "Fir Oak Teak", "Wood Pulp", "Lathwood")


def cell(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_cell(values, key):
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][({key} % {len(values)} + 1)::INT]"


@query(
    f"""WITH o AS (SELECT {sql_cell(SOURCES, "l_suppkey")} AS source, {sql_cell(GOODS, "l_partkey")} AS commodity FROM lineitem)
SELECT source, commodity, CASE WHEN source LIKE 'Russia%' THEN 'Russia' WHEN trim(source) IN ('Canada', 'New Brunswick') THEN 'Canada' WHEN source LIKE 'United States%' THEN 'USA' WHEN source = 'Prussia' THEN 'Germany' WHEN source LIKE 'Sweden%' THEN 'Sweden' WHEN source = 'Belgium' THEN 'Other' END AS country,
 CASE commodity WHEN 'Timber, hewn: Fir' THEN 'hewn' WHEN 'Wood, not sawn' THEN 'sawn' WHEN 'Deals, Battens' THEN 'sawn' WHEN 'Staves of all kinds' THEN 'other' WHEN 'Fir Oak Teak' THEN 'hewn' WHEN 'Lathwood' THEN 'other' END AS kind, count(*) AS n FROM o GROUP BY ALL"""
)
def official_names(spark, d):
    rows = table(spark, d, "lineitem").select(cell(SOURCES, "l_suppkey").alias("source"), cell(GOODS, "l_partkey").alias("commodity"))
    n = rows.groupBy("source", "commodity").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "commodity", t.official_country(F.col("source")).alias("country"), t.official_kind(F.col("commodity")).alias("kind"), "n")


@query(
    """WITH o AS (SELECT year(l_shipdate)::INT AS year, n_name AS country, CASE l_partkey % 3 WHEN 0 THEN 'hewn' WHEN 1 THEN 'sawn' END AS kind, l_linestatus AS grade, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'A' AND l_partkey % 3 < 2)
SELECT year, country, coalesce(sum(q) FILTER (kind = 'hewn' AND grade <> 'O'), 0)::DOUBLE AS hewn, coalesce(sum(q) FILTER (kind = 'sawn' AND grade <> 'O'), 0)::DOUBLE AS sawn, count(*) FILTER (grade = 'O') AS c_cells FROM o GROUP BY ALL"""
)
def official_loads(spark, d):
    """Line items as cells of an official table: return flag A is loads, open ones are grade C."""
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("country"))
    rows = table(spark, d, "lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = rows.select(F.year("l_shipdate").alias("year"), "country", cell(("Timber, hewn", "Deals", "Staves"), "l_partkey").alias("commodity"), F.when(F.col("l_returnflag") == "A", "loads").otherwise("tons").alias("unit"), F.when(F.col("l_linestatus") == "O", "C").otherwise("A").alias("grade"), F.col("l_quantity").alias("quantity"))
    return t.official_loads(cells, t.official_kind(F.col("commodity")))


@query(
    f"""WITH {LISTS}, x AS (SELECT year, origin_region, sub, count(*) AS k FROM sub GROUP BY ALL), y AS (SELECT *, sum(k) OVER (PARTITION BY year) AS a, sum(k) OVER (PARTITION BY year, origin_region) AS n FROM x)
SELECT year, sub, n::BIGINT AS n, round(k / n, 6) AS share, round(n / a, 6) AS country_share FROM y WHERE origin_region = 'AMERICA'""",
    arrivals=True,
)
def subregion_trade(spark, d):
    return t.subregion_shares(regional(spark, d), "year", "origin_region", "sub", "AMERICA")


@query(
    f"""WITH {LISTS}, z AS (SELECT sub, count(*) AS size FROM sub WHERE origin_region = 'AMERICA' GROUP BY sub), x AS (SELECT sub, form, count(*) AS n FROM (SELECT sub, unnest(forms) AS form FROM sub WHERE origin_region = 'AMERICA') GROUP BY ALL)
SELECT sub, form, n, round(n / size, 6) AS share FROM x JOIN z USING (sub) QUALIFY row_number() OVER (PARTITION BY sub ORDER BY n DESC, form) <= 7""",
    arrivals=True,
)
def subregion_profiles(spark, d):
    return t.profiles(regional(spark, d).where("origin_region = 'AMERICA' and sub is not null"), "forms", "form", 7, "sub")


@query(
    f"""WITH {LISTS}, x AS (SELECT period, origin, count(*) AS n FROM sub WHERE sub = 'South' AND period IS NOT NULL GROUP BY ALL)
SELECT period, origin, n, round(n / sum(n) OVER (PARTITION BY period), 6) AS share FROM x QUALIFY row_number() OVER (PARTITION BY period ORDER BY n DESC, origin) <= 6""",
    arrivals=True,
)
def subregion_ports(spark, d):
    return t.leading(regional(spark, d).where("sub = 'South' and period is not null"), "origin", 6, "period")


@query(
    f"""WITH {LISTS} SELECT sub, year, count(*) AS n, round(avg((species IN ('red', 'blue'))::INT::DOUBLE), 6) AS pine, round(avg((species = 'old')::INT::DOUBLE), 6) AS spruce FROM sub
WHERE sub IS NOT NULL AND list_contains(forms, 'bolt') AND species IN ('red', 'blue', 'old') GROUP BY ALL HAVING count(*) >= 20""",
    arrivals=True,
)
def species_stated(spark, d):
    rows = regional(spark, d).where(F.col("sub").isNotNull() & F.array_contains("forms", "bolt"))
    return t.stated_shares(rows, {"pine": F.col("species").isin("red", "blue"), "spruce": F.col("species") == "old"}, 20, "sub", "year")


@query(
    """WITH x AS (SELECT dest, origin, count(*) AS k FROM arr GROUP BY ALL), y AS (SELECT dest, count(DISTINCT year) AS n_years FROM arr GROUP BY ALL),
z AS (SELECT dest, sum(k)::BIGINT AS n, sum(k * k) AS sq, max(k) AS m FROM x GROUP BY ALL)
SELECT z.dest, n, n_years, (SELECT min(origin) FROM x WHERE x.dest = z.dest AND x.k = z.m) AS top, round(m / n, 6) AS top_share, round(sq / (n * n), 6) AS hhi FROM z JOIN y ON y.dest = z.dest WHERE n >= 100""",
    arrivals=True,
)
def partner_concentration(spark, d):
    return t.partner_years(arrivals(spark, d), "dest", "origin", "year", 100)


@query(
    """WITH a AS (SELECT origin, dest, year, count(*) AS k FROM arr GROUP BY ALL), c AS (SELECT year, lead(year) OVER (ORDER BY year) AS nxt FROM (SELECT DISTINCT year FROM arr))
SELECT ((k >= 5)::INT + (k >= 12)::INT)::INT AS size, count(*) AS n, round(avg((b.origin IS NOT NULL)::INT::DOUBLE), 6) AS persistence FROM (SELECT a.*, nxt FROM a JOIN c USING (year) WHERE nxt IS NOT NULL) a LEFT JOIN (SELECT origin, dest, year FROM a) b ON a.origin = b.origin AND a.dest = b.dest AND a.nxt = b.year GROUP BY 1""",
    arrivals=True,
)
def persistence_by_size(spark, d):
    return t.persistence_by_size(arrivals(spark, d), "year", [5, 12], "origin", "dest")


@query("WITH x AS (SELECT form, period, dest, count(*) AS n FROM lab WHERE period IS NOT NULL GROUP BY ALL) SELECT form, period, dest, n, round(n / sum(n) OVER (PARTITION BY form, period), 6) AS share FROM x QUALIFY row_number() OVER (PARTITION BY form, period ORDER BY n DESC, dest) = 1", arrivals=True)
def commodity_top_ports(spark, d):
    """The port that each form came to most, early and late."""
    rows = arrivals(spark, d).where("period is not null").select("period", "dest", F.explode("forms").alias("form"))
    return t.leading(rows, "dest", 1, "form", "period")


@query("SELECT merchant, coalesce(lists.sub, '') AS place, year, count(*) AS n FROM arr LEFT JOIN lists ON port = dest WHERE right(merchant, 1) <> '0' GROUP BY ALL".replace("SELECT merchant", f"WITH {LISTS} SELECT merchant", 1), arrivals=True)
def merchant_place_named(spark, d):
    """Named merchants alone (those whose number ends in 0 stand for orders); "" where a port has no group."""
    named = arrivals(spark, d).where(F.right("merchant", F.lit(1)) != "0").select("merchant", "dest", "year")
    rows = t.with_group(named, "dest", lists(spark, d), "place").withColumn("place", F.coalesce("place", F.lit("")))
    return rows.groupBy("merchant", "place", "year").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH o AS (SELECT year(l_shipdate)::INT AS year, n_name AS country, l_returnflag AS u, l_quantity AS q, CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT year, country, coalesce(sum(q) FILTER (u = 'A'), 0) AS q, sum(v) AS v FROM o GROUP BY ALL)
SELECT year, country, round(q / sum(q) OVER (PARTITION BY year), 6) AS quantity_share, round(v / sum(v) OVER (PARTITION BY year), 6) AS value_share FROM g"""
)
def official_shares_by_year(spark, d):
    """Every year; return flag A is loads, and items without a discount have no value."""
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("country"))
    rows = table(spark, d, "lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = rows.select(F.year("l_shipdate").alias("year"), "country", F.when(F.col("l_returnflag") == "A", "loads").otherwise("tons").alias("unit"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("value"))
    return t.official_shares(cells, "year")


@query(
    """WITH x AS (SELECT period, CASE WHEN list_has_any(forms, ['ring', 'bolt']) THEN 'raw' WHEN list_has_any(forms, ['gear', 'anvil']) THEN 'finished' ELSE 'other' END AS kind, origin FROM arr WHERE period IS NOT NULL), n AS (SELECT kind, period, origin, count(*) AS n FROM x GROUP BY ALL)
SELECT kind, period, origin, n, round(n / sum(n) OVER (PARTITION BY kind, period), 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY kind, period ORDER BY n DESC, origin) <= 5""",
    arrivals=True,
)
def category_partners(spark, d):
    """The origins that lead in each category of goods, early and late."""
    has = lambda *v: F.arrays_overlap("forms", F.array(*map(F.lit, v)))
    kind = F.when(has("ring", "bolt"), "raw").when(has("gear", "anvil"), "finished").otherwise("other")
    return t.leading(arrivals(spark, d).where("period is not null").select(kind.alias("kind"), "period", "origin"), "origin", 5, "kind", "period")


@query(
    """WITH z AS (SELECT dest, period, count(*) AS size FROM arr WHERE period IS NOT NULL GROUP BY ALL), x AS (SELECT dest, period, form, count(*) AS n FROM lab WHERE period IS NOT NULL GROUP BY ALL)
SELECT dest, period, form, n, round(n / size, 6) AS share FROM x JOIN z USING (dest, period) QUALIFY row_number() OVER (PARTITION BY dest, period ORDER BY n DESC, form) <= 5""",
    arrivals=True,
)
def port_profiles(spark, d):
    """What came to each port, early and late."""
    return t.profiles(arrivals(spark, d).where("period is not null"), "forms", "form", 5, "dest", "period")
