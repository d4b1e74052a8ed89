"""Further statistics and name work."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.functions import grammar
from wharfinger.operators import counts as c
from wharfinger.operators import names
from wharfinger.operators import series as s
from wharfinger.plans.entities import CASCADE, CHOSEN, PORTS, authority, raw_origin
from wharfinger.plans.statistics import SEGMENTS, drawn_sql, levels_sql, monthly
from wharfinger.sources.adapters import arrivals, table
from wharfinger.sources.files import saved


@query(
    f"""WITH {SEGMENTS}, n AS (SELECT origin_region, max(k) AS n FROM o GROUP BY ALL),
b AS (SELECT x.origin_region, x.j AS brk, x.ssr + y.ssr AS ssr FROM e x JOIN e y ON x.origin_region = y.origin_region AND y.i = x.j + 1 JOIN n ON n.origin_region = x.origin_region WHERE x.i = 1 AND y.j = n),
w AS (SELECT origin_region, arg_min(brk, ssr) AS brk FROM b GROUP BY ALL)
SELECT o.origin_region, (k > brk)::INT::BIGINT AS segment, count(*) AS n, round(regr_slope(v, t), 6) AS slope, round(avg(v), 6) AS mean FROM o JOIN w USING (origin_region) GROUP BY ALL""",
    arrivals=True,
)
def segment_slopes(spark, d):
    e = s.segment_errors(monthly(spark, d), "t", "v", "origin_region", least=8)
    one = s.best_breaks(e, "origin_region", 1).where("m = 1")
    return s.segment_slopes(monthly(spark, d), one, "t", "v", "origin_region")


@query(
    f"""WITH {levels_sql(4)}
SELECT o.origin_region, len(list_filter(breaks, lambda b: b < k)) AS segment, count(*) AS n, round(regr_slope(v, t), 6) AS slope, round(avg(v), 6) AS mean FROM o JOIN best USING (origin_region) GROUP BY ALL""",
    arrivals=True,
)
def segment_slopes_4(spark, d):
    """Of the segments between the breaks, 0 to 4, that BIC chooses."""
    e = saved(s.segment_errors(monthly(spark, d), "t", "v", "origin_region", least=8))
    best = s.by_bic(s.best_breaks(e, "origin_region", 4), "origin_region")
    breaks = F.transform(F.filter(F.split("breaks", ","), lambda b: b != ""), lambda b: b.cast("int"))
    return s.segment_slopes(monthly(spark, d), best.withColumn("breaks", breaks), "t", "v", "origin_region")


@query(
    f"""WITH g AS (SELECT year, issue, count_if(origin_region = 'ASIA') AS x, count(*) AS n FROM arr GROUP BY ALL),
w AS (SELECT rep, year, x, n, {drawn_sql("rep || ':' || year || ':' || issue")} AS w FROM g, range(1000) t(rep)),
m AS (SELECT rep, year, sum(w * x) / nullif(sum(w * n), 0) AS m FROM w GROUP BY ALL),
b AS (SELECT rep, regr_slope(m, year) AS b FROM m GROUP BY rep HAVING b IS NOT NULL),
p AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS p FROM b)
SELECT (SELECT round(regr_slope(m, year), 6) FROM (SELECT year, sum(x) / sum(n) AS m FROM g GROUP BY year)) AS slope,
  round(max(b) FILTER (p = 25), 6) AS low, round(max(b) FILTER (p = 975), 6) AS high, round(avg((b < 0)::INT::DOUBLE), 6) AS falling FROM p""",
    arrivals=True,
)
def bootstrap_trend(spark, d):
    g = arrivals(spark, d).groupBy("year", "issue").agg(F.count_if(F.col("origin_region") == "ASIA").alias("x"), F.count(F.lit(1)).alias("n"))
    return s.bootstrap_trend(g, "issue", "year", "x", "n", 1000, 25, 975)


STATUSES = ["mapped", "canonical", "error", "unmapped", "empty"]
TWO = "x AS (SELECT year, avg((origin_region = 'ASIA')::INT::DOUBLE) AS v FROM arr WHERE NOT steam AND year < 2001 GROUP BY year), z AS (SELECT year, avg((origin_region = 'ASIA')::INT::DOUBLE) AS v FROM arr WHERE steam AND year > 1995 GROUP BY year), both_ AS (SELECT year, x.v AS a, z.v AS b FROM x FULL JOIN z USING (year))"


def two_series(spark, d):
    rows = arrivals(spark, d).select("year", "steam", (F.col("origin_region") == "ASIA").cast("double").alias("o"))
    one = lambda on: rows.where(on).groupBy("year").agg(F.avg("o").alias("v"))
    return s.triangulate(one("not steam and year < 2001"), one("steam and year > 1995"), "year", "v")


@query(f"WITH {TWO} SELECT year, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS difference, round(a / b, 6) AS ratio FROM both_", arrivals=True)
def triangulation(spark, d):
    return two_series(spark, d).withColumn("a", F.round("a", 6)).withColumn("b", F.round("b", 6))


@query(f"WITH {TWO} SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mae FROM both_ WHERE a IS NOT NULL AND b IS NOT NULL", arrivals=True)
def agreement_mae(spark, d):
    return s.agreement(two_series(spark, d))


@query(
    """WITH g AS (SELECT year, origin_region, count(*) FILTER (steam) AS s, count(*) FILTER (NOT steam) AS t FROM arr GROUP BY ALL),
full_ AS (SELECT * FROM (SELECT DISTINCT year FROM arr), (SELECT DISTINCT origin_region FROM arr))
SELECT year, bool_and(coalesce(s, 0) > 0 AND coalesce(t, 0) > 0) AS clean FROM full_ LEFT JOIN g USING (year, origin_region) GROUP BY year""",
    arrivals=True,
)
def clean_years(spark, d):
    rows = arrivals(spark, d)
    kinds = rows.groupBy("year", "origin_region").agg(F.count_if("steam").alias("s"), F.count_if(~F.col("steam")).alias("t"))
    grid = rows.select("year").distinct().crossJoin(rows.select("origin_region").distinct())
    full = grid.join(kinds, ["year", "origin_region"], "left").fillna(0)
    return full.groupBy("year").agg(F.bool_and((F.col("s") > 0) & (F.col("t") > 0)).alias("clean"))


@query(
    """WITH a AS (SELECT origin, sum(quantity) FILTER (steam) AS q, count(*) FILTER (NOT steam) AS n FROM arr WHERE year = 1998 GROUP BY ALL)
SELECT origin, q AS quantity, n, round(q / sum(q) OVER (), 6) AS quantity_share, round(n / sum(n) OVER (), 6) AS count_share FROM a""",
    arrivals=True,
)
def official_shares(spark, d):
    from pyspark.sql.window import Window as W

    rows = arrivals(spark, d).where("year = 1998").groupBy("origin").agg(F.sum(F.when(F.col("steam"), F.col("quantity"))).alias("quantity"), F.count_if(~F.col("steam")).alias("n"))
    every = W.partitionBy(F.lit(1))
    return rows.select("*", F.round(F.col("quantity") / F.sum("quantity").over(every), 6).alias("quantity_share"), F.round(F.col("n") / F.sum("n").over(every), 6).alias("count_share"))


@query(
    """WITH p AS (SELECT coast, form, period, count(*) AS n FROM lab WHERE period IS NOT NULL GROUP BY ALL), h AS (SELECT *, n / sum(n) OVER (PARTITION BY coast, period) AS s FROM p),
w AS (SELECT coast, form, coalesce(max(s) FILTER (period = 'early'), 0) AS e, coalesce(max(s) FILTER (period = 'late'), 0) AS l FROM h GROUP BY ALL)
SELECT coast, form, round(e, 6) AS early, round(l, 6) AS late, CASE WHEN l > e + 0.003 THEN 'converging' WHEN l < e - 0.003 THEN 'diverging' ELSE 'stable' END AS label FROM w""",
    arrivals=True,
)
def form_shift_labels(spark, d):
    from pyspark.sql.window import Window as W

    n = c.count_by(arrivals(spark, d).where("period is not null").select("coast", "period", F.explode("forms").alias("form")), "coast", "form", "period")
    h = n.withColumn("s", F.col("n") / F.sum("n").over(W.partitionBy("coast", "period")))
    side = lambda p: F.coalesce(F.max(F.when(F.col("period") == p, F.col("s"))), F.lit(0.0))
    w = h.groupBy("coast", "form").agg(side("early").alias("e"), side("late").alias("l"))
    label = F.when(F.col("l") > F.col("e") + 0.003, "converging").when(F.col("l") < F.col("e") - 0.003, "diverging").otherwise("stable")
    return w.select("coast", "form", F.round("e", 6).alias("early"), F.round("l", 6).alias("late"), label.alias("label"))


@query(
    f"""WITH {PORTS}, {CASCADE}, chosen AS ({CHOSEN}), o AS (SELECT issue, CASE WHEN origin = 'NATION_9' THEN '' WHEN origin = 'NATION_7' THEN 'Nation, 7 (s)' WHEN origin = 'NATION_10' THEN 'NATION 2' ELSE origin END AS port FROM arr)
SELECT issue, count(*) AS n, {", ".join(f"count(*) FILTER (port_status = '{x}') AS {x}" for x in STATUSES)} FROM o JOIN chosen USING (port) GROUP BY issue""",
    arrivals=True,
)
def port_coverage(spark, d):
    """Rows of each month by what became of their origin."""
    rows = names.normalise(arrivals(spark, d).select("issue", raw_origin().alias("port")), "port", *authority(spark))
    return names.status_counts(rows, "issue", "port_status", STATUSES)


@query()
def port_suggestions(spark, d):
    m, errors, geo = authority(spark)
    known = m.select(F.col("canonical").alias("name")).union(geo.select("name"))
    settled = m.select(F.col("variant").alias("name")).union(errors.select("name")).union(geo.select("name"))
    return names.suggestions(c.count_by(arrivals(spark, d).select(F.col("origin").alias("port")), "port"), "port", known, settled=settled)


@query(
    """WITH f AS (SELECT s_name AS name, s_acctbal AS lat, 1.0::DOUBLE AS lon, 0 AS p FROM supplier UNION ALL SELECT upper(s_name), s_acctbal, 2.0, 1 FROM supplier),
g AS (SELECT name, lat, lon, 0 AS q, p FROM f UNION ALL SELECT upper(name), lat, lon, 1, p FROM f UNION ALL SELECT lower(name), lat, lon, 1, p FROM f)
SELECT name, lat, lon FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY q, p, lat, lon) = 1"""
)
def coordinate_merge(spark, d):
    t = table(spark, d, "supplier")
    a = t.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("lat"), F.lit(1.0).alias("lon"))
    return names.merge_coordinates(a, t.select(F.upper("s_name").alias("name"), F.col("s_acctbal").alias("lat"), F.lit(2.0).alias("lon")))


@query(
    """WITH f AS (SELECT s_name AS name, s_acctbal AS lat, 1.0::DOUBLE AS lon, 0 AS p FROM supplier UNION ALL SELECT upper(s_name), s_acctbal, 2.0, 1 FROM supplier UNION ALL SELECT 'New ' || s_name, s_acctbal, 2.0, 1 FROM supplier),
g AS (SELECT name, lat, lon, 0 AS q, p FROM f UNION ALL SELECT upper(name), lat, lon, 1, p FROM f UNION ALL SELECT lower(name), lat, lon, 1, p FROM f)
SELECT name, lat, lon FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY q, p, lat, lon) = 1"""
)
def coordinate_merge_all(spark, d):
    """All suppliers; the second source has them in capitals, and further names."""
    t = table(spark, d, "supplier")
    a = t.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("lat"), F.lit(1.0).alias("lon"))
    more = t.select(F.explode(F.array(F.upper("s_name"), F.concat(F.lit("New "), "s_name"))).alias("name"), F.col("s_acctbal").alias("lat"), F.lit(2.0).alias("lon"))
    return names.merge_coordinates(a, more)


#: Shapes of lines, by what is left of a line item's quantity: {ship}, {place} and {q} are the row's own.
SHAPES = {
    "dash": ("{ship} (s)-{place}-{q} pcs. deals-Order", "{ship}-{place}-{q} lds. oak, 1,200 fms. firewood-Price & Co.", "{ship}-{q} pcs. deals, Order", "{q} pcs. deals, 3 lds. oak; 4 bdls. laths", "{ship}-St. Petersburg"),
    "at": ("{ship} @ {place},—{q} lds. oak, Price & Co.", "Pitwood.—{ship} (s) @ {place},—{q} lds., Order", "{ship} @ {place}, &c.,—{q} doz. battens; 2 t. firewood, Order. A quantity came late."),
    "rescue": ("{ship} Riga {q} battens", "{ship} (s) New York {q} deals Price & Co.", "{ship} Memel Lavender Dock", "{ship} Nowhere {q} deals", "{ship} St. Johns Riga qty. staves, Order"),
}
#: What is read from each: ship, steam, origin, consignee, items and confidence.
ANSWERS = {
    "dash": (
        "ship, true, place, 'Order', [(q, 'pcs.', 'deals')], 'high'", "ship, false, place, 'Price & Co', [(q, 'lds.', 'oak'), ('1,200', 'fms.', 'firewood')], 'high'",
        "ship, false, '', 'Order', [(q, 'pcs.', 'deals')], 'medium'", "'', false, '', NULL, [(q, 'pcs.', 'deals'), ('3', 'lds.', 'oak'), ('4', 'bdls.', 'laths')], 'low'", "ship, false, 'St. Petersburg', NULL, [(NULL, NULL, NULL)], 'medium'",
    ),
    "at": (
        "ship, false, place, 'Price & Co.', [(q, 'lds.', 'oak')], 'high'", "ship, true, place, 'Order', [(q, 'lds.', 'pitwood')], 'high'",
        "ship, false, place, 'Order', [(q, 'doz.', 'battens'), ('2', 't.', 'firewood')], 'high'",
    ),
    "rescue": (
        "ship, false, 'Riga', NULL, [(q, NULL, 'battens')], 'medium'", "ship, true, 'New York', 'Price & Co.', [(q, NULL, 'deals')], 'medium'", "ship, false, 'Memel', NULL, [(NULL, NULL, NULL)], 'medium'",
        "ship || ' Nowhere ' || q || ' deals', false, '', NULL, [(NULL, NULL, NULL)], 'low'", "ship || ' St. Johns', false, 'Riga', 'Order', [('qty.', NULL, 'staves')], 'medium'",
    ),
}


def written(spark, d, kind):
    """Line items written out as lines of the arrival columns, in several shapes. Lines are gone through
    twice, so they are dealt anew: Spark makes that shuffle once."""
    q, rows = F.col("quantity").cast("int"), arrivals(spark, d).select("record_id", "ship", "origin", "quantity")
    given = {"ship": F.initcap(F.regexp_replace("ship", "[^A-Za-z]", "")), "place": F.initcap(F.replace("origin", F.lit("_"), F.lit(""))), "q": q.cast("string")}
    line = F.lit(None).cast("string")
    for k, shape in enumerate(SHAPES[kind]):
        parts = [given[x] if j % 2 else F.lit(x) for j, x in enumerate(re.split(r"\{(\w+)\}", shape))]
        line = F.when(q % len(SHAPES[kind]) == k, F.concat(*parts)).otherwise(line)
    return rows.select("record_id", line.alias("line")).repartition("record_id")


def read_sql(kind: str) -> str:
    columns = ("ship", "steam", "origin", "consignee", "items", "confidence")
    def row(answer: str) -> str:
        head, items, tail = re.match(r"(.*), (\[.*\]), (.*)", answer).groups()
        items = re.sub(r"\(([^,]*(?:'[^']*')?), ([^,]*), ([^)]*)\)", r"{'a': \1::VARCHAR, 'b': \2::VARCHAR, 'c': \3::VARCHAR}", items.replace("'1,200'", "'1@200'"))
        return "SELECT record_id, " + ", ".join(f"{v} AS {c}" for c, v in zip(columns, [*head.split(", "), items, tail], strict=True))

    each = " UNION ALL ".join(f"{row(a)} FROM x WHERE q::INT % {len(ANSWERS[kind])} = {k}" for k, a in enumerate(ANSWERS[kind]))
    return f"""WITH x AS (SELECT record_id, regexp_replace(ship, '[^A-Za-z]', '', 'g') AS ship, upper(o[1:1]) || lower(o[2:]) AS place, quantity::INT::VARCHAR AS q FROM (SELECT *, replace(origin, '_', '') AS o FROM arr)),
a AS ({each})
SELECT record_id, ship, steam, origin, consignee, replace(i.a, '@', ',') AS quantity, i.b AS unit, i.c AS commodity, confidence FROM (SELECT *, unnest(items) AS i FROM a)"""


def read(spark, d, kind, ports=None):
    rows = grammar.parse_distinct(written(spark, d, kind), "line", ports)
    return rows.select("record_id", "ship", "steam", "origin", "consignee", F.explode_outer("cargo").alias("i"), "confidence").select("record_id", "ship", "steam", "origin", "consignee", "i.quantity", "i.unit", "i.commodity", "confidence")


@query(read_sql("dash"), arrivals=True)
def dash_parse(spark, d):
    return read(spark, d, "dash")


@query(read_sql("at"), arrivals=True)
def at_parse(spark, d):
    return read(spark, d, "at")


@query(read_sql("rescue"), arrivals=True)
def rescue(spark, d):
    names_ = spark.createDataFrame([(n,) for n in ("Riga", "Memel", "New York", "York")], "name string")
    places = names_.union(table(spark, d, "nation").select("n_name"))
    return read(spark, d, "rescue", grammar.gazetteer(places, spark.createDataFrame([("Petersburg", "St. Petersburg")], "variant string, canonical string")))
