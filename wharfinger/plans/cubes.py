"""Counts, shares and concentration of arrivals."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.functions import rules
from wharfinger.operators import counts as c
from wharfinger.sources.adapters import arrival_parts, arrivals

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PIVOT = ", ".join(f"round(avg((origin_region = '{r}')::INT::DOUBLE), 6) AS \"{r}\"" for r in REGIONS)


@query("SELECT dest, form, year, count(*) AS n FROM lab GROUP BY ALL", arrivals=True)
def dest_form_year(spark, d):
    return c.label_cube(arrivals(spark, d), "forms", "form", "dest", "year")


@query("SELECT year, count(*) AS n FROM arr GROUP BY ALL", arrivals=True)
def shipments_by_year(spark, d):
    return c.count_by(arrivals(spark, d), "year")


@query("SELECT origin, form, year, count(*) AS n FROM lab GROUP BY ALL", arrivals=True)
def origin_form_year(spark, d):
    return c.label_cube(arrivals(spark, d), "forms", "form", "origin", "year")


@query("SELECT origin, dest, year, count(*) AS n FROM arr GROUP BY ALL", arrivals=True)
def route_year(spark, d):
    return c.count_by(arrivals(spark, d), "origin", "dest", "year")


@query("SELECT merchant, dest, year, count(*) AS n FROM arr GROUP BY ALL", arrivals=True)
def merchant_dest_year(spark, d):
    return c.count_by(arrivals(spark, d), "merchant", "dest", "year")


@query("SELECT origin, dest, year, NULL::VARCHAR AS form, count(*) AS n FROM arr GROUP BY ALL UNION ALL SELECT origin, dest, year, form, count(*) FROM lab GROUP BY ALL", arrivals=True)
def cube_total_and_form(spark, d):
    return c.total_and_labels(arrivals(spark, d), "forms", "form", "origin", "dest", "year")


@query("SELECT form, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, form)::INT AS rank FROM lab GROUP BY form", arrivals=True)
def form_rank(spark, d):
    return c.ranked(c.label_cube(arrivals(spark, d), "forms", "form"), "n", "form")


@query("SELECT origin, dest, count(*) AS n FROM arr GROUP BY ALL ORDER BY n DESC, origin, dest LIMIT 12", arrivals=True)
def topk_pairs(spark, d):
    return c.top(c.count_by(arrivals(spark, d), "origin", "dest"), 12, "n", "origin", "dest")


@query("WITH k AS (SELECT dest, form, count(*) AS n FROM lab GROUP BY ALL) SELECT dest, form, n FROM k QUALIFY row_number() OVER (PARTITION BY dest ORDER BY n DESC, form) <= 3", arrivals=True)
def top_forms_by_dest(spark, d):
    return c.top_in_group(c.label_cube(arrivals(spark, d), "forms", "form", "dest"), 3, "n", ["form"], "dest")


CONCENTRATION = """WITH k AS (SELECT {keys}, {partner} AS p, count(*) AS c FROM arr GROUP BY ALL)
SELECT {keys}, sum(c)::BIGINT AS n, count(*) AS partners, arg_min(p, (-c, p)) AS top, round(max(c) / sum(c), 6) AS top_share,
  round(sum(c * c) / (sum(c) * sum(c)), 6) AS hhi, round((sum(c) * sum(c)) / sum(c * c), 6) AS effective
FROM k GROUP BY {keys} HAVING sum(c) >= {least}"""


@query(CONCENTRATION.format(keys="dest", partner="origin", least=30), arrivals=True)
def dest_concentration(spark, d):
    return c.concentration(arrivals(spark, d), "origin", "dest", least=30)


@query(CONCENTRATION.format(keys="origin", partner="dest", least=30), arrivals=True)
def origin_spread(spark, d):
    return c.concentration(arrivals(spark, d), "dest", "origin", least=30)


@query(CONCENTRATION.format(keys="dest", partner="origin_region", least=30), arrivals=True)
def region_dependence(spark, d):
    return c.concentration(arrivals(spark, d), "origin_region", "dest", least=30)


@query(CONCENTRATION.format(keys="dest, period", partner="merchant", least=100), arrivals=True)
def merchant_hhi(spark, d):
    return c.concentration(arrivals(spark, d), "merchant", "dest", "period", least=100)


@query(CONCENTRATION.format(keys="dest, period", partner="origin", least=30), arrivals=True)
def portfolio_by_period(spark, d):
    return c.concentration(arrivals(spark, d), "origin", "dest", "period", least=30)


@query(
    """WITH n AS (SELECT form, dest, count(*) AS n FROM lab GROUP BY ALL)
SELECT form, dest, n, round((n / sum(n) OVER (PARTITION BY form)) / (sum(n) OVER (PARTITION BY dest) / sum(n) OVER ()), 6) AS lift FROM n QUALIFY n >= 5""",
    arrivals=True,
)
def location_quotient(spark, d):
    rows = arrivals(spark, d).select("dest", F.explode("forms").alias("form"))
    return c.lift(rows, "form", "dest", least=5)


@query(
    """WITH s AS (SELECT count(*) AS a, count(*) FILTER (origin = 'NATION_3') AS o FROM arr)
SELECT form, count(*) AS n_all, count(*) FILTER (origin = 'NATION_3') AS n_own,
  round((count(*) FILTER (origin = 'NATION_3') / any_value(o)) / (count(*) / any_value(a)), 6) AS rca FROM lab, s GROUP BY form""",
    arrivals=True,
)
def rca_by_form(spark, d):
    return c.specialisation(arrivals(spark, d), F.col("origin") == "NATION_3", "forms", "form")


@query(
    """WITH n AS (SELECT origin, form, count(*) AS n FROM lab GROUP BY ALL), s AS (SELECT origin, sqrt(sum(n * n)) AS s FROM n GROUP BY origin)
SELECT x.origin AS a, y.origin AS b, round(sum(x.n * y.n) / (any_value(p.s) * any_value(q.s)), 6) AS cosine
FROM n x JOIN n y ON x.form = y.form AND x.origin < y.origin JOIN s p ON p.origin = x.origin JOIN s q ON q.origin = y.origin GROUP BY ALL""",
    arrivals=True,
)
def profile_cosine(spark, d):
    return c.profile_cosine(arrivals(spark, d).select("origin", F.explode("forms").alias("form")), "origin", "form")


@query(
    """WITH n AS (SELECT coast, count(*) FILTER (period = 'early') AS ne, count(*) FILTER (period = 'late') AS nl,
  count(*) FILTER (period = 'early' AND origin_region = 'ASIA') AS ce, count(*) FILTER (period = 'late' AND origin_region = 'ASIA') AS cl FROM arr GROUP BY coast),
s AS (SELECT sum(ne) AS te, sum(nl) AS tl, sum(ce) AS ke, sum(cl) AS kl FROM n),
r AS (SELECT sum(ne / te * (cl / nl - ce / ne)) AS w, sum((nl / tl - ne / te) * (ce / ne)) AS b, max(kl / tl - ke / te) AS c FROM n, s WHERE ne > 0)
SELECT round(w, 6) AS within, round(b, 6) AS between, round(c, 6) AS change, round(c - w - b, 6) AS interaction FROM r""".replace("AS between", 'AS "between"'),
    arrivals=True,
)
def shift_share(spark, d):
    return c.shift_share(arrivals(spark, d), "coast", "period", F.col("origin_region") == "ASIA")


@query(
    """WITH g AS (SELECT * FROM (SELECT DISTINCT year FROM arr), (SELECT DISTINCT origin FROM arr)),
n AS (SELECT year, origin, count(*) AS n FROM arr GROUP BY ALL)
SELECT year, origin, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY year), 6) AS share FROM g LEFT JOIN n USING (year, origin)""",
    arrivals=True,
)
def country_share_dense(spark, d):
    return c.dense_shares(arrivals(spark, d), "year", "origin")


@query("SELECT origin_region, period, count(*) AS n, round(avg(steam::INT::DOUBLE), 6) AS share FROM arr GROUP BY ALL HAVING count(*) >= 30", arrivals=True)
def steam_share(spark, d):
    return c.flag_share(arrivals(spark, d), F.col("steam"), "origin_region", "period", least=30)


@query("SELECT origin, year, count(*) AS n, round(avg(steam::INT::DOUBLE), 6) AS share FROM arr GROUP BY ALL HAVING count(*) >= 30", arrivals=True)
def steam_share_country_year(spark, d):
    return c.flag_share(arrivals(spark, d), F.col("steam"), "origin", "year", least=30)


@query(f"SELECT coast, period, count(*) AS n, {PIVOT} FROM arr GROUP BY ALL", arrivals=True)
def coast_region_pivot(spark, d):
    return c.pivot_share(arrivals(spark, d), "origin_region", REGIONS, "coast", "period")


@query(f"SELECT month, count(*) AS n, {PIVOT} FROM arr GROUP BY ALL", arrivals=True)
def seasonality(spark, d):
    return c.pivot_share(arrivals(spark, d), "origin_region", REGIONS, "month")


@query(
    f"""WITH seg AS (SELECT 'large' AS segment, * FROM arr WHERE quantity >= 25 UNION ALL SELECT 'steam', * FROM arr WHERE steam UNION ALL SELECT 'mixed', * FROM arr WHERE len(forms) > 1)
SELECT segment, year, count(*) AS n, {PIVOT} FROM seg GROUP BY ALL HAVING count(*) >= 60""",
    arrivals=True,
)
def segment_share(spark, d):
    a = arrivals(spark, d)
    tags = F.filter(F.array(F.when(F.col("quantity") >= 25, "large"), F.when(F.col("steam"), "steam"), F.when(F.size("forms") > 1, "mixed")), lambda x: x.isNotNull())
    return c.pivot_share(a.withColumn("segment", F.explode(tags)), "origin_region", REGIONS, "segment", "year").where("n >= 60")


@query(
    """WITH p AS (SELECT year, CASE WHEN dest IN ('NATION_0', 'NATION_1', 'NATION_2') THEN dest ELSE 'other' END AS port FROM arr), k AS (SELECT year, port, count(*) AS n FROM p GROUP BY ALL) SELECT year, port, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM k""",
    arrivals=True,
)
def port_decomposition(spark, d):
    port = F.when(F.col("dest").isin("NATION_0", "NATION_1", "NATION_2"), F.col("dest")).otherwise("other")
    return c.share_of(c.count_by(arrivals(spark, d).withColumn("port", port), "year", "port"), "n", "year")


@query(
    """WITH r AS (SELECT year, month, (origin_region = 'ASIA')::INT::DOUBLE AS o FROM arr), p AS (SELECT month, avg(o) AS p FROM r GROUP BY month),
n AS (SELECT year, month, count(*) AS n, sum(o) AS k FROM r GROUP BY ALL)
SELECT year, sum(n)::BIGINT AS n, round(sum(k) / sum(n), 6) AS actual, round(sum(n * p) / sum(n), 6) AS expected FROM n JOIN p USING (month) GROUP BY year""",
    arrivals=True,
)
def expected_month_mix(spark, d):
    return c.expected_share(arrivals(spark, d), "year", "month", F.col("origin_region") == "ASIA")


@query(
    """WITH a AS (SELECT DISTINCT coast, origin, merchant, year FROM arr WHERE good_year), y AS (SELECT year, lead(year) OVER (ORDER BY year) AS nx FROM (SELECT DISTINCT year FROM a))
SELECT a.coast, count(*) AS n, round(avg((b.year IS NOT NULL)::INT::DOUBLE), 6) AS persistence
FROM a JOIN y ON a.year = y.year AND nx IS NOT NULL LEFT JOIN (SELECT DISTINCT origin, merchant, year FROM a) b ON b.origin = a.origin AND b.merchant = a.merchant AND b.year = nx GROUP BY a.coast""",
    arrivals=True,
)
def route_persistence(spark, d):
    return c.persistence(arrivals(spark, d).where("good_year"), "year", "coast", "origin", "merchant")


@query("""SELECT origin, merchant, count(DISTINCT year) AS n_years, min(year) AS "first", max(year) AS "last", count(*) AS n FROM arr GROUP BY ALL HAVING count(DISTINCT year) >= 4""", arrivals=True)
def longlived_routes(spark, d):
    return c.long_lived(arrivals(spark, d), "year", 4, "origin", "merchant", parts=arrival_parts(spark, d))


@query(
    """WITH n AS (SELECT ship, steam, origin || ' > ' || dest AS r, count(*) AS c FROM arr GROUP BY ALL)
SELECT ship, steam, sum(c)::BIGINT AS voyages, arg_min(r, (-c, r)) AS route, round(max(c) / sum(c), 6) AS fidelity FROM n GROUP BY ALL HAVING sum(c) >= 10""",
    arrivals=True,
)
def career_fidelity(spark, d):
    return c.careers(arrivals(spark, d), ["ship", "steam"], ["origin", "dest"], 10)


@query(
    """WITH n AS (SELECT steam, ship, count(*) AS c FROM arr GROUP BY ALL)
SELECT steam, (list_sort(list(c)))[(count(*) // 2 + 1)::INT] AS median FROM n GROUP BY steam""",
    arrivals=True,
)
def career_median(spark, d):
    return c.upper_median(c.count_by(arrivals(spark, d), "steam", "ship"), "n", "steam")


@query(
    """WITH e AS (SELECT merchant, count(*) AS n FROM arr WHERE period = 'early' GROUP BY ALL ORDER BY n DESC, merchant LIMIT 25),
l AS (SELECT merchant, count(*) FILTER (origin_region = 'ASIA') AS s, count(*) FILTER (origin_region = 'EUROPE') AS m FROM arr WHERE period = 'late' GROUP BY ALL)
SELECT merchant, n, CASE WHEN s IS NULL THEN 'disappeared' WHEN s >= m AND s > 0 THEN 'stayed' WHEN m > 0 THEN 'moved' ELSE 'left' END AS fate FROM e LEFT JOIN l USING (merchant)""",
    arrivals=True,
)
def cohort_fates(spark, d):
    return c.cohort_fates(arrivals(spark, d), "merchant", "origin_region", "ASIA", "EUROPE", 25)


@query(
    """WITH k AS (SELECT merchant, origin_region AS p, count(*) AS c FROM arr GROUP BY ALL)
SELECT merchant, sum(c)::BIGINT AS n, arg_min(p, (-c, p)) AS top, round(max(c) / sum(c), 6) AS top_share FROM k GROUP BY ALL HAVING sum(c) >= 30 AND round(max(c) / sum(c), 6) >= 0.4""",
    arrivals=True,
)
def merchant_specialisation(spark, d):
    return c.specialists(arrivals(spark, d), "merchant", "origin_region", 30, 0.4)


@query(
    """WITH k AS (SELECT form, year, dest, count(*) AS c FROM lab GROUP BY ALL), h AS (SELECT form, year, sum(c) AS n, sum(c * c) / (sum(c) * sum(c)) AS hhi FROM k GROUP BY ALL HAVING sum(c) >= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY year) AS a, row_number() OVER (PARTITION BY form ORDER BY year DESC) AS b FROM h)
SELECT form, count(*) AS n_years, round(avg(hhi) FILTER (a <= 3), 6) AS early, round(avg(hhi) FILTER (b <= 3), 6) AS late FROM r GROUP BY form HAVING count(*) >= 3""",
    arrivals=True,
)
def commodity_hhi_trend(spark, d):
    from pyspark.sql.window import Window as W

    rows = arrivals(spark, d).select("year", "dest", F.explode("forms").alias("form"))
    k = c.count_by(rows, "form", "year", "dest")
    h = k.groupBy("form", "year").agg(F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi")).where("t >= 30")
    h = h.withColumn("a", F.row_number().over(W.partitionBy("form").orderBy("year"))).withColumn("b", F.row_number().over(W.partitionBy("form").orderBy(F.desc("year"))))
    return h.groupBy("form").agg(F.count(F.lit(1)).alias("n_years"), F.round(F.avg(F.when(F.col("a") <= 3, F.col("hhi"))), 6).alias("early"), F.round(F.avg(F.when(F.col("b") <= 3, F.col("hhi"))), 6).alias("late")).where("n_years >= 3")


#: Goods of the tables that stand for sawn and square goods, and the species that stands for hardwood.
SAWN, SQUARE, HARD = ("ring",), ("bolt", "rod"), ("large",)


@query(
    f"""WITH k AS (SELECT split_part(record_id, '-', 1) AS voyage, min(year) AS year, bool_or(list_has_any(forms, {list(SAWN)})) AS sawn, bool_or(list_has_any(forms, {list(SQUARE)})) AS square, bool_or(species IN ('large')) AS hard FROM arr GROUP BY ALL),
n AS (SELECT year, CASE WHEN sawn THEN 'sawn' WHEN square THEN 'square' WHEN hard THEN 'hardwood' ELSE 'other' END AS kind, count(*) AS n FROM k GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM n""",
    arrivals=True,
)
def square_sawn_mix(spark, d):
    """Orders as voyages, each with the goods of its few items: their kinds by the year of the first item."""
    voyage = F.substring_index("record_id", "-", 1).alias("voyage")
    cargo = F.collect_list(F.struct("forms", F.array("species").alias("species"))).alias("cargo")
    voyages = arrivals(spark, d).groupBy(voyage).agg(F.min("year").alias("year"), cargo)
    kinds = voyages.select("year", rules.square_or_sawn(F.col("cargo"), SQUARE, SAWN, HARD).alias("kind"))
    return c.share_of(c.count_by(kinds, "year", "kind"), "n", "year")
