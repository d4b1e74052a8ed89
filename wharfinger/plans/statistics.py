"""Series, trends, breaks and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.operators import counts as c
from wharfinger.operators import series as s
from wharfinger.sources.adapters import arrivals
from wharfinger.sources.files import saved

YEARLY = "y AS (SELECT year, avg((origin_region = 'ASIA')::INT::DOUBLE) AS a, avg(steam::INT::DOUBLE) AS b, count(*) AS n FROM arr GROUP BY year)"
MONTHLY = "m AS (SELECT origin_region, (year(l) - 1995) * 12 + month(l) AS t, count(*)::DOUBLE AS v FROM (SELECT origin_region, arrived AS l FROM arr) GROUP BY ALL)"


def yearly(spark, d):
    return arrivals(spark, d).groupBy("year").agg(F.avg((F.col("origin_region") == "ASIA").cast("double")).alias("a"), F.avg(F.col("steam").cast("double")).alias("b"), F.count(F.lit(1)).alias("n"))


def monthly(spark, d):
    rows = arrivals(spark, d).select("origin_region", ((F.col("year") - 1995) * 12 + F.col("month")).cast("long").alias("t"))
    return rows.groupBy("origin_region", "t").agg(F.count(F.lit(1)).cast("double").alias("v"))


@query(
    f"WITH {YEARLY}, r AS (SELECT a - (SELECT regr_intercept(a, year) + 0 FROM y) - (SELECT regr_slope(a, year) FROM y) * year AS ra, b - (SELECT regr_intercept(b, year) FROM y) - (SELECT regr_slope(b, year) FROM y) * year AS rb FROM y) SELECT round(corr(ra, rb), 6) AS r FROM r",
    arrivals=True,
)
def pearson_detrended(spark, d):
    return s.pearson(s.detrended(yearly(spark, d), "year", "a", "b"), "a", "b")


@query(f"WITH {MONTHLY} SELECT origin_region, count(*) AS n, round(regr_slope(v, t) * 120, 6) AS slope FROM m GROUP BY ALL", arrivals=True)
def ols_trend(spark, d):
    return s.slopes(monthly(spark, d), "t", "v", "origin_region", scale=120.0)


@query(
    f"""WITH {MONTHLY}, k AS (SELECT *, rank() OVER (PARTITION BY origin_region ORDER BY v) + (count(*) OVER (PARTITION BY origin_region, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY origin_region ORDER BY t) AS rt FROM m),
c AS (SELECT origin_region, corr(rt, rv) AS r, count(*) - 2 AS v FROM k GROUP BY ALL),
tails AS (SELECT origin_region, list_transform([asin(abs(r)), 0.0::DOUBLE], lambda a: list_sum(list_transform(range(0, 20001), lambda i: (CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(a + (pi() / 2 - a) * i / 20000), v - 1))) * (pi() / 2 - a)) AS t FROM c)
SELECT origin_region, round(r, 6) AS rho, round(t[1] / t[2], 6) AS p FROM c JOIN tails USING (origin_region)""",
    arrivals=True,
)
def spearman(spark, d):
    return s.spearman(monthly(spark, d), "t", "v", "origin_region")


ANCHORS = [(1996, 2.0), (1998, 4.0), (2000, 3.0)]
LEVEL = "CASE WHEN year <= 1996 THEN 2.0::DOUBLE WHEN year < 1998 THEN 2.0 + (4.0 - 2.0) * (year - 1996) / 2 WHEN year < 2000 THEN 4.0 + (3.0 - 4.0) * (year - 1998) / 2 ELSE 3.0 END"


@query(f"WITH {YEARLY} SELECT year, ({LEVEL})::DOUBLE AS level FROM y", arrivals=True)
def interp_anchors(spark, d):
    anchors = spark.createDataFrame(ANCHORS, "year int, w double")
    return s.between_anchors(yearly(spark, d).select("year"), anchors, "year", "w")


@query(
    f"""WITH n AS (SELECT year, origin_region, count(*) AS n FROM arr GROUP BY ALL), h AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS share, ({LEVEL})::DOUBLE * CASE WHEN origin_region = 'ASIA' THEN 1 ELSE 0.5 END AS w FROM n)
SELECT year, origin_region, round(share, 6) AS share, round(share * w / sum(share * w) OVER (PARTITION BY year), 6) AS calibrated FROM h""",
    arrivals=True,
)
def calibrated_share(spark, d):
    from pyspark.sql.window import Window as W

    n = c.count_by(arrivals(spark, d), "year", "origin_region")
    n = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("year")))
    anchors = spark.createDataFrame(ANCHORS, "year int, w double")
    n = s.between_anchors(n, anchors, "year", "w").withColumn("w", F.col("level") * F.when(F.col("origin_region") == "ASIA", 1.0).otherwise(0.5))
    return s.calibrated(n, "year", "share", "w").select("year", "origin_region", F.round("share", 6).alias("share"), "calibrated")


@query(
    """WITH g AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, CASE WHEN event_type <> 'view' THEN value END AS v FROM events),
h AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1
  FROM g WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0) END, 6) AS v FROM h"""
)
def fill_gaps(spark, d):
    from wharfinger.sources.adapters import event_log

    rows = event_log(spark, d).select("event_id", "user_id", F.col("seq").alias("t"), F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
    return s.fill_gaps(rows, "t", "v", "user_id").select("event_id", F.round("v", 6).alias("v"))


SEGMENTS = f"""{MONTHLY}, o AS (SELECT origin_region, t, v, row_number() OVER (PARTITION BY origin_region ORDER BY t) AS k FROM m),
p AS (SELECT a.origin_region, a.k AS i, b.k AS j FROM o a JOIN o b ON a.origin_region = b.origin_region AND b.k - a.k + 1 >= 8),
e AS MATERIALIZED (SELECT p.origin_region, i, j, greatest(regr_syy(v, t) - regr_sxy(v, t) ^ 2 / regr_sxx(v, t), 0) AS ssr FROM p JOIN o ON o.origin_region = p.origin_region AND o.k BETWEEN i AND j GROUP BY ALL)"""


@query(f"WITH {SEGMENTS} SELECT origin_region, i::INT AS i, j::INT AS j, round(ssr, 4) AS ssr FROM e", arrivals=True)
def segment_ssr(spark, d):
    e = s.segment_errors(monthly(spark, d), "t", "v", "origin_region", least=8)
    return e.select("origin_region", "i", "j", F.round("ssr", 4).alias("ssr"))


@query(
    f"""WITH {SEGMENTS}, n AS (SELECT origin_region, max(k) AS n FROM o GROUP BY ALL),
b AS (SELECT origin_region, 0 AS m, ssr, '' AS breaks FROM e JOIN n USING (origin_region) WHERE i = 1 AND j = n
  UNION ALL SELECT x.origin_region, 1, x.ssr + y.ssr, x.j::VARCHAR FROM e x JOIN e y ON x.origin_region = y.origin_region AND y.i = x.j + 1 JOIN n ON n.origin_region = x.origin_region WHERE x.i = 1 AND y.j = n),
c AS (SELECT origin_region, m, arg_min(ssr, ssr) AS ssr, arg_min(breaks, ssr) AS breaks, any_value(n) AS n FROM b JOIN n USING (origin_region) GROUP BY ALL),
q AS (SELECT *, n * ln(ssr / n) + (3 * m + 2) * ln(n) AS bic FROM c)
SELECT origin_region, m::INT AS m, round(bic, 4) AS bic, round(ssr, 4) AS ssr, breaks FROM q QUALIFY row_number() OVER (PARTITION BY origin_region ORDER BY bic) = 1""",
    arrivals=True,
)
def best_break_bic(spark, d):
    e = s.segment_errors(monthly(spark, d), "t", "v", "origin_region", least=8)
    return s.by_bic(s.best_breaks(e, "origin_region", 1), "origin_region")


def levels_sql(most: int) -> str:
    """s.best_breaks and s.by_bic in SQL: a table for each number of breaks, and of each series the best."""
    step = "d{k} AS (SELECT origin_region, e.j AS j, min(cost + ssr) AS cost, arg_min(list_append(breaks, i - 1), (cost + ssr, i)) AS breaks FROM d{p} d JOIN e USING (origin_region) WHERE e.i = d.j + 1 GROUP BY ALL)"
    ends = " UNION ALL ".join(f"SELECT origin_region, {k} AS m, n, cost, breaks FROM d{k} JOIN n USING (origin_region) WHERE j = n" for k in range(most + 1))
    return f"""{SEGMENTS}, n AS (SELECT origin_region, max(k) AS n FROM o GROUP BY ALL), d0 AS (SELECT origin_region, j, ssr AS cost, []::BIGINT[] AS breaks FROM e WHERE i = 1),
{", ".join(step.format(k=k, p=k - 1) for k in range(1, most + 1))}, tried AS ({ends}),
best AS (SELECT *, n * ln(greatest(cost, 1e-12) / n) + (3 * m + 2) * ln(n) AS bic FROM tried QUALIFY row_number() OVER (PARTITION BY origin_region ORDER BY n * ln(greatest(cost, 1e-12) / n) + (3 * m + 2) * ln(n)) = 1)"""


@query(f"WITH {levels_sql(4)} SELECT origin_region, m::INT AS m, round(bic, 4) AS bic, round(cost, 4) AS ssr, array_to_string(breaks, ',') AS breaks FROM best", arrivals=True)
def best_break_bic_4(spark, d):
    """Among 0 to 4 breaks."""
    e = saved(s.segment_errors(monthly(spark, d), "t", "v", "origin_region", least=8))
    return s.by_bic(s.best_breaks(e, "origin_region", 4), "origin_region")


@query(
    f"""WITH {SEGMENTS}, n AS (SELECT origin_region, max(k) AS n FROM o GROUP BY ALL),
b AS (SELECT x.origin_region, x.j AS at, x.ssr + y.ssr AS ssr FROM e x JOIN e y ON x.origin_region = y.origin_region AND y.i = x.j + 1 JOIN n ON n.origin_region = x.origin_region WHERE x.i = 1 AND y.j = n)
SELECT origin_region, at::INT AS at, round(ssr, 4) AS ssr FROM b QUALIFY ssr <= 1.01 * min(ssr) OVER (PARTITION BY origin_region)""".replace("AS at", 'AS "at"').replace(" at::INT", ' "at"::INT'),
    arrivals=True,
)
def break_confidence(spark, d):
    from pyspark.sql.window import Window as W

    e = s.segment_errors(monthly(spark, d), "t", "v", "origin_region", least=8)
    n = e.groupBy("origin_region").agg(F.max("j").alias("n"))
    a, b = e.where("i = 1").select("origin_region", F.col("j").alias("at"), F.col("ssr").alias("s1")), e.select("origin_region", (F.col("i") - 1).alias("at"), "j", F.col("ssr").alias("s2"))
    total = a.join(b, ["origin_region", "at"]).join(n, "origin_region").where("j = n").withColumn("ssr", F.col("s1") + F.col("s2"))
    return total.withColumn("least", F.min("ssr").over(W.partitionBy("origin_region"))).where("ssr <= 1.01 * least").select("origin_region", "at", F.round("ssr", 4).alias("ssr"))


def drawn_sql(key: str) -> str:
    """s.drawn in SQL."""
    return f"len(list_filter([{', '.join(map(str, s.POISSON))}], lambda p: ('0x' || md5({key})[1:15])::BIGINT >= p))"


@query(
    f"""WITH g AS (SELECT issue, count_if(origin_region = 'ASIA') AS x, count(*) AS n FROM arr GROUP BY issue),
w AS (SELECT rep, x, n, {drawn_sql("rep || ':' || issue")} AS w FROM g, range(800) t(rep)),
m AS (SELECT rep, sum(w * x) / sum(w * n) AS m FROM w GROUP BY rep),
p AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS p FROM m)
SELECT round((SELECT sum(x) / sum(n) FROM g), 6) AS mean, round(max(m) FILTER (p = 20), 6) AS low, round(max(m) FILTER (p = 780), 6) AS high FROM p""",
    arrivals=True,
)
def bootstrap_share_ci(spark, d):
    g = arrivals(spark, d).groupBy("issue").agg(F.count_if(F.col("origin_region") == "ASIA").alias("x"), F.count(F.lit(1)).alias("n"))
    return s.bootstrap(g, "issue", "x", "n", 800, 20, 780)


@query()
def multinomial_null(spark, d):
    """For each destination: the mean and tail share of the largest origin when its arrivals
    are drawn from all origins' shares, 2000 times, seeded by its name."""
    import numpy as np
    import pandas as pd

    rows = arrivals(spark, d)
    pool = c.count_by(rows, "origin")
    n = c.count_by(rows, "dest", "origin").groupBy("dest").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    shares = pool.agg(F.sort_array(F.collect_list(F.struct("origin", "n"))).alias("p"))  # one row, an entry for each origin

    def simulate(batches):
        for b in batches:
            out = []
            for dest, size, top, p in zip(b["dest"], b["n"], b["top"], b["p"], strict=True):
                x = np.array([float(v) for v in p])
                rng = np.random.default_rng([ord(ch) for ch in dest])
                sims = rng.multinomial(size, x / x.sum(), 2000).max(axis=1) / size
                out.append((dest, size, top / size, float(sims.mean()), float((sims >= top / size).mean())))
            yield pd.DataFrame(out, columns=["dest", "n", "top_share", "null_mean", "p"])

    full = n.crossJoin(F.broadcast(shares)).select("dest", "n", "top", F.col("p.n").alias("p"))
    return full.mapInPandas(simulate, "dest string, n long, top_share double, null_mean double, p double")
