"""Audits over arrivals and page lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.functions import rules as r
from wharfinger.operators import audit as a
from wharfinger.operators import counts as c
from wharfinger.sources.adapters import arrivals, page_lines, table


@query(
    """WITH f AS (SELECT unnest(['ship', 'origin', 'species', 'period']) AS field, unnest([ship, origin, species, period]) AS v FROM arr)
SELECT field, count(*) FILTER (coalesce(trim(v), '') = '') AS empty, round(count(*) FILTER (coalesce(trim(v), '') = '') * 100 / count(*), 2) AS percent FROM f GROUP BY field""",
    arrivals=True,
)
def completeness(spark, d):
    return a.completeness(arrivals(spark, d), "ship", "origin", "species", "period")


@query("SELECT record_id, 'ship' AS field, ship AS value, length(ship)::INT AS size FROM arr WHERE length(ship) > 11 UNION ALL SELECT record_id, 'merchant', merchant, length(merchant)::INT FROM arr WHERE length(merchant) > 12", arrivals=True)
def length_anomalies(spark, d):
    return a.too_long(arrivals(spark, d), "record_id", {"ship": 11, "merchant": 12})


@query("SELECT source_file, count(*) AS n, count(*) FILTER (length(text) < 30) AS bad, round(count(*) FILTER (length(text) < 30) / count(*), 6) AS rate FROM ln GROUP BY ALL ORDER BY rate DESC, source_file LIMIT 50", lines=True)
def error_rate_by_file(spark, d):
    return a.error_rates(page_lines(spark, d), "source_file", F.length("text") < 30)


@query("SELECT lower(trim(p_type)) AS value, count(*) AS n FROM part WHERE lower(trim(p_type)) NOT IN ('economy', 'small') GROUP BY ALL")
def unit_catalog(spark, d):
    valid = spark.createDataFrame([("economy",), ("small",)], "value string")
    return a.catalogue(table(spark, d, "part"), F.col("p_type"), valid)


@query("SELECT lower(trim(form)) AS value, count(*) AS n FROM lab GROUP BY ALL", arrivals=True)
def commodity_catalog(spark, d):
    return a.catalogue(arrivals(spark, d).select(F.explode("forms").alias("form")), F.col("form"))


KEYWORDS = ", ".join(f"'{k}'" for k in r.CARGO_KEYWORDS)


@query(f"WITH k AS (SELECT source_file, line_no, list_filter([{KEYWORDS}], lambda x: contains(lower(text), x)) AS words FROM ln) SELECT source_file, line_no, array_to_string(words, ',') AS words FROM k WHERE len(words) > 0", lines=True)
def contamination(spark, d):
    rows = page_lines(spark, d).select("source_file", "line_no", F.lower("text").alias("low"))
    return rows.where(r.has_keyword(F.col("low"))).select("source_file", "line_no", F.array_join(r.keywords_in(F.col("low")), ",").alias("words"))


ISSUE = "CASE WHEN length(text) <= 3 THEN 'short' WHEN regexp_matches(text, '[<>\\[\\]{}|\\\\]') THEN 'odd' WHEN regexp_matches(text, '\\($') THEN 'truncated' WHEN regexp_matches(text, '^[0-9]') THEN 'date' END"


@query(f"WITH i AS (SELECT source_file, line_no, {ISSUE} AS issue FROM ln) SELECT * FROM i WHERE issue IS NOT NULL", lines=True)
def port_errors(spark, d):
    t = F.col("text")
    issue = F.when(F.length(t) <= 3, "short").when(t.rlike(r"[<>\[\]{}|\\]"), "odd").when(t.endswith("("), "truncated").when(t.rlike("^[0-9]"), "date")
    return page_lines(spark, d).select("source_file", "line_no", issue.alias("issue")).where("issue is not null")


@query(
    """SELECT 'rows' AS metric, count(*) AS n, round(100.0::DOUBLE, 2) AS percent FROM arr UNION ALL SELECT 'steam', count(*) FILTER (steam), round(count(*) FILTER (steam) * 100 / count(*), 2) FROM arr
UNION ALL SELECT 'no_period', count(*) FILTER (period IS NULL), round(count(*) FILTER (period IS NULL) * 100 / count(*), 2) FROM arr UNION ALL SELECT 'one_form', count(*) FILTER (len(forms) = 1), round(count(*) FILTER (len(forms) = 1) * 100 / count(*), 2) FROM arr""",
    arrivals=True,
)
def exec_summary(spark, d):
    s = arrivals(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_if("steam").alias("steam"), F.count_if(F.col("period").isNull()).alias("no_period"), F.count_if(F.size("forms") == 1).alias("one_form"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in ("rows", "steam", "no_period", "one_form")]))
    return s.select(F.col("rows").alias("t"), each.alias("x")).select("x.metric", "x.n", F.round(F.col("x.n") * 100 / F.col("t"), 2).alias("percent"))


@query("SELECT CASE WHEN quantity >= 40 THEN 'high' WHEN quantity >= 10 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM arr GROUP BY ALL", arrivals=True)
def confidence_distribution(spark, d):
    conf = F.when(F.col("quantity") >= 40, "high").when(F.col("quantity") >= 10, "medium").otherwise("low")
    return c.count_by(arrivals(spark, d).select(conf.alias("confidence")), "confidence")


@query(
    """WITH l AS (SELECT source_file, line_no, line_no - row_number() OVER (PARTITION BY source_file ORDER BY line_no) AS i FROM ln WHERE NOT regexp_matches(text, '^[A-Z]') OR length(text) > 400)
SELECT source_file, min(line_no)::INT AS "first", count(*) AS n FROM l GROUP BY source_file, i HAVING count(*) >= 2""",
    lines=True,
)
def parse_coverage(spark, d):
    lines = page_lines(spark, d)
    parsed = lines.where(F.col("text").rlike("^[A-Z]") & (F.length("text") <= 400)).select("source_file", "line_no")
    return a.missed_lines(lines.select("source_file", "line_no"), parsed, least=2)


@query(
    """WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM p WHERE n <= 5 OR p = 0 OR floor(p * 5 / n) <> floor((p - 1) * 5 / n)"""
)
def survey_sample(spark, d):
    return a.spread_sample(table(spark, d, "documents").select("source", "doc_id"), 5, "doc_id", "source")


@query(
    """WITH s AS (SELECT origin AS port, 'origin' AS side FROM arr UNION ALL SELECT dest, 'destination' FROM arr)
SELECT side, port, count(*) AS n FROM s GROUP BY ALL""",
    arrivals=True,
)
def port_frequency(spark, d):
    sides = F.explode(F.array(F.struct(F.lit("origin").alias("side"), F.col("origin").alias("port")), F.struct(F.lit("destination").alias("side"), F.col("dest").alias("port"))))
    return c.count_by(arrivals(spark, d).select(sides.alias("x")).select("x.*"), "side", "port")


READ_LINE = "regexp_matches(text, '^[A-Z]') AND length(text) <= 400"


@query(
    f"""WITH f AS (SELECT DISTINCT source_file, split_part(source_file, '/', 1) AS source FROM ln),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(source_file), source_file) <= 20),
l AS (SELECT source_file, line_no, text, {READ_LINE} AS read FROM ln JOIN k USING (source_file)),
gone AS (SELECT source_file, line_no - row_number() OVER (PARTITION BY source_file ORDER BY line_no) AS i FROM l WHERE NOT read),
r AS (SELECT source_file, count(*) FILTER (n >= 3) AS long_runs, max(n) AS longest_run FROM (SELECT source_file, count(*) AS n FROM gone GROUP BY source_file, i) GROUP BY ALL),
o AS (SELECT source_file, split_part(text, '.', 1) AS ship, split_part(text, ' ', 1) AS origin, split_part(text, ' ', 2) AS consignee FROM l WHERE read),
s AS (SELECT source_file, count(*) AS suspicious FROM o WHERE regexp_matches(ship, '\\d') OR regexp_matches(consignee, '\\d') OR length(ship) > 40 OR regexp_matches(ship, '{a.SPOT_WORDS}') OR regexp_matches(origin, '{a.SPOT_WORDS}') GROUP BY ALL),
n AS (SELECT source_file, count(*) AS n_lines, count_if(read) AS read FROM l GROUP BY ALL)
SELECT source_file, source, n_lines, read, n_lines - read AS missed, coalesce(long_runs, 0) AS long_runs, coalesce(longest_run, 0) AS longest_run, coalesce(suspicious, 0) AS suspicious
FROM k JOIN n USING (source_file) LEFT JOIN r USING (source_file) LEFT JOIN s USING (source_file)""",
    lines=True,
)
def spot_check(spark, d):
    """Twenty files of each source, by hash: lines missed, runs of them, and suspicious records. A line of
    prose stands for a record: its first sentence as the ship, its first words as origin and consignee."""
    lines = page_lines(spark, d)
    files = a.hashed_sample(lines.select("source_file", F.substring_index("source_file", "/", 1).alias("source")).distinct(), 20, "source_file", "source")
    part = lambda sep, k: F.split_part("text", F.lit(sep), F.lit(k))
    records = lines.where(F.col("text").rlike("^[A-Z]") & (F.length("text") <= 400)).select("source_file", "line_no", part(".", 1).alias("ship"), part(" ", 1).alias("origin"), part(" ", 2).alias("consignee"))
    return a.spot_check(files, lines.select("source_file", "line_no"), records)
