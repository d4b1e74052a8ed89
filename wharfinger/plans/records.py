"""Lines to records: carried state, stitching, repeats, dates and quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfinger.catalog import query
from wharfinger.functions import text as t
from wharfinger.operators import repeats, sequences
from wharfinger.sources.adapters import arrival_parts, arrivals, event_log, page_lines, table


@query(
    """SELECT source_file, line_no, last_value(CASE WHEN length(text) < 60 AND regexp_matches(text, '^[A-Z]') THEN text END IGNORE NULLS)
  OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS header FROM ln""",
    lines=True,
)
def ffill_header(spark, d):
    head = F.when((F.length("text") < 60) & F.col("text").rlike("^[A-Z]"), F.col("text"))
    return sequences.carry_forward(page_lines(spark, d), head, "header", "source_file", "line_no").drop("text")


@query(
    """WITH f AS (SELECT *, CASE WHEN length(text) < 80 AND lag(line_no) OVER w IS NOT NULL AND line_no - lag(line_no) OVER w <= 2 THEN 0 ELSE 1 END AS s
  FROM ln WHERE trim(text) <> '' WINDOW w AS (PARTITION BY source_file ORDER BY line_no)),
g AS (SELECT *, sum(s) OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT source_file, min(line_no)::INT AS line_no, count(*) AS n_lines, string_agg(text, ' ' ORDER BY line_no) AS text FROM g GROUP BY source_file, i""",
    lines=True,
)
def stitch_lines(spark, d):
    rows = page_lines(spark, d).where(F.trim("text") != "")
    return sequences.stitch(rows, F.length("text") < 80, "source_file", "line_no", "text")


@query(
    """WITH g AS (SELECT source_file, line_no, line_no - row_number() OVER (PARTITION BY source_file ORDER BY line_no) AS i FROM ln WHERE length(text) >= 80)
SELECT source_file, min(line_no)::INT AS "first", max(line_no)::INT AS "last", count(*) AS n FROM g GROUP BY source_file, i HAVING count(*) >= 3""",
    lines=True,
)
def missed_runs(spark, d):
    return sequences.runs(page_lines(spark, d).where(F.length("text") >= 80), "source_file", "line_no", least=3)


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'view' THEN 'ditto' ELSE 'named' END AS kind FROM events),
f AS (SELECT *, last_value(CASE WHEN kind = 'named' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e)
SELECT event_id, CASE WHEN kind = 'named' THEN event_type ELSE p END AS resolved, CASE WHEN kind = 'ditto' AND p IS NULL THEN 'none' ELSE 'named' END AS resolved_kind FROM f"""
)
def ditto_carry(spark, d):
    return sequences.resolve_ditto(event_log(spark, d), "kind", "event_type", "user_id", "seq").select("event_id", "resolved", "resolved_kind")


KEPT = """SELECT source_file, line_no FROM ln WHERE trim(text) <> ''
QUALIFY row_number() OVER (PARTITION BY split_part(source_file, '/', 1), lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) ORDER BY source_file, line_no) = 1"""


def kept_lines(spark, d):
    rows = repeats.without_husks(page_lines(spark, d).withColumn("full", F.trim("text")), "full")
    return repeats.keep_first(rows, [F.substring_index("source_file", "/", 1), repeats.signature(F.col("text"))], ["source_file", "line_no"])


@query(KEPT, lines=True)
def dedup_keep_first(spark, d):
    return kept_lines(spark, d).select("source_file", "line_no")


@query(
    f"""WITH k AS ({KEPT}), a AS (SELECT source_file, count(*) AS n FROM ln WHERE trim(text) <> '' GROUP BY ALL), b AS (SELECT source_file, count(*) AS kept FROM k GROUP BY ALL)
SELECT source_file, n, coalesce(kept, 0) AS kept, n - coalesce(kept, 0) AS removed FROM a LEFT JOIN b USING (source_file) ORDER BY removed DESC, source_file LIMIT 20""",
    lines=True,
)
def dedup_report(spark, d):
    return repeats.removed_report(page_lines(spark, d).where(F.trim("text") != ""), kept_lines(spark, d), "source_file")


@query("SELECT source_file, text, count(*) AS n, count(*) - 1 AS extra FROM ln GROUP BY ALL HAVING count(*) >= 2", lines=True)
def exact_dups(spark, d):
    return repeats.exact_repeats(page_lines(spark, d), "source_file", "text")


@query("SELECT source_file, text, count(*) AS n, count(*) - 1 AS extra FROM ln GROUP BY ALL HAVING count(*) >= 5", lines=True)
def repetition_loops(spark, d):
    return repeats.exact_repeats(page_lines(spark, d), "source_file", "text", least=5)


@query(
    "SELECT lower(trim(ship)) AS ship, lower(trim(origin)) AS origin, lower(trim(issue)) AS issue, count(*) AS n, count(DISTINCT record_id[1:100]) AS n_texts FROM arr WHERE ship <> '' GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT record_id[1:100]) > 1",
    arrivals=True,
)
def key_dups(spark, d):
    return repeats.key_repeats(arrivals(spark, d), "record_id", "ship", "origin", "issue", needed=("ship", "issue"), parts=arrival_parts(spark, d))


FILES = "SELECT event_id, (1870 + event_id % 25)::VARCHAR || strftime(ts, '%m%d') || 'J_p' || lpad((event_id % 7)::VARCHAR, 3, '0') AS a, 'Journal - ' || strftime(ts, '%B') || ' ' || day(ts) || ' ' || (1870 + event_id % 25) || ' - p' AS b FROM events"


def file_names(spark, d):
    year = (F.lit(1870) + F.col("event_id") % 25).cast("string")
    compact = F.concat(year, F.date_format("ts", "MMdd"), F.lit("J_p"), F.lpad((F.col("event_id") % 7).cast("string"), 3, "0"))
    spelt = F.concat(F.lit("Journal - "), F.date_format("ts", "MMMM"), F.lit(" "), F.dayofmonth("ts").cast("string"), F.lit(" "), year, F.lit(" - p"))
    return table(spark, d, "events").select("event_id", "ts", compact.alias("a"), spelt.alias("b"))


@query(
    f"""WITH f AS ({FILES})
SELECT event_id, regexp_extract(a, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})', 1) || '-' || a[5:6] || '-' || a[7:8] AS compact,
  strftime(strptime(regexp_extract(b, '([A-Z][a-z]+ \\d+ \\d{{4}})', 1), '%B %d %Y'), '%Y-%m-%d') AS spelt, regexp_replace(a, '_p\\d{{3}}$', '') AS doc_group, right(a, 3)::INT AS page, a[1:4]::INT AS year FROM f"""
)
def issue_date(spark, d):
    f = file_names(spark, d)
    return f.select("event_id", t.issue_date(F.col("a")).alias("compact"), t.issue_date(F.col("b")).alias("spelt"), t.doc_group(F.col("a")).alias("doc_group"), t.page_number(F.col("a")).alias("page"), t.file_year(F.col("b")).alias("year"))


@query(
    """SELECT event_id, strftime(make_date((1890 - CASE WHEN event_id % 2 = 1 AND month(ts) = 12 THEN 1 ELSE 0 END)::INT, month(ts)::INT, day(ts)::INT), '%Y-%m-%d') AS iso FROM events"""
)
def arrival_iso(spark, d):
    issue_month = F.when(F.col("event_id") % 2 == 1, 1).otherwise(6)
    return table(spark, d, "events").select("event_id", t.arrival_iso(F.date_format("ts", "MMM. d"), F.lit(1890), issue_month).alias("iso"))


@query(
    """WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, user_id, ts FROM events),
l AS (SELECT *, CASE WHEN seq % 4 = 1 THEN strftime(ts, '%B ') || day(ts) || 'th. Vesta-Riga' ELSE day(ts) || ' Vesta-Riga' END AS line FROM e),
m AS (SELECT *, last_value(CASE WHEN seq % 4 = 1 THEN CASE WHEN strftime(ts, '%b') = 'May' THEN 'May' ELSE strftime(ts, '%b') || '.' END END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS month FROM l)
SELECT event_id, month || ' ' || day(ts) AS date, 'Vesta-Riga' AS rest FROM m"""
)
def date_carry(spark, d):
    from wharfinger.sources.adapters import event_log

    day = F.dayofmonth("ts").cast("string")
    line = F.when(F.col("seq") % 4 == 1, F.concat(F.date_format("ts", "MMMM "), day, F.lit("th. Vesta-Riga"))).otherwise(F.concat(day, F.lit(" Vesta-Riga")))
    rows = event_log(spark, d).withColumn("line", line)
    rows = sequences.carry_forward(rows, t.explicit_month(F.col("line")), "month", "user_id", "seq")
    date, rest = t.dated(F.col("line"), F.col("month"))
    return rows.select("event_id", date.alias("date"), rest.alias("rest"))


QUANTITY = "CASE l_returnflag WHEN 'A' THEN l_quantity::INT || '-' || (l_quantity::INT + 9) WHEN 'N' THEN l_quantity::INT || '/4' WHEN 'R' THEN CASE WHEN l_linenumber = 1 THEN 'qty.' WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN '12 1/2' WHEN l_linenumber = 4 THEN l_quantity::INT || ',000,000' ELSE l_quantity::INT || ',250' END END"


@query(
    f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, {QUANTITY} AS s FROM lineitem), c AS (SELECT *, replace(s, ',', '') AS z FROM q),
p AS (SELECT *, CASE WHEN s = '' THEN NULL WHEN contains(z, '-') THEN try_cast(split_part(z, '-', 1) AS DOUBLE) WHEN contains(z, '/') THEN try_cast(split_part(z, '/', 1) AS DOUBLE) / try_cast(split_part(z, '/', 2) AS DOUBLE) ELSE try_cast(z AS DOUBLE) END AS value FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, s, value, CASE WHEN s = '' THEN 'empty' WHEN contains(z, '-') THEN CASE WHEN value IS NULL THEN 'non_numeric' ELSE 'range' END
  WHEN contains(z, '/') THEN CASE WHEN value IS NULL THEN 'non_numeric' ELSE 'fraction' END WHEN value IS NULL THEN 'non_numeric' WHEN value > 1000000 THEN 'extremely_large' WHEN value < 0 THEN 'negative' ELSE 'ok' END AS issue FROM p"""
)
def quantity_parse(spark, d):
    n = F.col("l_quantity").cast("int")
    line = F.col("l_linenumber")
    odd = F.when(line == 1, "qty.").when(line == 2, "").when(line == 3, "12 1/2").when(line == 4, F.concat(n.cast("string"), F.lit(",000,000"))).otherwise(F.concat(n.cast("string"), F.lit(",250")))
    s = F.when(F.col("l_returnflag") == "A", F.concat_ws("-", n, n + 9)).when(F.col("l_returnflag") == "N", F.concat(n.cast("string"), F.lit("/4"))).when(F.col("l_returnflag") == "R", odd)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.alias("s"))
    value, issue = t.quantity(F.col("s"))
    return rows.select("*", value.alias("value"), issue.alias("issue"))


@query("SELECT source_file, line_no, (contains(text, 'the') :: INT + contains(text, 'und')::INT + contains(text, split_part(text, ' ', 1))::INT)::BIGINT AS verified, 3 AS total FROM ln", lines=True)
def verbatim_check(spark, d):
    tokens = F.array(F.lit("the"), F.lit("und"), F.element_at(F.split("text", " "), 1))
    return page_lines(spark, d).select("source_file", "line_no", t.verbatim(F.col("text"), tokens).alias("verified"), F.size(tokens).alias("total"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))[1:200] AS text FROM documents")
def sanitized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", t.sanitize(F.col("text"), 200).alias("text"))
