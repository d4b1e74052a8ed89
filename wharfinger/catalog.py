"""The library's own queries by name, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: arrivals() in SQL, as a common table expression.
ARRIVALS = """arr AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS record_id,
    year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, strftime(l_shipdate, '%Y-%m') AS issue,
    sn.n_name AS origin, sr.r_name AS origin_region, cn.n_name AS dest, cr.r_name AS coast,
    list_distinct([p_type, split_part(p_name, ' ', -1)]) AS forms, split_part(p_name, ' ', 1) AS species,
    l_linestatus = 'F' AS steam, s_name AS ship, c_name AS merchant,
    CASE WHEN year(l_shipdate) <= 1997 THEN 'early' WHEN year(l_shipdate) >= 1999 THEN 'late' END AS period,
    year(l_shipdate) % 2 = 1 AS good_year, l_quantity AS quantity, l_shipdate AS arrived
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN part ON l_partkey = p_partkey),
lab AS (SELECT * EXCLUDE (forms), unnest(forms) AS form FROM arr)
"""

#: page_lines() in SQL.
LINES = """ln AS (
  SELECT source_file, i::INT AS line_no, t[i] AS text
  FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT source || '/' || doc_id AS source_file, string_split(text, chr(10)) AS t FROM documents)))
"""


def query(sql: str | None = None, arrivals: bool = False, lines: bool = False, name: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            base = [x for x, on in ((ARRIVALS, arrivals), (LINES, lines)) if on]
            text = sql.strip()
            if base and text.startswith("WITH "):
                base.append(text[5:])
                ORACLES[key] = "WITH " + ", ".join(base)
            else:
                ORACLES[key] = ("WITH " + ", ".join(base) + "\n" if base else "") + text
        return f

    return register


from wharfinger.plans import audits, checks, cubes, entities, more, records, reports, statistics, trade  # noqa: E402, F401  they register themselves
