"""Data-quality audits of parsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wharfinger.functions import rules


def completeness(df: DataFrame, *fields: str) -> DataFrame:
    """field, empty and percent of rows, in one pass over them."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"e_{c}") for c in fields])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"e_{c}").alias("empty")) for c in fields]))
    return sums.select("rows", each.alias("x")).select("x.field", "x.empty", F.round(F.col("x.empty") * 100 / F.greatest("rows", F.lit(1)), 2).alias("percent"))


def too_long(df: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    """A row for each field longer than its limit."""
    tests = [F.when(F.length(c) > n, F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), F.length(c).alias("size"))) for c, n in limits.items()]
    return df.select(key, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def error_rates(df: DataFrame, file: str, bad: Column, k: int = 50) -> DataFrame:
    """Files by their share of bad rows."""
    n = df.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return n.withColumn("rate", F.round(F.col("bad") / F.col("n"), 6)).orderBy(F.desc("rate"), file).limit(k)


def many_empty(df: DataFrame, file: str, empty: Column, share: float = 0.2) -> DataFrame:
    """Files of whose rows more than the share is empty."""
    n = df.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("empty"))
    return n.where(F.col("empty") > F.lit(share) * F.col("n")).withColumn("rate", F.round(F.col("empty") / F.col("n"), 3))


def stamped(df: DataFrame, name: str, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """df with the column as it should be, and (stamped, unresolvable): how many rows that changed, and
    how many of these have no value. A second run changes none."""
    new = df.withColumn("_new", value)
    if column not in df.columns:
        new = new.withColumn(column, F.lit(None).cast("string"))
    changed = ~F.col(column).eqNullSafe(F.col("_new"))
    counts = new.agg(F.count_if(changed).alias("stamped"), F.count_if(changed & F.col("_new").isNull()).alias("unresolvable"))
    return new.withColumn(column, F.col("_new")).drop("_new"), counts


def catalogue(df: DataFrame, value: Column, valid: DataFrame | None = None) -> DataFrame:
    """Values without case and their counts; those that `valid` (value) lacks, if it is given."""
    n = df.groupBy(F.lower(F.trim(value)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n if valid is None else n.join(valid, "value", "left_anti")


def missed_lines(lines: DataFrame, parsed: DataFrame, least: int = 3) -> DataFrame:
    """Runs of lines without a parsed record."""
    left = lines.join(parsed, ["source_file", "line_no"], "left_anti")
    island = F.col("line_no") - F.row_number().over(W.partitionBy("source_file").orderBy("line_no"))
    n = left.select("source_file", "line_no", island.alias("i")).groupBy("source_file", "i").agg(F.min("line_no").alias("first"), F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= least).drop("i")


def spread_sample(df: DataFrame, k: int, order: str, *group: str) -> DataFrame:
    """At most k rows of each group, evenly placed in order."""
    w = W.partitionBy(*group)
    place, size = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w)
    rows = df.withColumn("_p", place).withColumn("_n", size)
    first = (F.floor(F.col("_p") * F.lit(k) / F.col("_n")) != F.floor((F.col("_p") - 1) * F.lit(k) / F.col("_n"))) | (F.col("_p") == 0)
    return rows.where((F.col("_n") <= k) | first).drop("_p", "_n")


#: Ports whose headers a survey looks for.
MAJOR_PORTS = (
    "LONDON", "LIVERPOOL", "HULL", "BRISTOL", "CARDIFF", "GLASGOW", "NEWCASTLE", "GRIMSBY", "SUNDERLAND", "LEITH", "NEWPORT", "SWANSEA", "HARTLEPOOL",
    "GOOLE", "MIDDLESBROUGH", "TYNE", "SOUTHAMPTON", "GRANGEMOUTH", "GREENOCK", "DUNDEE", "BO'NESS", "BARROW", "GLOUCESTER", "ROCHESTER", "FALMOUTH", "FAVERSHAM",
)


def port_headers(text: Column, ports: tuple[str, ...] = MAJOR_PORTS) -> Column:
    """The ports that stand alone on a line, with or without a point, or at the end of a line that another follows,
    in any case; empty for no text."""
    has = lambda p: text.rlike(rf"(?imd)^{p}\.?\s*$") | text.rlike(rf"(?i){p}\s*\n")
    return F.filter(F.array(*[F.when(has(p), F.lit(p)) for p in ports]), lambda p: p.isNotNull())


#: Cargo words that a spot check looks for in names, and the longest name of a ship it lets pass.
SPOT_WORDS = r"(?i)\b(deals?|battens?|boards?|staves|lathwood|laths|firewood|pit ?-?props?|pitwood|sleepers|timber|spars|poles|logs|ends|pcs\.|lds\.|bdls\.|fms\.|stds\.)\b"
LONGEST_SHIP = 40


def suspicions(ship: Column, origin: Column, consignee: Column) -> Column:
    """Why a record looks wrong: an array of reasons, empty if it does not."""
    text = lambda c: F.coalesce(c, F.lit(""))
    reasons = {
        "digits_in_ship_name": text(ship).rlike(r"\d"), "cargo_in_ship_name": text(ship).rlike(SPOT_WORDS), "cargo_in_origin": text(origin).rlike(SPOT_WORDS),
        "digits_in_consignee": text(consignee).rlike(r"\d"), "long_ship_name": F.length(text(ship)) > LONGEST_SHIP,
    }
    return F.filter(F.array(*[F.when(on, F.lit(k)) for k, on in reasons.items()]), lambda r: r.isNotNull())


def hashed_sample(df: DataFrame, k: int, key: str, *group: str) -> DataFrame:
    """The k rows of each group whose keys' md5 is least: the same whatever else is there, and kept
    to k a task before they are moved."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.md5(F.col(key).cast("binary")), key))
    return df.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def spot_check(files: DataFrame, lines: DataFrame, records: DataFrame, least: int = 3) -> DataFrame:
    """For each of the files (source_file and other columns): the lines that ought to be read, those
    read, those missed, runs of `least` or more missed ones, the longest run, and records with a reason for
    suspicion. records: source_file, line_no, ship, origin, consignee."""
    mine = lines.join(files.select("source_file"), "source_file", "left_semi")
    found = records.join(files.select("source_file"), "source_file", "left_semi")
    left = mine.join(found.select("source_file", "line_no").distinct(), ["source_file", "line_no"], "left_anti")
    runs = missed_lines(mine.select("source_file", "line_no"), found.select("source_file", "line_no"), 1).groupBy("source_file").agg(F.count_if(F.col("n") >= least).alias("long_runs"), F.max("n").alias("longest_run"))
    n = mine.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_lines"))
    missed = left.groupBy("source_file").agg(F.count(F.lit(1)).alias("missed"))
    odd = found.where(F.size(suspicions(F.col("ship"), F.col("origin"), F.col("consignee"))) > 0).groupBy("source_file").agg(F.count(F.lit(1)).alias("suspicious"))
    out = files.join(n, "source_file", "left").join(missed, "source_file", "left").join(runs, "source_file", "left").join(odd, "source_file", "left")
    counts = ("n_lines", "missed", "long_runs", "longest_run", "suspicious")
    return out.select(*files.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]).withColumn("read", F.col("n_lines") - F.col("missed"))


def reporting_style(text: Column) -> Column:
    """individual, aggregated, mixed or unclear, by how ships and totals are named; not_found
    without any line that looks like either."""
    single, total = F.size(F.regexp_extract_all(text, F.lit(r"(@|\(s\)|-[A-Z][a-z]+-)"), F.lit(1))), F.size(F.regexp_extract_all(text, F.lit(r"(?i)\b(total|various|sundry)\b"), F.lit(1)))
    return F.when((single == 0) & (total == 0), "not_found").when(single > 3 * total, "individual").when(total > 3 * single, "aggregated").when((single > 0) & (total > 0), "mixed").otherwise("unclear")


def port_checks(df: DataFrame, port: str, fixes: DataFrame, headers: tuple[str, ...], variants: DataFrame) -> DataFrame:
    """What is wrong with each port name, with its rows: port, n, category (the first issue, "empty" or
    "ok"), issues, and what each rule would put in its place. fixes (value, fix) knows names cut
    short, variants (value, canonical) misread ones, both in capitals; headers are parts of headings."""
    upper = F.upper(F.trim("port"))
    n = df.groupBy(F.coalesce(F.col(port), F.lit("")).alias("port")).agg(F.count(F.lit(1)).alias("n"))
    n = n.join(fixes.select(F.col("value").alias("_f"), "fix"), upper == F.col("_f"), "left").join(variants.select(F.col("value").alias("_v"), "canonical"), upper == F.col("_v"), "left")
    short = upper.endswith("(") | upper.rlike(r"^\p{Lu}{1,3}$")
    heading = F.col("port").rlike(r"^[\d\-.,\s]+$")
    for h in headers:
        heading = heading | F.contains(upper, F.lit(h))
    n = n.withColumn("clean", rules.port_and_goods(F.col("port"))["port"])
    found = F.array(F.when(F.col("clean").isNotNull(), "port_cargo_combined"), F.when(F.col("_f").isNotNull(), "truncated").when(short, "unmatched_short"), F.when(heading, "header_as_port"), F.when(F.col("_v").isNotNull(), "ocr_variant"))
    n = n.withColumn("issues", F.when(upper == "", F.array().cast("array<string>")).otherwise(F.array_compact(found)))
    return n.select("port", "n", F.when(upper == "", "empty").otherwise(F.coalesce(F.get("issues", F.lit(0)), F.lit("ok"))).alias("category"), "issues", "clean", "fix", "canonical")


def fix_rules(checks: DataFrame) -> DataFrame:
    """rule, value and replacement (null: leave it out) from port_checks: ports without their goods, names
    completed, headings left out, misread names."""
    upper, has = F.upper(F.trim("port")), lambda x: F.array_contains("issues", x)
    rule = lambda on, name, value, new: F.when(on, F.struct(F.lit(name).alias("rule"), value.alias("value"), new.alias("replacement")))
    every = F.array(
        rule(has("port_cargo_combined"), "port_cargo_split", F.col("port"), F.col("clean")),
        rule(has("truncated") & (F.col("fix") != ""), "truncation_completion", upper, F.col("fix")),
        rule(has("header_as_port"), "error_exclusions", F.col("port"), F.lit(None).cast("string")),
        rule(has("ocr_variant"), "ocr_normalization", F.upper("port"), F.col("canonical")),
    )
    return checks.select(F.explode(F.array_compact(every)).alias("r")).select("r.*").distinct()


def summary(df: DataFrame, flags: dict[str, tuple[Column, str]], sums: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """metric, n, percent of rows and priority: how many rows each flag holds for, in one pass, and the sums
    of the column n of further frames."""
    counts = df.agg(F.count(F.lit(1)).alias("t"), *[F.count_if(x).alias(f"_{i}") for i, (x, _) in enumerate(flags.values())])
    each = [F.struct(F.lit(k).alias("metric"), F.col(f"_{i}").alias("n"), F.lit(p).alias("priority")) for i, (k, (_, p)) in enumerate(flags.items())]
    for i, (k, (rows, p)) in enumerate((sums or {}).items()):
        counts = counts.crossJoin(rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"s_{i}")))
        each.append(F.struct(F.lit(k).alias("metric"), F.col(f"s_{i}").alias("n"), F.lit(p).alias("priority")))
    return counts.select("t", F.explode(F.array(*each)).alias("x")).select("x.metric", "x.n", F.round(F.col("x.n") * 100 / F.greatest("t", F.lit(1)), 1).alias("percent"), "x.priority")


def rates_by(df: DataFrame, key: str, bad: Column) -> DataFrame:
    """Rows, bad rows and their share by a key such as the year."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.round(F.avg(bad.cast("double")), 6).alias("rate"))
