"""From labelled lines to enriched arrivals: the stages in order, each a frame from a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfinger.functions import grammar, rules, text
from wharfinger.operators import names, repeats, sequences
from wharfinger.plans.staged import ALL, Staged
from wharfinger.sources.files import companions

#: Patterns of a port's header and of the end of a firm's name at the head of a line.
PORT_HEADER = r"^([A-Z][A-Z\s\-\(\)'\.&,]+)"
FIRM_GOES_ON = r"^[A-Z][\w.\s,&']{0,40}(?:(?:Co\.?|Sons?|Bros?\.?)\s*[;,]|;)"


def is_continuation(line: Column) -> Column:
    """A line that goes on with the entry above: a small letter or mark at its head, an amount of
    cargo (but not a day and a ship), or the end of a firm's name."""
    t = F.trim(line)
    counted = F.regexp_extract(t, r"^[\d,]+(?:\s+\d/\d)?\s+(\S+)", 1)
    cargo = counted.rlike(rf"(?i)^{grammar.any_of(grammar.UNITS)}\.?$|^{grammar.OPENS}") | counted.rlike(rf"(?i)^(?:{grammar.any_of(grammar.UNITS)}|{grammar.GOODS})\b")
    day = t.rlike(r"^\d{1,2}\s+[A-Z][a-z]")
    return t.rlike(r"^[\p{Ll})\-—–;,&]") | cargo & ~day | t.rlike(FIRM_GOES_ON)


def parse(lines: DataFrame, labels: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """Arrivals of a file's lines with the labels of its companion."""
    return parse_labelled(companions(lines, labels), ports)


def parse_labelled(lines: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """Arrivals of a file: port headers carried down, wrapped lines joined, dates carried on,
    then each logical line read. lines: source_file, line_no, text, line_type."""
    rows = lines.where(F.trim("text") != "")
    header = F.col("line_type") == "PORT_HEADER"
    named = F.regexp_extract(F.trim("text"), PORT_HEADER, 1)
    port = F.when(header & ~F.trim(named).isin("IMPORTS", "IMPORT", "EXPORTS", "") & (F.length(named) > 0), F.btrim(named, F.lit(" .,-")))
    rows = sequences.carry_forward(rows, port, "port", "source_file", "line_no")
    rows = sequences.carry_forward(rows, F.when(header, F.col("line_no")), "section", "source_file", "line_no")
    ships = rows.where("line_type = 'SHIPPING_DATA'").withColumn("part", F.concat_ws("|", "source_file", F.coalesce(F.col("section").cast("string"), F.lit("0"))))
    logical = sequences.stitch(ships, is_continuation(F.col("text")), "part", "line_no", "text")
    logical = logical.withColumn("source_file", F.substring_index("part", "|", 1)).join(ships.select("part", "line_no", "port"), ["part", "line_no"])
    logical = sequences.carry_forward(logical, text.explicit_month(F.col("text")), "month", "source_file", "line_no")
    date, rest = text.dated(F.col("text"), F.col("month"))
    rest = F.when(date.isNull(), F.regexp_replace(rest, r"^[0-3]?\d(?:st|nd|rd|th)?\.?\s+(?=[A-Z])", "")).otherwise(rest)
    records = grammar.parse_lines(logical.select("source_file", "line_no", F.coalesce("port", F.lit("")).alias("dest"), date.alias("date"), rest.alias("rest")), "rest", ports)
    return records.withColumn("record_id", F.sha2(F.concat_ws("|", "source_file", F.col("line_no").cast("string"), "raw_text"), 256)).drop("rest")


def deduplicate(records: DataFrame) -> DataFrame:
    """The first of equal records of an issue, over its pages."""
    rows = repeats.without_husks(records.withColumn("_cargo", F.when(F.size("cargo") > 0, "x")), "ship", "origin", "_cargo").drop("_cargo")
    rows = rows.withColumn("page", text.page_number(F.col("source_file")))
    return repeats.keep_first(rows, [text.doc_group(F.col("source_file")), repeats.signature(F.col("raw_text")), F.col("dest")], ["page", "source_file", "line_no"])


def enrich_cargo(records: DataFrame) -> DataFrame:
    """Cargo items with their clean commodity, forms, species and status."""

    def item(c):
        norm = rules.clean_commodity(c["commodity"])
        forms, species = rules.labels(norm, rules.form_rules()), rules.labels(norm, rules.species_rules())
        return F.struct(c["quantity"].alias("quantity"), c["unit"].alias("unit"), c["commodity"].alias("commodity"), norm.alias("normalized"), forms.alias("forms"), species.alias("species"), rules.commodity_status(norm, forms, species).alias("status"))

    return records.withColumn("cargo", F.transform("cargo", item))


def enrich_firms(records: DataFrame, big: int = 100) -> DataFrame:
    """Consignees by kind; named ones by their canonical form, ditto by the one before."""
    rows = records.withColumn("firm_kind", rules.firm_kind(F.col("consignee"))).withColumn("firm", F.when(F.col("firm_kind") == "named", rules.clean_firm(F.col("consignee"))))
    canon = names.exact_merge(rows.where("firm is not null").withColumn("_seen", F.struct("source_file", "line_no", "record_id")), "firm", "_seen")
    near = names.fuzzy_merge(canon.select("canonical", "n"), big=big)
    final = canon.join(near.select("canonical", "target"), "canonical", "left").select(F.col("key").alias("_key"), F.coalesce("target", "canonical").alias("canonical_firm"))
    key = F.coalesce(names.squash_firm(F.col("firm")), F.concat(F.lit("?"), "record_id"))  # no firm's key has a mark; rows without a firm spread
    rows = rows.withColumn("_key", key).join(final, "_key", "left").drop("_key")
    rows = sequences.resolve_ditto(rows, "firm_kind", "canonical_firm", "source_file", "line_no")
    return rows.drop("firm", "canonical_firm", "firm_kind").withColumnRenamed("resolved", "firm").withColumnRenamed("resolved_kind", "firm_kind")


def enrich_ports(records: DataFrame, mapping: DataFrame, errors: DataFrame, coords: DataFrame) -> DataFrame:
    """Both ports normalised and placed, and which of the two are."""
    rows = records
    for side in ("origin", "dest"):
        rows = names.normalise(rows, side, mapping, errors, coords)
        rows = names.located(rows, f"{side}_normalized", coords, side)
    good = lambda s: F.col(f"{s}_status").isin("mapped", "canonical")
    pair = F.when(good("origin") & good("dest"), "both").when(good("origin"), "origin_only").when(good("dest"), "destination_only").otherwise("neither")
    return rows.withColumn("port_status", pair)


def stages(mapping: DataFrame, errors: DataFrame, coords: DataFrame, ports: DataFrame | None = None, big: int = 100) -> list[tuple]:
    """The stages for Staged.run. Lines, goods and ports are read document by document; repeats go over
    the pages of an issue and firms are merged over all records, so these two are made over everything."""
    return [
        ("read", lambda lines: parse_labelled(lines, ports)),
        ("goods", enrich_cargo),
        ("ports", lambda rows: enrich_ports(rows, mapping, errors, coords)),
        ("single", deduplicate, ALL),
        ("firms", lambda rows: enrich_firms(rows, big), ALL),
    ]


def run(documents: DataFrame, lines: DataFrame, path: str, mapping: DataFrame, errors: DataFrame, coords: DataFrame, ports: DataFrame | None = None, big: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents, arrivals): every document with its status and error, and the arrivals of those that
    succeeded, each stage's output kept below path. What is there already is not made again.
    documents: source_file, status, error; lines: source_file, line_no, text, line_type."""
    return Staged(lines.sparkSession, path).run(documents, lines, stages(mapping, errors, coords, ports, big))
