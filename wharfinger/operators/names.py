"""Names of ports and firms: cascades of look-ups, merges, aliases."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wharfinger.sources.files import saved


def squash_port(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"[.,'\s]+", " ")))


def squash_firm(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def one_each(dim: DataFrame, key: Column, order: list) -> DataFrame:
    """A dimension with one row a key: the first in order."""
    place = F.row_number().over(W.partitionBy("_k").orderBy(*order))
    return dim.withColumn("_k", key).withColumn("_p", place).where("_p = 1").drop("_p")


def normalise(df: DataFrame, name: str, mapping: DataFrame, errors: DataFrame, coords: DataFrame) -> DataFrame:
    """name's normalised form and status. mapping (variant, canonical, ordinal), errors (name)
    and coords (name, lat, lon, ordinal) are small tables. The cascade: empty; an error in any
    case; a mapping as it stands, then in any case; a coordinate likewise; then squashed forms,
    of mappings and of coordinates. Distinct names are resolved, then joined back."""
    names = df.select(F.coalesce(F.col(name), F.lit("")).alias("_n")).distinct()
    plain = F.regexp_replace("_n", r"\s*\(s\)\s*$", "")
    stages = [
        ("e", one_each(errors, F.lower("name"), ["name"]).select("_k", F.lit("").alias("v")), F.lower("_n")),
        ("m", one_each(mapping, F.col("variant"), ["ordinal"]).select("_k", F.col("canonical").alias("v")), F.col("_n")),
        ("mi", one_each(mapping, F.lower("variant"), [F.desc("ordinal")]).select("_k", F.col("canonical").alias("v")), F.lower("_n")),
        ("c", one_each(coords, F.col("name"), ["ordinal"]).select("_k", F.col("name").alias("v")), F.col("_n")),
        ("ci", one_each(coords, F.lower("name"), ["ordinal"]).select("_k", F.col("name").alias("v")), F.lower("_n")),
        ("ms", one_each(mapping, squash_port(F.col("variant")), ["ordinal"]).select("_k", F.col("canonical").alias("v")), squash_port(plain)),
        ("cs", one_each(coords, squash_port(F.col("name")), ["ordinal"]).select("_k", F.col("name").alias("v")), squash_port(plain)),
    ]
    for tag, dim, key in stages:
        dim = dim.select(F.col("_k").alias(f"_k{tag}"), F.col("v").alias(f"_v{tag}"))
        names = names.join(dim, key == F.col(f"_k{tag}"), "left")
    c = lambda t: F.col(f"_v{t}")
    mapped, canonical = F.coalesce(c("m"), c("mi")), F.coalesce(c("c"), c("ci"))
    status = F.when(F.col("_n") == "", "empty").when(c("e").isNotNull(), "error").when(mapped.isNotNull(), "mapped").when(canonical.isNotNull(), "canonical").when(c("ms").isNotNull(), "mapped").when(c("cs").isNotNull(), "canonical").otherwise("unmapped")
    value = F.when((F.col("_n") == "") | c("e").isNotNull(), F.col("_n")).otherwise(F.coalesce(mapped, canonical, c("ms"), c("cs"), F.col("_n")))
    found = names.select("_n", value.alias(f"{name}_normalized"), status.alias(f"{name}_status"))
    return df.withColumn("_n", F.coalesce(F.col(name), F.lit(""))).join(found, "_n").drop("_n")


def exact_merge(df: DataFrame, name: str, seq: str) -> DataFrame:
    """key (the squashed name), canonical (its most frequent form, ties to the first seen) and n."""
    forms = df.groupBy(squash_firm(F.col(name)).alias("key"), name).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "first", F.col(name).alias("f")))
    return forms.groupBy("key").agg(best.alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_forms")).select("key", F.col("b.f").alias("canonical"), "n", "n_forms")


def spelled(low: Column) -> Column:
    """The characters of a text, each with the number of times it has come so far: a set that keeps repeats."""
    chars = F.filter(F.split(low, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def common_least(n: Column, m: Column, ratio: float) -> Column:
    """How many characters texts of n and m have in common at least, if their ratio is to be met."""
    return F.ceil(F.lit(ratio) * (n + m) / 2 - F.lit(1e-9)).cast("int")


def alike(left: DataFrame, right: DataFrame, ratio: float, also: Column | None = None) -> DataFrame:
    """a, x, b and y (small letters of a and b) of the pairs of names, one of each side's column
    name, that have as many characters in common as the ratio, twice those over all, takes.

    An inverted index finds them: the characters of a name are put in order, rare ones first, and two
    names with so much in common must share one of their first few, as many as they may do without, and one more. The index
    is by character and length, so a name meets those alone whose length allows the ratio. A pair is
    made where its first shared character is, so none is made twice. `also` is a further condition on a, b, x and y."""

    def letters(names: DataFrame, name: str, low: str, chars: str) -> DataFrame:
        return names.select(F.col("name").alias(name), F.lower("name").alias(low)).where(F.length(low) > 0).distinct().withColumn(chars, spelled(F.col(low)))

    lefts, rights = letters(left, "a", "x", "s"), letters(right, "b", "y", "t")
    each = lefts.select(F.explode("s").alias("c")).unionAll(rights.select(F.explode("t").alias("c")))
    often = each.groupBy("c").agg(F.count(F.lit(1)).alias("f"))

    def in_order(names: DataFrame, chars: str, *keys: str) -> DataFrame:
        rows = names.select(*keys, F.explode(chars).alias("c")).join(often, "c")
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "c"))), lambda p: p["c"]).alias(chars))

    reach = F.lit(ratio / (2 - ratio))  # of a name's length the least that a partner may have
    m, n = F.size("t"), F.size("s")
    index = in_order(rights, "t", "b", "y").withColumn("m", m)
    index = index.select("b", "y", "t", "m", F.posexplode(F.slice("t", F.lit(1), F.col("m") - common_least(F.ceil(F.col("m") * reach - 1e-9), F.col("m"), ratio) + 1)).alias("q", "c"))
    probe = in_order(lefts, "s", "a", "x").withColumn("n", n)
    probe = probe.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * reach - 1e-9).cast("int"), F.floor(F.col("n") / reach + 1e-9).cast("int"))))
    probe = probe.select("a", "x", "s", "n", "m", F.posexplode(F.slice("s", F.lit(1), F.col("n") - common_least(F.col("n"), F.col("m"), ratio) + 1)).alias("p", "c"))
    least = common_least(F.col("n"), F.col("m"), ratio)
    pairs = probe.join(index, ["c", "m"]).where(F.col("q") <= F.col("m") - least)
    pairs = pairs if also is None else pairs.where(also)
    first = F.get(F.array_intersect(F.slice("s", F.lit(1), F.col("n") - least + 1), F.slice("t", F.lit(1), F.col("m") - least + 1)), F.lit(0))
    return pairs.where((F.col("c") == first) & (F.size(F.array_intersect("s", "t")) >= least)).select("a", "x", "b", "y")


def with_ratio(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs with their ratio, in Arrow batches, if it is at least `least`."""

    def ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["ratio"] = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(b["x"], b["y"], strict=True)]
            yield b

    return pairs.mapInPandas(ratio, "a string, x string, b string, y string, ratio double").where(F.col("ratio") >= least)


def fuzzy_merge(canon: DataFrame, big: int = 100, shortest: int = 8, least: float = 0.9) -> DataFrame:
    """canonical and target: rare names that are nearly a frequent one with the same first
    letter and about its length; ties to the first in order of names."""
    few = canon.where((F.col("n") < big) & (F.length("canonical") >= shortest)).select(F.col("canonical").alias("name"))
    many = canon.where(F.col("n") >= big).select(F.col("canonical").alias("name"))
    length = F.abs(F.length("x") - F.length("y")) <= F.greatest(F.lit(3), F.floor(F.length("x") / 4))
    scored = with_ratio(alike(few, many, least, (F.substring("x", 1, 1) == F.substring("y", 1, 1)) & length), least)
    best = F.min(F.struct((-F.col("ratio")).alias("m"), "b"))
    return scored.groupBy("a").agg(best.alias("t")).select(F.col("a").alias("canonical"), F.col("t.b").alias("target"), F.round(-F.col("t.m"), 6).alias("ratio"))


def unmapped(df: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """Names with their counts that no known name (column name) equals in any case."""
    n = df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).withColumn("_l", F.lower(name))
    return n.join(known.select(F.lower("name").alias("_l")).distinct(), "_l", "left_anti").select(name, "n")


def resolve_aliases(alias: DataFrame) -> DataFrame:
    """Follows variant -> canonical to the end, however long the path; one that runs into a cycle ends
    at the least name on the way. A variant given twice goes to its least canonical. Each round
    doubles the steps, until all paths are at their ends or, where some run in cycles, the steps are as many as there are aliases; rounds are cut by checkpoints."""
    least = F.least("variant", F.min("canonical"))
    out = saved(alias.where("variant is not null and canonical is not null").groupBy("variant").agg(F.min("canonical").alias("end"), least.alias("least")))
    for _ in range(out.count().bit_length()):
        nxt = out.select(F.col("variant").alias("_v"), F.col("end").alias("_e"), F.col("least").alias("_l"))
        j = out.join(nxt, F.col("end") == F.col("_v"), "left")
        if j.where("_v is not null").isEmpty():  # all paths are at their ends
            break
        out = saved(j.select("variant", F.coalesce("_e", "end").alias("end"), F.least("least", "_l").alias("least")))
    more = out.select(F.col("variant").alias("_v"))
    return out.join(more, F.col("end") == F.col("_v"), "left").select("variant", F.when(F.col("_v").isNotNull(), F.col("least")).otherwise(F.col("end")).alias("canonical"))


def merge_authorities(*sources: DataFrame) -> DataFrame:
    """variant and canonical over sources in order of falling priority, with the forms of each
    variant in upper and lower case where nothing else claims them."""
    rows = None
    for p, s in enumerate(sources):
        for q, form in enumerate((F.col("variant"), F.upper("variant"), F.lower("variant"))):
            x = s.select(form.alias("variant"), "canonical", F.lit(1 if q else 0).alias("q"), F.lit(p).alias("p"))
            rows = x if rows is None else rows.union(x)
    return one_each(rows, F.col("variant"), ["q", "p", "canonical"]).select("variant", "canonical")


#: What stands in a port's field and never is a port.
NEVER_PORTS = ("Order", "ORDER", "order", "(s)", "Ditto", "ditto")


def cases(df: DataFrame, name: str) -> DataFrame:
    """Each row three times: with the name as it stands, in capitals and in small letters."""
    return df.withColumn(name, F.explode(F.array(F.col(name), F.upper(name), F.lower(name))))


def reviewed_authority(manual: DataFrame, reviewed: DataFrame, defaults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variant and canonical, names that are errors). manual: variant, canonical, ordinal. reviewed: original,
    action, map_to, ordinal, where MAP makes a mapping that goes before the manual ones and ERROR an error, in any case and with
    spaces about; other actions say nothing. Both count in capitals and small letters too, and of rows for the same name the
    one with the highest ordinal does. defaults (variant, canonical, ordinal) count as they stand, where nothing else has the
    name, the lowest ordinal first. Rows without a name or a canonical form are left out."""
    action, original, target = F.upper(F.trim("action")), F.trim("original"), F.trim("map_to")
    maps = reviewed.where((action == "MAP") & (original != "") & (target != "")).select(original.alias("variant"), target.alias("canonical"), "ordinal")
    ranked = lambda df, p, o: df.where("variant is not null and canonical is not null").select("variant", "canonical", F.lit(p).alias("p"), o.alias("o"))
    rows = ranked(cases(maps, "variant"), 0, -F.col("ordinal")).union(ranked(cases(manual, "variant"), 1, -F.col("ordinal"))).union(ranked(defaults, 2, F.col("ordinal")))
    wrong = cases(reviewed.where((action == "ERROR") & (original != "")).select(original.alias("name")), "name")
    wrong = wrong.union(reviewed.sparkSession.createDataFrame([(n,) for n in NEVER_PORTS], "name string")).distinct()
    return one_each(rows, F.col("variant"), ["p", "o", "canonical"]).select("variant", "canonical"), wrong


def with_repaired(mapping: DataFrame) -> DataFrame:
    """variant and canonical with mojibake repaired in both, and the variants as they stand beside the
    repaired ones. A variant that stands in the table goes before one that a repair makes, then the least canonical."""
    fixed = repair_mojibake(F.col("canonical")).alias("canonical")
    rows = mapping.select("variant", fixed, F.lit(0).alias("q")).union(mapping.select(repair_mojibake(F.col("variant")).alias("variant"), fixed, F.lit(1).alias("q")))
    return one_each(rows, F.col("variant"), ["q", "canonical"]).select("variant", "canonical")


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other text unchanged."""
    single = text.rlike("^[\\x{00}-\\x{FF}]*$") & text.rlike("[ÃÂ]")
    return F.when(single, F.coalesce(F.try_validate_utf8(F.encode(F.when(single, text), "ISO-8859-1").cast("string")), text)).otherwise(text)


def suggestions(rows: DataFrame, name: str, known: DataFrame, least: int = 10, ratio: float = 0.85, settled: DataFrame | None = None) -> DataFrame:
    """For names that occur often enough the known name most like each, if it is like enough.
    Names that are settled in any case (known ones, if not given) need none. Ties go to the first
    known name."""
    often = rows.where(F.col("n") >= least).select(F.col(name).alias("name"), "n")
    done = (known if settled is None else settled).select(F.lower("name").alias("_done")).distinct()
    often = often.join(done, F.lower("name") == F.col("_done"), "left_anti")
    best = F.min(F.struct((-F.col("ratio")).alias("m"), "b"))
    found = with_ratio(alike(often, known, ratio), ratio).groupBy("a").agg(best.alias("t"))
    return often.join(found, F.col("name") == F.col("a")).select("name", "n", F.col("t.b").alias("suggestion"), F.round(-F.col("t.m"), 6).alias("ratio"))


def merge_coordinates(points: DataFrame, extra: DataFrame) -> DataFrame:
    """name, lat and lon: points first, extra ones where no point has the name, and the names
    in upper and lower case where nothing has them."""
    rows = None
    for p, s in enumerate((points, extra)):
        for q, form in enumerate((F.col("name"), F.upper("name"), F.lower("name"))):
            x = s.select(form.alias("name"), "lat", "lon", F.lit(1 if q else 0).alias("q"), F.lit(p).alias("p"))
            rows = x if rows is None else rows.union(x)
    return one_each(rows, F.col("name"), ["q", "p", "lat", "lon"]).select("name", "lat", "lon")


def status_counts(rows: DataFrame, file: str, status: str, kinds: list[str]) -> DataFrame:
    """Rows of each file by status, a column for each."""
    return rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(status) == k).alias(k) for k in kinds])


def coverage(rows: DataFrame, sides: tuple[str, str], top: int = 50, missing: int = 100) -> DataFrame:
    """section, side, value, n and percent (of all rows) of normalised rows: how many have each status;
    the names without a mapping that occur most often, `missing` of each side, and the others, `top` of
    each; and of how many rows both sides are known, or which. Rows are counted once by side, status and name; ties fall by name."""
    cells = [F.struct(F.lit(s).alias("side"), F.col(f"{s}_status").alias("status"), F.col(f"{s}_normalized").alias("name")) for s in sides]
    n = rows.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.side", "c.status", "c.name").agg(F.count(F.lit(1)).alias("n"))
    status = n.groupBy("side", F.col("status").alias("value")).agg(F.sum("n").alias("n")).select(F.lit("status").alias("section"), "side", "value", "n")
    section = F.when(F.col("status") == "unmapped", "unmapped").otherwise("known")
    named = n.groupBy(section.alias("section"), "side", F.col("name").alias("value")).agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("section", "side").orderBy(F.desc("n"), "value"))
    named = named.withColumn("_p", place).where(F.col("_p") <= F.when(F.col("section") == "unmapped", missing).otherwise(top)).drop("_p")
    known = [F.col(f"{s}_status").isin("mapped", "canonical") for s in sides]
    both = F.when(known[0] & known[1], "both").when(known[0], f"{sides[0]} only").when(known[1], f"{sides[1]} only").otherwise("neither")
    pairs = rows.groupBy(both.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("pair").alias("section"), F.lit("both").alias("side"), "value", "n")
    all_ = rows.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return status.union(named).union(pairs).crossJoin(all_).select("section", "side", "value", "n", F.round(F.lit(100.0) * F.col("n") / F.col("_all"), 2).alias("percent"))


def first_place(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """name, lat and lon of the first row of each name, in the given order, that has both."""
    placed = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    first = placed.groupBy(name).agg(F.min_by(F.struct("lat", "lon"), F.struct(*order)).alias("p"))
    return first.select(name, "p.lat", "p.lon")


def located(rows: DataFrame, name: str, coords: DataFrame, prefix: str) -> DataFrame:
    """rows with <prefix>_lat and <prefix>_lon of a name: the place of that name as it stands, else of
    the first one (by ordinal) that differs in case alone. coords has name, lat, lon and ordinal."""
    exact = first_place(coords, "name", "ordinal").select(F.col("name").alias("_n"), F.struct("lat", "lon").alias("_exact"))
    loose = first_place(coords.withColumn("name", F.lower("name")), "name", "ordinal").select(F.col("name").alias("_l"), F.struct("lat", "lon").alias("_loose"))
    found = rows.join(exact, F.col(name) == F.col("_n"), "left").join(loose, F.lower(name) == F.col("_l"), "left")
    place = F.coalesce("_exact", "_loose")
    return found.withColumn(f"{prefix}_lat", place["lat"]).withColumn(f"{prefix}_lon", place["lon"]).drop("_n", "_l", "_exact", "_loose")
