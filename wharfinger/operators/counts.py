"""Count cubes: shipments are counted, quantities never summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def label_cube(df: DataFrame, labels: str, label: str, *keys: str) -> DataFrame:
    """Counts with each row once under each of its distinct labels."""
    return count_by(df.select(*keys, F.explode(F.array_distinct(labels)).alias(label)), *keys, label)


def total_and_labels(df: DataFrame, labels: str, label: str, *keys: str) -> DataFrame:
    """A row for each key with all its rows (label null) and one for each label. Two sums
    rather than grouping sets over exploded rows: rows without a label count in the total."""
    total = count_by(df, *keys).select(*keys, F.lit(None).cast("string").alias(label), "n")
    return total.unionByName(label_cube(df, labels, label, *keys))


def cube_levels(df: DataFrame, labels: str, label: str, first: str, second: str, key: str) -> DataFrame:
    """level, first, second, key, label and n of three levels: both sides (route), the second alone
    (imports) and the first alone (exports), each in all (label null) and by label. Rows without a side
    are in the levels that don't name it."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    out = []
    for level, keys in (("route", (first, second)), ("imports", (second,)), ("exports", (first,))):
        rows = df
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        cube = total_and_labels(rows, labels, label, *keys, key)
        out.append(cube.select(F.lit(level).alias("level"), *[F.col(c) if c in keys else none(c) for c in (first, second)], key, label, "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def ranked(df: DataFrame, by: str, *ties: str, name: str = "rank") -> DataFrame:
    """Places by falling `by`, ties in order. For the few rows of a roll-up: one task sees all."""
    return df.withColumn(name, F.row_number().over(W.orderBy(F.desc(by), *ties)))


def top_in_group(df: DataFrame, k: int, by: str, ties: list[str], *group: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(by), *ties))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def share_of(df: DataFrame, n: str, *within: str, name: str = "share") -> DataFrame:
    """n over the sum of n within a group."""
    return df.withColumn(name, F.round(F.col(n) / F.sum(n).over(W.partitionBy(*within)), 6))


def dense_shares(df: DataFrame, row: str, column: str) -> DataFrame:
    """Share of each column value in each row value, with zero rows for pairs that never occur.
    The grid is rows times columns of small dimensions."""
    grid = df.select(row).distinct().crossJoin(df.select(column).distinct())
    full = grid.join(count_by(df, row, column), [row, column], "left").fillna(0, ["n"])
    return share_of(full, "n", row)


def pivot_share(df: DataFrame, column: str, values: list[str], *keys: str) -> DataFrame:
    """n and the share of each listed value, as columns."""
    shares = [F.round(F.avg((F.col(column) == v).cast("double")), 6).alias(v) for v in values]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *shares)


def flag_share(df: DataFrame, flag: Column, *keys: str, least: int = 1) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(flag.cast("double")), 6).alias("share"))
    return out.where(F.col("n") >= least)


def concentration(df: DataFrame, partner: str, *keys: str, least: int = 1) -> DataFrame:
    """n, partners, the largest one with its share, the Herfindahl index and its inverse."""
    n = count_by(df, *keys, partner)
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(partner).alias("p")))
    out = n.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("partners"), best.alias("b"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    hhi = F.col("squares") / (F.col("total") * F.col("total"))
    out = out.where(F.col("total") >= least)
    return out.select(*keys, F.col("total").alias("n"), "partners", F.col("b.p").alias("top"), F.round(-F.col("b.m") / F.col("total"), 6).alias("top_share"), F.round(hhi, 6).alias("hhi"), F.round(1 / hhi, 6).alias("effective"))


def lift(df: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    """Location quotient: the share of a within b over the share of a in all."""
    n = count_by(df, a, b)
    sums = n.join(n.groupBy(a).agg(F.sum("n").alias("na")), a).join(n.groupBy(b).agg(F.sum("n").alias("nb")), b).crossJoin(n.agg(F.sum("n").alias("nn")))
    return sums.where(F.col("n") >= least).select(a, b, "n", F.round((F.col("n") / F.col("na")) / (F.col("nb") / F.col("nn")), 6).alias("lift"))


def specialisation(df: DataFrame, who: Column, labels: str, label: str) -> DataFrame:
    """Share of each label among the rows of one party over its share among all rows."""
    rows = df.select(who.alias("w"), F.array_distinct(labels).alias("l"))
    sizes = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("w").alias("own"))
    n = rows.select("w", F.explode("l").alias(label)).groupBy(label).agg(F.count(F.lit(1)).alias("n_all"), F.count_if("w").alias("n_own"))
    return n.crossJoin(F.broadcast(sizes)).select(label, "n_all", "n_own", F.round((F.col("n_own") / F.col("own")) / (F.col("n_all") / F.col("all")), 6).alias("rca"))


def profile_cosine(df: DataFrame, party: str, label: str) -> DataFrame:
    """Cosine of the label counts of each pair of parties, a before b."""
    n = count_by(df, party, label)
    size = n.groupBy(party).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    a, b = n.select(F.col(party).alias("a"), label, F.col("n").alias("x")), n.select(F.col(party).alias("b"), label, F.col("n").alias("y"))
    dot = a.join(b, label).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    sa, sb = size.select(F.col(party).alias("a"), F.col("size").alias("sa")), size.select(F.col(party).alias("b"), F.col("size").alias("sb"))
    return dot.join(sa, "a").join(sb, "b").select("a", "b", F.round(F.col("d") / (F.col("sa") * F.col("sb")), 6).alias("cosine"))


def shift_share(df: DataFrame, pool: str, period: str, of: Column) -> DataFrame:
    """How a party's share changed from early to late: within pools, by the pools' weights,
    and both together. Pools of the early period count."""
    n = df.where(F.col(period).isin("early", "late")).groupBy(pool).agg(*[e for p in ("early", "late") for e in (F.count_if(F.col(period) == p).alias(f"n_{p}"), F.count_if((F.col(period) == p) & of).alias(f"c_{p}"))])
    sums = n.agg(F.sum("n_early").alias("t_early"), F.sum("n_late").alias("t_late"), F.sum("c_early").alias("k_early"), F.sum("c_late").alias("k_late"))
    rows = n.where("n_early > 0").crossJoin(F.broadcast(sums))
    we, wl = F.col("n_early") / F.col("t_early"), F.col("n_late") / F.col("t_late")
    se, sl = F.col("c_early") / F.col("n_early"), F.coalesce(F.try_divide("c_late", "n_late"), F.lit(0.0))
    out = rows.agg(F.sum(we * (sl - se)).alias("within"), F.sum((wl - we) * se).alias("between"), F.max(F.col("k_late") / F.col("t_late") - F.col("k_early") / F.col("t_early")).alias("change"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("within", "between", "change")], F.round(F.col("change") - F.col("within") - F.col("between"), 6).alias("interaction"))


def expected_share(df: DataFrame, unit: str, stratum: str, of: Column) -> DataFrame:
    """Actual share by unit and the one expected from its mix of strata (direct standardisation)."""
    rows = df.select(unit, stratum, of.cast("double").alias("o"))
    pooled = rows.groupBy(stratum).agg(F.avg("o").alias("p"))
    n = rows.groupBy(unit, stratum).agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("k"))
    out = n.join(pooled, stratum).groupBy(unit).agg(F.sum("n").alias("n"), F.round(F.sum("k") / F.sum("n"), 6).alias("actual"), F.round(F.sum(F.col("n") * F.col("p")) / F.sum("n"), 6).alias("expected"))
    return out


def persistence(df: DataFrame, year: str, group: str, *route: str) -> DataFrame:
    """Of the routes active in a year, the share active in the next year of the calendar, by
    group; the last year has no next."""
    active = df.select(group, *route, year).distinct()
    calendar = df.select(year).distinct().withColumn("next", F.lead(year).over(W.orderBy(year)))
    later = active.select(*route, F.col(year).alias("next"), F.lit(1).alias("again"))
    rows = active.join(F.broadcast(calendar.where("next is not null")), year).join(later, [*route, "next"], "left")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("again", F.lit(0)).cast("double")), 6).alias("persistence"))


def long_lived(df: DataFrame, year: str, least: int, *route: str, parts: int = 0) -> DataFrame:
    """Routes with enough years. parts: partitions over which routes and years are dealt before they are grouped."""
    if parts:
        df = df.select(*route, year).repartition(parts, *route, year)
    out = df.groupBy(*route).agg(F.countDistinct(year).alias("n_years"), F.min(year).alias("first"), F.max(year).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n_years") >= least)


def careers(df: DataFrame, who: list[str], route: list[str], least: int) -> DataFrame:
    """Voyages, the modal route (ties to the first by name) and its share, for those with enough."""
    n = count_by(df, *who, *route)
    best = F.min(F.struct((-F.col("n")).alias("m"), F.concat_ws(" > ", *route).alias("r")))
    out = n.groupBy(*who).agg(F.sum("n").alias("voyages"), best.alias("b")).where(F.col("voyages") >= least)
    return out.select(*who, "voyages", F.col("b.r").alias("route"), F.round(-F.col("b.m") / F.col("voyages"), 6).alias("fidelity"))


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The middle value, of two middle ones the upper."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    size = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("_p", place).withColumn("_n", size).where("_p = _n div 2 + 1").select(*keys, F.col(value).alias("median"))


def specialists(df: DataFrame, who: str, what: str, least: int, share: float) -> DataFrame:
    out = concentration(df, what, who, least=least)
    return out.where(F.col("top_share") >= share).select(who, "n", "top", "top_share")


def cohort_fates(df: DataFrame, who: str, place: str, stay: str, move: str, k: int) -> DataFrame:
    """The k largest early parties and what became of them late."""
    early = top(count_by(df.where("period = 'early'"), who), k, "n", who)
    late = df.where("period = 'late'").groupBy(who).agg(F.count_if(F.col(place) == stay).alias("s"), F.count_if(F.col(place) == move).alias("m"))
    fate = F.when(F.col("s").isNull(), "disappeared").when((F.col("s") >= F.col("m")) & (F.col("s") > 0), "stayed").when(F.col("m") > 0, "moved").otherwise("left")
    return early.join(late, who, "left").select(who, "n", fate.alias("fate"))


def compact(levels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ports, forms, cells) of cube_levels: names with their places in order, from 0 on, and cells with places for
    names: level, o and d (null where the level has none), f (-1 for all forms together), year, n. Names are dimensions."""

    def places(names: DataFrame, column: str) -> DataFrame:
        some = names.where(F.col(column).isNotNull()).distinct()
        return some.withColumn("place", F.row_number().over(W.orderBy(column)) - 1)

    ports = places(levels.select(F.explode(F.array("origin", "dest")).alias("port")), "port")
    forms = places(levels.select("form"), "form")
    cells = levels
    for column, dim, name, place in (("origin", ports, "port", "o"), ("dest", ports, "port", "d"), ("form", forms, "form", "f")):
        cells = cells.join(dim.select(F.col(name).alias(column), F.col("place").alias(place)), column, "left")
    return ports, forms, cells.select("level", "o", "d", F.coalesce("f", F.lit(-1)).alias("f"), "year", "n")
