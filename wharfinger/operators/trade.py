"""Trade by country, sub-region and coast, beside official tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wharfinger.operators.counts import share_of, top_in_group

# Names in the official tables.
COLONIES = ("British North America", "Canada", "New Brunswick", "Nova Scotia", "British America")
SOURCE_PREFIXES = {"Russia": "Russia", "Sweden": "Sweden", "Norway": "Norway", "France": "France", "United States": "USA"}
SOURCE_NAMES = {"Germany": "Germany", "Prussia": "Germany"} | dict.fromkeys(COLONIES, "Canada")
WHOLES = ("World", "Total")
WOOD_WORDS = ("timber", "deal", "batten", "stave", "lath", "wainscot", "fir", "oak", "hewn", "sawn")
OTHER_GOODS = ("dye", "pulp", "paper", "bark", "pipe", "gun", "stone", "marble", "pitch", "furniture")
SAWN_WORDS = ("sawn", "deal", "batten")
HEWN_WORDS = ("hewn", "fir oak", "not sawn")


def official_country(source: Column) -> Column:
    """Country of a source in the official tables: by its name, else by how it begins; "Other" for
    further names, null for the sums of all and for null."""
    name = F.trim(source)
    named = F.coalesce(*[F.when(name == k, v) for k, v in SOURCE_NAMES.items()])
    begun = F.coalesce(*[F.when(name.startswith(k), v) for k, v in SOURCE_PREFIXES.items()])
    return F.when(~name.isin(*WHOLES), F.coalesce(named, begun, F.lit("Other")))


def official_kind(commodity: Column) -> Column:
    """sawn, hewn or other for an official commodity of wood, null for other goods."""
    low = F.lower(commodity)
    has = lambda words: low.rlike("|".join(words))
    return F.when(has(WOOD_WORDS) & ~has(OTHER_GOODS), F.when(has(SAWN_WORDS), "sawn").when(has(HEWN_WORDS), "hewn").otherwise("other"))


def with_group(df: DataFrame, name: str, lists: DataFrame, out: str) -> DataFrame:
    """df with the group of a name: lists has rows (name, group, ordinal), and where several lists
    hold a name the last one counts. Names in no list have none."""
    last = lists.groupBy(F.col("name").alias("_n")).agg(F.max_by("group", "ordinal").alias(out))
    return df.join(last, F.col(name) == F.col("_n"), "left").drop("_n")


def official_loads(df: DataFrame, kind: Column) -> DataFrame:
    """(year, country) with hewn and sawn loads of grades A and B, and the number of cells of grade C,
    whose quantities don't count. df has year, country, unit, grade and quantity."""
    cells = df.where("unit = 'loads'").withColumn("_kind", kind).where(F.col("_kind").isin("hewn", "sawn"))
    sure = F.coalesce(F.col("grade") != "C", F.lit(True))
    loads = [F.coalesce(F.sum(F.when(sure & (F.col("_kind") == k), F.col("quantity"))), F.lit(0.0)).alias(k) for k in ("hewn", "sawn")]
    return cells.groupBy("year", "country").agg(*loads, F.count_if(~sure).alias("c_cells"))


def subregion_shares(df: DataFrame, year: str, country: str, region: str, of: str) -> DataFrame:
    """By year, for one country: its arrivals, its share of all arrivals with a country, and each of
    its regions' share of its own. Years without it have no row."""
    n = df.where(F.col(country).isNotNull()).groupBy(year, country, region).agg(F.count(F.lit(1)).alias("k"))
    n = n.withColumn("all", F.sum("k").over(W.partitionBy(year))).where(F.col(country) == of)
    n = n.withColumn("n", F.sum("k").over(W.partitionBy(year)))
    return n.select(year, region, "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round(F.col("n") / F.col("all"), 6).alias("country_share"))


def profiles(df: DataFrame, labels: str, label: str, k: int, *group: str) -> DataFrame:
    """The k labels most frequent in each group, with the share of the group's arrivals that bear each."""
    size = df.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    n = df.select(*group, F.explode(labels).alias(label)).groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))
    best = top_in_group(n, k, "n", [label], *group)
    return best.join(size, list(group)).select(*group, label, "n", F.round(F.col("n") / F.col("size"), 6).alias("share"))


def leading(df: DataFrame, name: str, k: int, *group: str) -> DataFrame:
    """The k names most frequent in each group and their shares of it."""
    n = share_of(df.groupBy(*group, name).agg(F.count(F.lit(1)).alias("n")), "n", *group)
    return top_in_group(n, k, "n", [name], *group).select(*group, name, "n", F.round("share", 6).alias("share"))


def stated_shares(df: DataFrame, kinds: dict[str, Column], least: int, *group: str) -> DataFrame:
    """Of the rows for which any kind holds, the share of each kind, in groups with enough of them."""
    any_ = None
    for x in kinds.values():
        any_ = x if any_ is None else any_ | x
    n = df.where(any_).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x.cast("double")), 6).alias(k) for k, x in kinds.items()])
    return n.where(F.col("n") >= least)


def partner_years(df: DataFrame, party: str, partner: str, year: str, least: int) -> DataFrame:
    """Arrivals, years, largest partner with its share (ties by name) and sum of squared shares."""
    n = df.groupBy(party, partner).agg(F.count(F.lit(1)).alias("k"))
    years = df.groupBy(party).agg(F.countDistinct(year).alias("n_years"))
    best = F.min(F.struct((-F.col("k")).alias("m"), F.col(partner).alias("p")))
    out = n.groupBy(party).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq"), best.alias("b")).where(F.col("n") >= least)
    return out.join(years, party).select(party, "n", "n_years", F.col("b.p").alias("top"), F.round(-F.col("b.m") / F.col("n"), 6).alias("top_share"), F.round(F.col("sq") / (F.col("n") * F.col("n")), 6).alias("hhi"))


def persistence_by_size(df: DataFrame, year: str, limits: list[int], *route: str) -> DataFrame:
    """Share of active routes that are active in the next year too, by the size of the route's
    year: class i holds those with at least limits[i - 1] arrivals, class 0 the rest."""
    n = df.groupBy(*route, year).agg(F.count(F.lit(1)).alias("k"))
    calendar = df.select(year).distinct().withColumn("next", F.lead(year).over(W.orderBy(year))).where("next is not null")
    later = n.select(*route, F.col(year).alias("next"), F.lit(1).alias("again"))
    size = sum(((F.col("k") >= x).cast("int") for x in limits), F.lit(0))
    rows = n.join(calendar, year).join(later, [*route, "next"], "left").withColumn("size", size)
    return rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("again", F.lit(0)).cast("double")), 6).alias("persistence"))


def official_shares(df: DataFrame, *within: str) -> DataFrame:
    """Each country's share of quantity, over cells in loads alone, and of value, over cells with one.
    df has country, unit, quantity and value; within are the years or kinds that shares add up in."""
    n = df.groupBy(*within, "country").agg(F.coalesce(F.sum(F.when(F.col("unit") == "loads", F.col("quantity"))), F.lit(0.0)).alias("quantity"), F.coalesce(F.sum(F.when(F.col("value") != 0, F.col("value"))), F.lit(0.0)).alias("value"))
    every = W.partitionBy(*within)
    share = lambda c: F.round(F.try_divide(F.col(c), F.sum(c).over(every)), 6).alias(f"{c}_share")
    return n.select(*within, "country", share("quantity"), share("value"))
