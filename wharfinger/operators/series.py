"""Statistics of annual series and of shares."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def detrended(df: DataFrame, t: str, *values: str, part: str | None = None) -> DataFrame:
    """Residuals of each value from its least-squares line over t."""
    w = W.partitionBy(part) if part else W.partitionBy(F.lit(0))
    out = df
    for v in values:
        out = out.withColumn(f"_s{v}", F.covar_pop(v, t).over(w) / F.var_pop(t).over(w)).withColumn(v, F.col(v) - F.avg(v).over(w) - F.col(f"_s{v}") * (F.col(t) - F.avg(t).over(w))).drop(f"_s{v}")
    return out


def slopes(df: DataFrame, t: str, value: str, *keys: str, scale: float = 10.0) -> DataFrame:
    """Least-squares slope of a value, for `scale` units of t."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(value, t) * scale, 6).alias("slope"))


def pearson(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.corr(a, b), 6).alias("r"))


def beta_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): its series in 1/a at a + 20, carried down by the factors between."""
    z = a + 20
    series = F.sqrt(z) * F.exp(F.lit(-1 / 8) / z + F.lit(1 / 192) / F.pow(z, F.lit(3)) - F.lit(1 / 640) / F.pow(z, F.lit(5)) + F.lit(17 / 14336) / F.pow(z, F.lit(7)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(19)), series, lambda acc, k: acc * (a + k) / (a + k + 0.5))


def incomplete_beta(a: Column, x: Column, terms: int = 200) -> Column:
    """The regularised incomplete beta function I_x(a, 1/2), by its continued fraction, a fold over
    the number of terms (Lentz). Below the mean it is taken as it stands, above from the other side."""
    half = F.lit(0.5)
    front = F.pow(x, a) * F.sqrt(1 - x) * beta_ratio(a) / F.lit(math.sqrt(math.pi))

    def fraction(p: Column, q: Column, v: Column) -> Column:
        tiny = lambda c: F.when(F.abs(c) < 1e-300, F.lit(1e-300)).otherwise(c)

        def step(acc, m):
            k = m.cast("double")
            even = k * (q - k) * v / ((p + 2 * k - 1) * (p + 2 * k))
            odd = -(p + k) * (p + q + k) * v / ((p + 2 * k) * (p + 2 * k + 1))
            for c in (even, odd):
                d = 1 / tiny(1 + c * acc["d"])
                e = tiny(1 + c / acc["c"])
                acc = F.struct(e.alias("c"), d.alias("d"), (acc["h"] * d * e).alias("h"))
            return acc

        d0 = 1 / tiny(1 - (p + q) * v / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["h"])

    low = front * fraction(a, half, x) / a
    high = 1 - front * fraction(half, a, 1 - x) / half
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + 2.5), low).otherwise(high)


def two_sided(r: Column, n: Column) -> Column:
    """The chance of a correlation at least as far from none, by Student's t with n - 2 degrees of
    freedom: I_{1 - r^2}((n - 2) / 2, 1/2); null below three points."""
    return F.when(n > 2, incomplete_beta((n - 2).cast("double") / 2, F.greatest(1 - r * r, F.lit(0.0))))


def spearman(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Rank correlation with average ranks for ties, and its two-sided p."""
    out = df
    for c in (a, b):
        same = F.count(F.lit(1)).over(W.partitionBy(*keys, c))
        out = out.withColumn(f"_{c}", F.rank().over(W.partitionBy(*keys).orderBy(c)) + (same - 1) / 2)
    rho = out.groupBy(*keys).agg(F.corr(f"_{a}", f"_{b}").alias("_r"), F.count(F.lit(1)).alias("_n"))
    return rho.select(*keys, F.round("_r", 6).alias("rho"), F.round(two_sided(F.col("_r"), F.col("_n")), 6).alias("p"))


def between_anchors(df: DataFrame, anchors: DataFrame, t: str, value: str) -> DataFrame:
    """The value at t between the anchors beside it, flat beyond the first and last. anchors:
    a few rows (t, value)."""
    a = anchors.select(F.col(t).alias("t0"), F.col(value).alias("v0"), F.lead(t).over(W.orderBy(t)).alias("t1"), F.lead(value).over(W.orderBy(t)).alias("v1"), F.row_number().over(W.orderBy(t)).alias("k"))
    on = ((F.col(t) >= F.col("t0")) & (F.col("t1").isNull() | (F.col(t) < F.col("t1")))) | ((F.col("k") == 1) & (F.col(t) < F.col("t0")))
    level = F.when(F.col("t1").isNull() | (F.col(t) < F.col("t0")), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return df.join(F.broadcast(a), on).withColumn("level", level).drop("t0", "v0", "t1", "v1", "k")


def fill_gaps(df: DataFrame, t: str, value: str, part: str) -> DataFrame:
    """Linear interpolation of null values between their neighbours; after the last the last."""
    back, ahead = W.partitionBy(part).orderBy(t).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(part).orderBy(t).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    out = df.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(t) - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0))
    return out.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)).drop("_a", "_b")


def calibrated(df: DataFrame, year: str, share: str, weight: str) -> DataFrame:
    """Shares times weights, made to add up to one each year."""
    x = F.col(share) * F.col(weight)
    return df.withColumn("calibrated", F.round(x / F.sum(x).over(W.partitionBy(year)), 6))


def segment_errors(df: DataFrame, t: str, value: str, part: str, least: int = 3) -> DataFrame:
    """Squared error of the line through each segment i..j of a series, from running sums of
    centred values; segments have `least` points or more."""
    w = W.partitionBy(part)
    run = w.orderBy(t).rowsBetween(W.unboundedPreceding, W.currentRow)
    c = df.select(part, t, F.row_number().over(w.orderBy(t)).alias("i"), (F.col(t) - F.avg(t).over(w)).alias("x"), (F.col(value) - F.avg(value).over(w)).alias("y"))
    for name, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")), ("syy", F.col("y") * F.col("y"))):
        c = c.withColumn(name, F.sum(e).over(run))
    zero = [F.lit(0.0).alias(s) for s in ("sx", "sy", "sxx", "sxy", "syy")]
    head = c.select(part, F.lit(0).alias("i"), *zero).distinct()
    sums = c.select(part, "i", "sx", "sy", "sxx", "sxy", "syy")
    a, b = head.unionByName(sums).alias("a"), sums.alias("b")
    p = a.join(b, (F.col(f"a.{part}") == F.col(f"b.{part}")) & (F.col("b.i") - F.col("a.i") >= least))
    n = F.col("b.i") - F.col("a.i")
    d = lambda s: F.col(f"b.{s}") - F.col(f"a.{s}")
    xx, xy, yy = d("sxx") - d("sx") * d("sx") / n, d("sxy") - d("sx") * d("sy") / n, d("syy") - d("sy") * d("sy") / n
    return p.select(F.col(f"b.{part}").alias(part), (F.col("a.i") + 1).alias("i"), F.col("b.i").alias("j"), F.greatest(yy - xy * xy / xx, F.lit(0.0)).alias("ssr"))


def best_breaks(errors: DataFrame, part: str, most: int) -> DataFrame:
    """For 0 to `most` breaks the least total error over segments that cover the series, with
    the breaks (the last place before each); ties to the earliest break."""
    n = errors.groupBy(part).agg(F.max("j").alias("n"))
    cost = errors.where("i = 1").select(part, "j", F.col("ssr").alias("cost"), F.array().cast("array<int>").alias("breaks"))
    outs = []
    for k in range(most + 1):
        outs.append(cost.join(n, part).where("j = n").select(part, F.lit(k).alias("m"), "n", "cost", "breaks"))
        nxt = cost.select(part, (F.col("j") + 1).alias("i"), "cost", "breaks").join(errors.select(part, "i", "j", "ssr"), [part, "i"])
        best = F.min(F.struct((F.col("cost") + F.col("ssr")).alias("c"), F.col("i").alias("at"), F.concat("breaks", F.array((F.col("i") - 1).cast("int"))).alias("b")))
        cost = nxt.groupBy(part, "j").agg(best.alias("x")).select(part, "j", F.col("x.c").alias("cost"), F.col("x.b").alias("breaks"))
    out = outs[0]
    for x in outs[1:]:
        out = out.union(x)
    return out


def by_bic(breaks: DataFrame, part: str) -> DataFrame:
    """Of the numbers of breaks the one with the least n ln(SSR/n) + k ln n, k = 2(m+1) + m."""
    bic = F.col("n") * F.log(F.greatest("cost", F.lit(1e-12)) / F.col("n")) + (3 * F.col("m") + 2) * F.log("n")
    x = F.min(F.struct(bic.alias("bic"), "m", "cost", "breaks"))
    return breaks.groupBy(part).agg(x.alias("x")).select(part, "x.m", F.round("x.bic", 4).alias("bic"), F.round("x.cost", 4).alias("ssr"), F.array_join("x.breaks", ",").alias("breaks"))


#: Of 2**60 the share below which a draw of Poisson(1) is at most k.
POISSON = tuple(int(math.exp(-1) * sum(Fraction(1, math.factorial(i)) for i in range(k + 1)) * (1 << 60)) for k in range(19))


def drawn(*keys: Column) -> Column:
    """How often a group is in a replicate: a Poisson(1) count from 60 bits of an md5 of both, which
    another engine can repeat. All groups together come about as often as there are groups."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.size(F.filter(F.array(*[F.lit(p) for p in POISSON]), lambda p: bits >= p))


def replicates(groups: DataFrame, group: str, reps: int, *keys: str) -> DataFrame:
    """A row for each group and replicate that draws it, with _w, how often. A group's rows are made where the group
    is: nothing is joined or gathered."""
    each = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return each.withColumn("_w", drawn(F.col("rep"), *[F.col(k) for k in keys], F.col(group))).where("_w > 0")


def bootstrap(groups: DataFrame, group: str, value: str, size: str, reps: int, low: int, high: int) -> DataFrame:
    """Mean of value over size and an interval from resampling whole groups: each replicate
    draws each group a Poisson number of times, by hash; the low-th and high-th of the sorted means."""
    means = replicates(groups, group, reps).groupBy("rep").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum(F.col("_w") * F.col(size))).alias("m"))
    place = means.where("m is not null").withColumn("p", F.row_number().over(W.orderBy("m")) - 1)
    ends = place.agg(F.max(F.when(F.col("p") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("p") == high, F.col("m"))).alias("high"))
    whole = groups.agg(F.sum(value).alias("tx"), F.sum(size).alias("ts"))
    return whole.crossJoin(ends).select(F.round(F.try_divide("tx", "ts"), 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def segment_slopes(points: DataFrame, breaks: DataFrame, t: str, value: str, part: str) -> DataFrame:
    """Slope and mean of each segment between the chosen breaks (places in order, as an array)."""
    place = F.row_number().over(W.partitionBy(part).orderBy(t))
    rows = points.withColumn("_i", place).join(breaks.select(part, "breaks"), part)
    rows = rows.withColumn("segment", F.size(F.filter("breaks", lambda b: b < F.col("_i"))).cast("long"))
    return rows.groupBy(part, "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(value, t), 6).alias("slope"), F.round(F.avg(value), 6).alias("mean"))


def bootstrap_trend(groups: DataFrame, group: str, year: str, value: str, size: str, reps: int, low: int, high: int) -> DataFrame:
    """Slope of yearly shares with an interval and the chance of a fall, from resampling the
    groups of each year as bootstrap() does. Counts of groups are drawn, never rows."""
    shares = replicates(groups, group, reps, year).groupBy("rep", year).agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum(F.col("_w") * F.col(size))).alias("m"))
    slope = shares.groupBy("rep").agg(F.regr_slope("m", year).alias("b")).where("b is not null")
    placed = slope.withColumn("p", F.row_number().over(W.orderBy("b")) - 1)
    whole = groups.groupBy(year).agg(F.try_divide(F.sum(value), F.sum(size)).alias("m")).agg(F.round(F.regr_slope("m", year), 6).alias("slope"))
    ends = placed.agg(F.round(F.max(F.when(F.col("p") == low, F.col("b"))), 6).alias("low"), F.round(F.max(F.when(F.col("p") == high, F.col("b"))), 6).alias("high"), F.round(F.avg((F.col("b") < 0).cast("double")), 6).alias("falling"))
    return whole.crossJoin(ends)


def triangulate(a: DataFrame, b: DataFrame, year: str, value: str) -> DataFrame:
    """Two series side by side by year, with their difference and ratio where both are there."""
    x, y = a.select(year, F.col(value).alias("a")), b.select(year, F.col(value).alias("b"))
    return x.join(y, year, "full").withColumn("difference", F.round(F.col("a") - F.col("b"), 6)).withColumn("ratio", F.round(F.try_divide("a", "b"), 6))


def agreement(both: DataFrame) -> DataFrame:
    """Over the years that both series have: their number and the mean absolute difference."""
    return both.where("a is not null and b is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mae"))


def break_sets(errors: DataFrame, best: DataFrame, part: str, within: float = 1.01) -> DataFrame:
    """For each chosen break the places that it could have, the others held: those at which the error of
    the whole series stays within a factor of the least. best has part, n, cost and breaks."""
    ends = F.concat(F.array(F.lit(0)), F.col("breaks"), F.array(F.col("n").cast("int")))
    each = best.where(F.size("breaks") > 0).select(part, "cost", F.posexplode("breaks").alias("p", "at"), ends.alias("e"))
    each = each.select(part, "cost", (F.col("p") + 1).alias("k"), "at", F.get("e", F.col("p")).alias("lo"), F.get("e", F.col("p") + 2).alias("hi"))
    left = errors.select(part, (F.col("i") - 1).cast("int").alias("lo"), F.col("j").cast("int").alias("place"), F.col("ssr").alias("a"))
    right = errors.select(part, (F.col("i") - 1).cast("int").alias("place"), F.col("j").cast("int").alias("hi"), F.col("ssr").alias("b"))
    tried = each.join(left, [part, "lo"]).join(right, [part, "hi", "place"]).withColumn("two", F.col("a") + F.col("b"))
    chosen = F.max(F.when(F.col("place") == F.col("at"), F.col("two"))).over(W.partitionBy(part, "k"))
    whole = F.col("cost") - chosen + F.col("two")
    return tried.withColumn("ssr", whole).where(F.col("ssr") <= within * F.col("cost")).select(part, F.col("k").cast("int").alias("k"), "place", F.round("ssr", 4).alias("ssr"))


def side_by_side(named: dict[str, DataFrame], year: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Any number of series by year, and for each pair the first over the second, null where either is
    missing or the second is not above zero."""
    out = None
    for name, rows in named.items():
        x = rows.select(year, F.col(value).alias(name))
        out = x if out is None else out.join(x, year, "full")
    ratios = [F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6).alias(f"{a}_to_{b}") for a, b in pairs]
    return out.select(year, *[F.round(n, 6).alias(n) for n in named], *ratios)
