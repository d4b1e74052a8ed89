"""The similarity join against plain difflib, p-values against integration, species in their order, hashed draws."""

import difflib
import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wharfinger.functions import rules
from wharfinger.operators import names, series


def some_names(n, seed):
    rng = random.Random(seed)
    parts = ["ber", "gen", "riga", "mem", "hol", "stad", "sund", "vall", "port", "saint ", "new ", "kron", "hälsing", "borg", "ö", "haven", "qu", "x", "tt", "amer"]
    return sorted({"".join(rng.choice(parts) for _ in range(rng.randint(2, 5))).title() for _ in range(3 * n)})[:n]


def misread(name, rng):
    i = rng.randrange(len(name))
    return rng.choice([name[:i] + name[i + 1 :], name[:i] + rng.choice("aeioust") + name[i + 1 :], name[:i] + rng.choice("aeioust") + name[i:], name.upper()])


@pytest.mark.parametrize("ratio", [0.85, 0.9])
def test_alike_is_all_pairs(spark, ratio):
    """2,000 names, half of them misread, against 400 known ones: the pairs that reach the ratio are those
    of all 800,000, and few more are compared."""
    rng = random.Random(7)
    known = some_names(400, 1)
    left = sorted({misread(rng.choice(known), rng) for _ in range(1200)} | set(some_names(1100, 2)))[:2000] + ["", "a"]
    df = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    pairs = names.alike(df(left), df([*known, ""]), ratio)
    met = pairs.cache()
    got = {(r["a"], r["b"]): round(r["ratio"], 9) for r in names.with_ratio(met, ratio).collect()}
    want = {}
    for b in known:
        m = difflib.SequenceMatcher(None, "", b.lower())
        for a in left:
            m.set_seq1(a.lower())
            if m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio:
                want[a, b] = round(m.ratio(), 9)
    assert got == want and len(want) > 800
    n = met.count()
    assert n == met.distinct().count() and n < len(left) * len(known) / 40, n


def test_fuzzy_merge_is_all_pairs(spark):
    rng = random.Random(3)
    big = [n for n in some_names(300, 5) if len(n) > 6]
    rows = [(n, 100 + i) for i, n in enumerate(big)] + [(n, 5) for n in {misread(b, rng) for b in big for _ in range(3)} - set(big)]
    want = {}
    for a, n in rows:
        if n < 100 and len(a) >= 8:
            tried = [(-difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), b) for b in big if b[0].lower() == a[0].lower() and abs(len(a) - len(b)) <= max(3, len(a) // 4)]
            if tried and -min(tried)[0] >= 0.9:
                want[a] = (min(tried)[1], round(-min(tried)[0], 6))
    got = {r["canonical"]: (r["target"], r["ratio"]) for r in names.fuzzy_merge(spark.createDataFrame(rows, "canonical string, n long")).collect()}
    assert got == want and len(want) > 100


def upper_tail(r, n, panels=20000):
    """Of Student's t, by integrating powers of the cosine."""
    def area(a):
        h = (math.pi / 2 - a) / panels
        return h / 3 * math.fsum((1 if i in (0, panels) else 4 if i % 2 else 2) * math.cos(a + h * i) ** (n - 3) for i in range(panels + 1))

    return area(math.asin(abs(r))) / area(0.0)


def test_p_values(spark):
    cases = [(r, n) for n in (3, 4, 5, 8, 13, 30, 101, 1000) for r in (-0.99, -0.5, -0.02, 0.0, 0.1, 0.4, 0.8, 0.999)] + [(1.0, 9), (-1.0, 4), (0.3, 2)]
    df = spark.createDataFrame(cases, "r double, n long")
    for row in df.select("r", "n", series.two_sided(F.col("r"), F.col("n")).alias("p")).collect():
        if row["n"] < 3:
            assert row["p"] is None
        elif abs(row["r"]) == 1:
            assert row["p"] == 0
        else:
            assert abs(row["p"] - upper_tail(row["r"], row["n"])) < 1e-9, row
    big = spark.createDataFrame([(0.001, 10**7)], "r double, n long").select(series.two_sided(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert abs(big - math.erfc(0.001 * math.sqrt(1e7) / math.sqrt(2))) < 1e-6


def test_species_in_order(spark):
    want = {"firwood oak": ["oak", "fir"], "fir firwood": ["fir", "fir"], "rose wood": [], "rosewood": ["rosewood"], "box wood": ["boxwood"], "pitch pine": ["pitch pine"], "pine": ["pine"]}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", rules.labels(F.col("t"), rules.species_rules()).alias("s")).collect()} == want
    assert len(rules.SPECIES) == 36


def test_square_or_sawn(spark):
    cargo = "array<struct<forms:array<string>,species:array<string>>>"
    rows = [([(["deals"], []), (["timber"], [])],), ([(["timber"], [])],), ([([], ["oak"])],), ([(["staves"], ["birch"])],), ([],)]
    got = spark.createDataFrame(rows, f"c {cargo}").select(rules.square_or_sawn(F.col("c"), ("timber", "squares"), ("deals",), ("oak",)).alias("k")).collect()
    assert [r["k"] for r in got] == ["sawn", "square", "hardwood", "other", "other"]


def test_draws(spark):
    """Counts by hash: those of a plain loop, Poisson in their shares, and the interval of plain code."""
    groups = [(f"g{i:03d}", i % 7, 10 + i % 5) for i in range(60)]
    df = spark.createDataFrame(groups, "g string, x long, n long")
    rows = series.replicates(df, "g", 300).collect()
    limits, p, total = [], math.exp(-1), 0.0
    for k in range(20):
        total += p
        limits.append(total)
        p /= k + 1
    draw = lambda rep, g: sum(int(hashlib.md5(f"{rep}:{g}".encode()).hexdigest()[:15], 16) / 2**60 >= x for x in limits)
    want = {(rep, g): draw(rep, g) for rep in range(300) for g, _, _ in groups}
    assert {(r["rep"], r["g"]): r["_w"] for r in rows} == {k: v for k, v in want.items() if v}
    shares = Counter(want.values())
    assert abs(shares[0] / len(want) - math.exp(-1)) < 0.01 and abs(shares[2] / len(want) - math.exp(-1) / 2) < 0.01
    means = sorted(sum(want[rep, g] * x for g, x, _ in groups) / sum(want[rep, g] * n for g, _, n in groups) for rep in range(300))
    got = series.bootstrap(df, "g", "x", "n", 300, 7, 292).first()
    assert (got["low"], got["high"]) == (round(means[7], 6), round(means[292], 6)) and got["low"] < got["mean"] < got["high"]
