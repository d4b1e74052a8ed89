"""Queries that have to see whole tables and whole texts."""

import difflib
import itertools
import math

import numpy as np
from conftest import SF

from wharfinger import catalog
from wharfinger.operators import names
from wharfinger.plans import more, reports, statistics


def test_mojibake_of_whole_texts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = catalog.QUERIES["mojibake"](spark, SF).collect()
    assert len(got) == len(docs) and max(len(t or "") for t in docs.values()) > 200
    for r in got:
        t = docs[r["doc_id"]]
        assert r["text"] == t and r["spoilt"] == (t if t is None else t.encode().decode("latin-1"))


def test_merges_of_all_suppliers(spark):
    """Each name and its further name as they stand, in capitals and in small letters."""
    n = spark.read.parquet(f"{SF}/supplier.parquet").select("s_name").distinct().count()
    for name in ("authority_merge_all", "coordinate_merge_all"):
        assert catalog.QUERIES[name](spark, SF).count() == 3 * 2 * n


def test_suggestions_like_plain_difflib(spark):
    known = ["Bordeaux", "Riga", "Memel", "Gothenburg", "Nantes", "St. John"]
    rows = [("Dordeaux", 12), ("bordeaux", 40), ("Bordeaux", 99), ("Gotenburg", 10), ("othenburg", 11), ("Nante", 9), ("Mantes", 30), ("Xt. John", 15), ("Odd", 50), ("", 20)]
    want = set()
    for name, n in rows:
        if n >= 10 and name.lower() not in {k.lower() for k in known}:
            score, best = min((-difflib.SequenceMatcher(None, name.lower(), k.lower()).ratio(), k) for k in known)
            if -score >= 0.85:
                want.add((name, n, best, round(-score, 6)))
    got = names.suggestions(spark.createDataFrame(rows, "port string, n long"), "port", spark.createDataFrame([(k,) for k in known], "name string"))
    assert {tuple(r) for r in got.collect()} == want and ("Dordeaux", 12, "Bordeaux", 0.875) in want
    settled = {v.lower() for v in ("NATION_0", "nation_1", "Nation 2.", "NATION_2", "NATION_3", "nation_4", "NATION_5", "nation_6", "NATION_8")}
    assert not settled & {r["name"].lower() for r in catalog.QUERIES["port_suggestions"](spark, SF).collect()}


def test_up_to_four_breaks(spark, monkeypatch):
    """The queries on a series with three breaks, against all choices of breaks."""
    level = np.repeat([10.0, 60.0, 20.0, 90.0], 9)
    v = level + np.random.default_rng(1).normal(0, 1, len(level))
    n = len(v)
    ssr = {}
    for i in range(n):
        for j in range(i + 8, n + 1):
            t = np.arange(i, j)
            ssr[i, j] = float(((v[i:j] - np.polyval(np.polyfit(t, v[i:j], 1), t)) ** 2).sum())
    tries = []
    for m in range(5):
        for at in itertools.combinations(range(1, n), m):
            ends = (0, *at, n)
            if all(e in ssr for e in zip(ends, ends[1:])):
                cost = sum(ssr[e] for e in zip(ends, ends[1:]))
                tries.append((n * np.log(cost / n) + (3 * m + 2) * np.log(n), m, ",".join(map(str, at))))
    bic, m, at = min(tries)
    series = spark.createDataFrame([("X", t + 1, float(x)) for t, x in enumerate(v)], "origin_region string, t long, v double")
    monkeypatch.setattr(statistics, "monthly", lambda spark, d: series)
    monkeypatch.setattr(more, "monthly", lambda spark, d: series)
    monkeypatch.setattr(reports, "monthly", lambda spark, d: series)
    [r] = catalog.QUERIES["best_break_bic_4"](spark, SF).collect()
    assert m == 3 and (r["m"], r["breaks"]) == (m, at) and abs(r["bic"] - bic) < 1e-3
    ends = [0, *map(int, at.split(",")), n]
    got = sorted((r["segment"], r["n"], r["slope"]) for r in catalog.QUERIES["segment_slopes_4"](spark, SF).collect())
    assert [g[:2] for g in got] == [(k, b - a) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
    assert all(abs(g[2] - np.polyfit(np.arange(a, b), v[a:b], 1)[0]) < 1e-5 for g, a, b in zip(got, ends, ends[1:]))
    want, inner = set(), ends[1:-1]
    cost = sum(ssr[e] for e in zip(ends, ends[1:]))
    for k in range(m):
        for place in range(1, n):
            at = [0, *inner[:k], place, *inner[k + 1 :], n]
            if all(e in ssr for e in zip(at, at[1:])) and sum(ssr[e] for e in zip(at, at[1:])) <= 1.01 * cost:
                want.add((k + 1, place))
    assert {(r["k"], r["place"]) for r in catalog.QUERIES["break_confidence_4"](spark, SF).collect()} == want and len(want) >= m


def test_multinomial_null_by_the_exact_distribution(spark, monkeypatch):
    """Mean and tail of the largest share of 6 and 7 draws against all outcomes of the multinomial, within five standard errors of 2000 draws."""
    rows = [("Hull", o) for o in "aaabbc"] + [("Leith", o) for o in "aaaaaaa"] + [("Goole", "c")]
    monkeypatch.setattr(statistics, "arrivals", lambda spark, d: spark.createDataFrame(rows, "dest string, origin string"))
    got = {r["dest"]: r for r in statistics.multinomial_null(spark, SF).collect()}
    pool = [sum(o == x for _, o in rows) / len(rows) for x in "abc"]
    assert set(got) == {"Hull", "Leith", "Goole"}
    for dest, r in got.items():
        mine = [o for d, o in rows if d == dest]
        n, top = len(mine), max(mine.count(o) for o in set(mine))
        chance = np.zeros(n + 1)
        for counts in itertools.product(range(n + 1), repeat=3):
            if sum(counts) == n:
                ways = math.factorial(n) / math.prod(map(math.factorial, counts))
                chance[max(counts)] += ways * math.prod(p**k for p, k in zip(pool, counts, strict=True))
        share = np.arange(n + 1) / n
        mean, tail = float(chance @ share), float(chance[top:].sum())
        off = 5 * math.sqrt(float(chance @ share**2) - mean**2) / math.sqrt(2000)
        assert r["n"] == n and r["top_share"] == top / n
        assert abs(r["null_mean"] - mean) <= off + 1e-9 and abs(r["p"] - tail) <= 5 * math.sqrt(tail * (1 - tail) / 2000) + 1e-9
