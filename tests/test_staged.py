"""Stages that are killed and run again: the same rows, no stage twice, errors carried to the end."""

import pytest
from pyspark.sql import functions as F

from wharfinger.plans import arrivals
from wharfinger.plans.staged import Staged, failed


def test_stages_resume(spark, tmp_path):
    calls = []

    def stage(name, f, dies=()):
        def work(df):
            calls.append((name, df.select("source_file").distinct().count()))
            if name in dies:
                raise RuntimeError("killed")
            return f(df)

        return name, work

    docs = [("a", "success", None), ("b", "failed", "no text"), ("c", "success", None), ("d", None, None)]
    lines = [(f, i) for f in "abcd" for i in range(3)]
    documents, rows = spark.createDataFrame(docs, "source_file string, status string, error string"), spark.createDataFrame(lines, "source_file string, n int")
    steps = lambda dies=(): [stage("read", lambda df: df.withColumn("m", F.col("n") * 2), dies), stage("kept", lambda df: df.where("m > 0 and source_file <> 'c'"), dies), stage("named", lambda df: df.withColumn("k", F.lit(1)), dies)]
    staged = Staged(spark, str(tmp_path / "out"))
    with pytest.raises(RuntimeError):
        staged.run(documents, rows, steps(dies=("kept",)))
    assert calls == [("read", 2), ("kept", 2)] and not staged.batches("kept")
    calls.clear()
    done, out = staged.run(documents, rows, steps())
    assert calls == [("kept", 2), ("named", 1)]  # reading was done before
    want = {("a", 1, 2, 1), ("a", 2, 4, 1)}
    assert {tuple(r) for r in out.collect()} == want
    assert {tuple(r) for r in failed(done).collect()} == {("b", "failed", "no text"), ("d", None, None)}
    calls.clear()
    staged.run(documents, rows, steps())
    assert not calls
    more = documents.union(spark.createDataFrame([("e", "success", None)], documents.schema)), rows.union(spark.createDataFrame([("e", 5)], rows.schema))
    done, out = staged.run(*more, steps())
    assert calls == [("read", 1), ("kept", 1), ("named", 1)] and {tuple(r) for r in out.collect()} == want | {("e", 5, 10, 1)}
    assert done.count() == 5


PAGES = {
    "18850103J_p001": [("LONDON", "PORT_HEADER"), ("Dec. 28 Vesta-Riga-1,000 deals, 50 battens-", "SHIPPING_DATA"), ("and sleepers-Price & Co.", "SHIPPING_DATA"), ("29 Presto (s)-Soderhamn-11 fms. firewood-Ditto", "SHIPPING_DATA")],
    "18850103J_p002": [("LONDON", "PORT_HEADER"), ("29 Presto (s)-Soderhamn-11 fms. firewood-Ditto", "SHIPPING_DATA"), ("HULL", "PORT_HEADER"), ("30 Anna-Memel-40 lds. oak-PRICE & CO", "SHIPPING_DATA"), ("30 Ida-Riga-40 lds. oak-PRICE & CO", "SHIPPING_DATA")],
    "18850110J_p001": [("HULL", "PORT_HEADER"), ("Jan. 3 Anna-Memel-40 lds. oak-PRICE & CO", "SHIPPING_DATA"), ("noise", "OTHER")],
}


def test_arrivals_page_by_page(spark, tmp_path, monkeypatch):
    """Pages that come one after the other, with a run that dies between, give what all at once give."""
    docs = [(f, "success", None) for f in PAGES] + [("18850117J_p001", "error", "no text")]
    lines = [(f, i + 1, t, k) for f, page in PAGES.items() for i, (t, k) in enumerate(page)] + [("18850117J_p001", 1, "Ada-Riga-deals-Order", "SHIPPING_DATA")]
    known = [("RIGA", "Riga", 0)], [("order",)], [("Memel", 55.7, 21.1, 0), ("London", 51.5, -0.1, 1), ("Hull", 53.7, -0.3, 2)]
    mapping, errors, coords = (spark.createDataFrame(v, f"{c}") for v, c in zip(known, ("variant string, canonical string, ordinal int", "name string", "name string, lat double, lon double, ordinal int"), strict=True))
    frame = lambda rows, c: spark.createDataFrame(rows, c)
    D, L = "source_file string, status string, error string", "source_file string, line_no int, text string, line_type string"

    def run(path, upto):
        return arrivals.run(frame(docs[:upto], D), frame(lines, L), str(tmp_path / path), mapping, errors, coords)

    def seen(out):
        return sorted((r["source_file"], r["line_no"], r["date"], r["ship"], r["origin_normalized"], r["dest"], r["firm"], r["port_status"], r["cargo"][0]["forms"]) for r in out.collect())

    _, once = run("once", 4)
    want = seen(once)
    assert [w[:2] for w in want] == [("18850103J_p001", 2), ("18850103J_p001", 4), ("18850103J_p002", 4), ("18850103J_p002", 5), ("18850110J_p001", 2)]
    assert {w[6] for w in want} == {"PRICE & CO"}  # the form that is found most often, known only from all pages
    _, first = run("parts", 1)
    assert {w[6] for w in seen(first)} == {"Price & Co."}
    with monkeypatch.context() as m:
        m.setattr(arrivals, "enrich_firms", lambda rows, big: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run("parts", 2)
    with monkeypatch.context() as m:
        m.setattr(arrivals, "parse_labelled", lambda lines, ports: 1 / 0)  # the pages are read already
        run("parts", 2)
    done, out = run("parts", 4)
    assert seen(out) == want
    assert [tuple(r) for r in failed(done).collect()] == [("18850117J_p001", "error", "no text")] and done.count() == 4
