"""Licences of files: their headers against templates, then inheritance from directories.

A header is every line of a file that speaks of a licence. Headers and templates are sparse
TF-IDF vectors over words, with document frequencies counted over all headers and templates;
a file's own licence is the template of the highest cosine, if that is high enough.

Headers that are like no template as a whole are read by passages: each run of neighbouring
lines that speak of a licence or share word pairs with a licence's texts, each cue line and
sentence for itself, and the file's opening. A passage is weighed against several texts of each licence
(licence_texts.TEXTS), with document frequencies over these, so its score does not depend on
its company; lines of copyright holders don't count. The best passage decides. A directory's licence is that of the file in it with the highest cosine, its licence file.
Other files take the licence of the nearest directory above them that has one, found by
joining each directory's ancestors with the directories that have a licence.

Only built-in functions run here. Files with a cue, their lines, passages and own licences
are saved, as each is read more than once. Templates, their texts and word pairs are the broadcasts;
their number is fixed.

Defined results: null text has no header; a file without a header, or with one of which no
passage is like a text, has no licence of its own; ties go to the first template by name, then to the
least doc_id; repeated rows stay; a null path is in no directory and inherits nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wharfinger.llm.licence_texts import MARKS, TEXTS
from wharfinger.llm.scratch import Scratch

#: Short forms of licence notices, by SPDX id.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|spdx-"
LEAST_COSINE = 0.6
HOLDER = r"^(copyright|c [0-9]{4}|all rights reserved)\b(?!.*(licen[cs]e|spdx|permi))"
OPENING = 60  # words of a file's opening; the openings of texts are cut alike
GAP = 2  # the next but one line still is a neighbour


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.\-]+"), lambda w: F.length(w) > 0)


def headers(files: DataFrame) -> DataFrame:
    """doc_id, path and header: the lines with a cue, for files that have any."""
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(CUE))
    return files.where(F.col("text").rlike(CUE)).select("doc_id", "path", F.array_join(lines, "\n").alias("header"))


def own_licences(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """doc_id, path, licence and score of the files whose header is like a template."""
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = spark.createDataFrame(sorted(templates.items()), "licence string, header string")
    scratch = Scratch(spark)
    spoken = scratch.save(files.where(F.col("text").rlike(CUE)).select("doc_id", "path", "text"), "spoken")
    found = headers(spoken)
    kinds = found.select("header").groupBy("header").agg(F.count(F.lit(1)).alias("copies"))  # equal headers are weighed once
    tf = kinds.select("header", "copies", F.explode(words(F.col("header"))).alias("w")).groupBy("header", "copies", "w").agg(F.count(F.lit(1)).alias("tf"))
    ttf = known.select("licence", F.explode(words(F.col("header"))).alias("w")).groupBy("licence", "w").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.select("w", "copies").union(ttf.select("w", F.lit(1).cast("long"))).groupBy("w").agg(F.sum("copies").alias("df"))
    n = found.agg((F.count(F.lit(1)) + F.lit(len(templates))).alias("n"))
    idf = df.crossJoin(F.broadcast(n)).select("w", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    a = tf.join(idf, "w").select("header", "w", (F.col("tf") * F.col("idf")).alias("x"))
    b = ttf.join(idf, "w").select("licence", "w", (F.col("tf") * F.col("idf")).alias("y"))
    size = a.groupBy("header").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    tsize = b.groupBy("licence").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    dot = a.join(F.broadcast(b), "w").groupBy("header", "licence").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    cosine = dot.join(size, "header").join(F.broadcast(tsize), "licence").select("header", "licence", F.round(F.col("d") / (F.col("nx") * F.col("ny")), 6).alias("score"))
    best = cosine.groupBy("header").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("m")).select("header", F.col("m.licence").alias("licence"), (-F.col("m.s")).alias("score"))
    as_whole = found.join(best.where(F.col("score") >= least), "header").select("doc_id", "path", "licence", "score")
    rest = spoken.withColumn("k", F.sha2("text", 256))
    rest = rest.join(as_whole.select(F.col("doc_id").alias("_d"), F.col("path").alias("_p")).distinct(), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("path").eqNullSafe(F.col("_p")), "left_anti")
    rest = scratch.save(rest, "rest")
    texts = {k: [v] for k, v in templates.items()} if templates is not TEMPLATES else TEXTS
    found_in = by_passages(rest.select("k", "text").dropDuplicates(["k"]), texts, MARKS if texts is TEXTS else {}, least, scratch)
    return scratch.save(as_whole.union(rest.join(found_in, "k").select("doc_id", "path", "licence", "score")), "own")


def plain(text: str) -> list[str]:
    """bare_words() of a template."""
    return [w for w in (x.strip(".-") for x in re.split(r"[^a-z0-9.\-]+", text.lower())) if w]


def bare_words(text: Column) -> Column:
    """Words without the stops and dashes at their ends."""
    return F.filter(F.transform(words(text), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")), lambda w: F.length(w) > 0)


def text_vectors(texts: dict[str, list[str]]) -> tuple[dict[str, float], list[tuple[str, int, str, float]], float]:
    """Word weights, unit vectors (licence, text, word, weight), and the weight of other words."""
    bags = [(k, Counter(w)) for k, each in sorted(texts.items()) for t in each for w in ([plain(t)] if len(plain(t)) <= OPENING else [plain(t), plain(t)[:OPENING]])]
    df = Counter(w for _, bag in bags for w in bag)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = []
    for i, (k, bag) in enumerate(bags):
        size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        vectors += [(k, i, w, n * idf[w] / size) for w, n in bag.items()]
    return idf, vectors, math.log(1 + len(bags)) + 1


def by_passages(kinds: DataFrame, texts: dict[str, list[str]], marks: dict[str, str], least: float, scratch: Scratch) -> DataFrame:
    """k, licence and score of the rows (k, text) with a passage like one of the texts."""
    spark = kinds.sparkSession
    idf, vectors, other = text_vectors(texts)
    pairs = sorted({f"{a} {b}" for each in texts.values() for t in each for a, b in zip(plain(t), plain(t)[1:])})
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "w string, idf double"))
    known = F.broadcast(spark.createDataFrame(vectors, "licence string, t int, w string, y double"))
    pairs = F.broadcast(spark.createDataFrame([(p,) for p in pairs], "pair string").withColumn("hit", F.lit(1)))
    must = F.broadcast(spark.createDataFrame([(k, marks.get(k, "")) for k in sorted(texts)], "licence string, mark string"))
    line = F.transform(F.split("text", r"\r?\n"), lambda x: F.struct(x.alias("raw"), F.array_join(bare_words(x), " ").alias("s")))
    counted = F.filter(line, lambda x: (x["s"] != "") & ~x["s"].rlike(HOLDER))
    lines = kinds.select("k", F.posexplode(counted).alias("pos", "x")).select("k", "pos", "x.raw", "x.s", F.col("x.raw").rlike(CUE).alias("cue"))
    lines = scratch.save(lines, "lines")
    w = F.split("s", " ")
    two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    seen = lines.where(F.size(w) > 1).select("k", "pos", F.explode(two).alias("pair")).join(pairs, "pair", "left")
    like = seen.groupBy("k", "pos").agg((F.count("hit") * 2 >= F.count(F.lit(1))).alias("like"))
    near = lines.join(like, ["k", "pos"], "left").where(F.col("cue") | F.col("like"))
    ordered = W.partitionBy("k").orderBy("pos")
    near = near.withColumn("new", (F.col("pos") - F.lag("pos").over(ordered) > GAP).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(ordered))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ")
    runs = near.groupBy("k", "run").agg(in_order.alias("p"))
    sentences = F.transform(F.split("raw", r"[.;!?]\s+"), lambda x: F.array_join(bare_words(x), " "))
    alone = lines.where("cue").select("k", F.explode(F.array_union(F.array("s"), sentences)).alias("p"))
    opening = lines.where(F.col("pos") < OPENING).groupBy("k").agg(F.array_join(F.slice(F.split(in_order, " "), 1, OPENING), " ").alias("p"))
    passages = scratch.save(runs.select("k", "p").union(alone).union(opening).where("p <> ''").distinct(), "passages")
    tf = passages.select("p").distinct().select("p", F.explode(F.split("p", " ")).alias("w")).groupBy("p", "w").agg(F.count(F.lit(1)).alias("tf"))
    x = tf.join(weights, "w", "left").select("p", "w", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("x"))
    size = x.groupBy("p").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    dot = x.join(known, "w").groupBy("p", "licence", "t").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    cosine = dot.join(size, "p").select("p", "licence", F.round(F.col("d") / F.col("nx"), 6).alias("score")).where(F.col("score") >= least)
    cosine = cosine.join(must, "licence").where(F.expr("p rlike mark"))
    best = passages.join(cosine, "p").groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("m"))
    return best.select("k", F.col("m.licence").alias("licence"), (-F.col("m.s")).alias("score"))


def directory(path: Column) -> Column:
    """The path without its last part; null if there is no part above."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path.contains("/"), cut)


def resolve(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """doc_id, path, own (its licence by its header), score, licence and origin (the
    directory it comes from, null for a licence of its own) for each file."""
    own = own_licences(files, templates, least)
    given = own.withColumn("dir", directory(F.col("path"))).where("dir is not null")
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id", "licence")).alias("m")).select("dir", F.col("m.licence").alias("dir_licence"))
    dirs = files.select(directory(F.col("path")).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))).alias("a"))
    nearest = above.join(given.withColumnRenamed("dir", "up"), above["a.up"] == F.col("up")).groupBy("dir").agg(F.max(F.struct("a.depth", "up", "dir_licence")).alias("m"))
    nearest = nearest.select("dir", F.col("m.up").alias("origin"), F.col("m.dir_licence").alias("dir_licence"))
    rows = files.select("doc_id", "path", directory(F.col("path")).alias("dir"))
    mine = own.select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"), F.col("licence").alias("own"), "score").dropDuplicates(["_d", "_p"])
    rows = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("path").eqNullSafe(F.col("_p")), "left").join(nearest, "dir", "left")
    return rows.select("doc_id", "path", "own", "score", F.coalesce("own", "dir_licence").alias("licence"), F.when(F.col("own").isNull(), F.col("origin")).alias("origin"))


def as_files(docs: DataFrame) -> DataFrame:
    """documents as files of a tree: source, language, then folders of 4096, 256 and 16 ids."""
    steps = [F.format_string("%d", F.floor(F.col("doc_id") / F.lit(n))) for n in (4096, 256, 16)]
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), *steps, F.col("doc_id").cast("string")).alias("path"))
