"""Toxicity by a linear classifier over character n-grams.

A feature is an n-gram of the characters (code points) of a lower-cased word between spaces, hashed to one of 2**BITS
buckets; its value is the number of a text's distinct words that hold it. Values are scaled
by the naive Bayes log-count ratio of the feature (its smoothed share of toxic against other
texts), then weighed by a regularised logistic fit. Since a score is a sum over words, each
distinct word of a batch is weighed once.

The model is fitted in one task on at most SAMPLE_ROWS labelled documents of each class, those
with the least hash of their doc_id, as many of them as SAMPLE_BYTES of text hold, weighted so
that the classes keep their shares. Both bounds are parameters.

Defined results: null text is the empty text, whose score comes from the intercept alone;
without labelled rows of both classes every score is their smoothed share; a doc_id with
several labels counts as toxic if one of them does; null labels are none; rows that share a
doc_id are scored each for itself; a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wharfinger.llm.words import SLICE_BYTES, U64, mix, pair, slices, split_words, spread, texts_of, window_starts, windows

BITS, SHORTEST, LONGEST = 18, 3, 5
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16 << 20
ALPHA, L2, STEPS = 1.0, 1.0, 60


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words one after the other, how many each word has)."""
    raw = [f" {w} " for w in words.to_numpy(zero_copy_only=False)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    chars = mix(np.frombuffer("".join(raw).encode("utf-32-le"), np.uint32).astype(U64) + U64(1))
    features, owner = [], []
    for n in range(SHORTEST, LONGEST + 1):
        at = window_starts(offsets, n)
        features.append((pair(windows(chars, n)[at], np.full(len(at), n, U64)) >> U64(64 - BITS)).astype(np.int32))
        owner.append(np.searchsorted(offsets, at, "right") - 1)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(features)[order], np.bincount(owner, minlength=len(words))


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, vocabulary) of each text's distinct lower-cased words."""
    w = split_words(texts)
    lower = pc.utf8_lower(w.vocab).dictionary_encode()
    size = max(1, len(lower.dictionary))
    code = lower.indices.to_numpy()[w.codes] if len(w.codes) else np.zeros(0, np.int64)
    key = np.sort(w.doc_of() * size + code)
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    return key % size, np.searchsorted(key, np.arange(len(texts) + 1) * size), lower.dictionary


def text_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the features of each text."""
    codes, offsets, vocab = distinct_words(texts)
    features, n = word_grams(vocab)
    starts = np.cumsum(n) - n
    row = np.repeat(np.repeat(np.arange(len(texts)), np.diff(offsets)), n[codes])
    key, value = np.unique((row << BITS) | features[spread(starts[codes], n[codes])], return_counts=True)
    return (key >> BITS).astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32), value.astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = [self._score(texts.slice(a, b - a)) for a, b in slices(texts, SLICE_BYTES)]
        return np.concatenate([np.zeros(0), *parts])

    def _score(self, texts: pa.Array) -> np.ndarray:
        codes, offsets, vocab = distinct_words(texts)
        features, n = word_grams(vocab)
        total = np.concatenate(([0.0], np.cumsum(self.weights[features], dtype=np.float64)))
        ends = np.cumsum(n)
        word = total[ends] - total[ends - n] if len(n) else np.zeros(0)
        run = np.concatenate(([0.0], np.cumsum(word[codes])))
        z = run[offsets[1:]] - run[offsets[:-1]] + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def least(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """The minimum of a smooth function by L-BFGS with backtracking."""
    past: list[tuple[np.ndarray, np.ndarray]] = []
    value, slope = f(x)
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            kept.append(a := (s @ way) / (y @ s))
            way -= a * y
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way += s * (a - (y @ way) / (y @ s))
        size = 1.0 if past else 1 / max(1e-9, np.abs(slope).sum())
        for _ in range(30):
            value2, slope2 = f(x - size * way)
            if value2 <= value - 1e-4 * size * (slope @ way):
                break
            size /= 2
        s, y = -size * way, slope2 - slope
        if y @ s > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, done, value, slope = x + s, value - value2 < 1e-7, value2, slope2
        if done:
            break
    return x


def fit(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray) -> Model:
    """The model of labelled texts; weight is what each of them stands for."""
    yes, no = weight[toxic].sum(), weight[~toxic].sum()
    base = float(np.log((yes + 1) / (no + 1)))
    if not toxic.any() or toxic.all():
        return Model(np.zeros(1 << BITS), base)
    parts = [(a, *text_grams(texts.slice(a, b - a))) for a, b in slices(texts, SLICE_BYTES)]
    row = np.concatenate([a + r for a, r, _, _ in parts]).astype(np.int32)
    feature, value = (np.concatenate([x[i] for x in parts]) for i in (2, 3))
    size = 1 << BITS
    p = np.bincount(feature, weight[row] * toxic[row], size) + ALPHA
    q = np.bincount(feature, weight[row] * ~toxic[row], size) + ALPHA
    ratio = np.log(p / (yes + 2 * ALPHA)) - np.log(q / (no + 2 * ALPHA))
    x, share = value * ratio[feature], weight / weight.sum()

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = theta[:-1], theta[-1]
        z = np.bincount(row, x * w[feature], len(texts)) + b
        miss = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic)
        slope = np.bincount(feature, x * miss[row], size) + L2 * w / len(texts)
        value = share @ (np.logaddexp(0, z) - toxic * z) + L2 * (w @ w) / 2 / len(texts)
        return float(value), np.append(slope, miss.sum())

    theta = least(loss, np.append(np.zeros(size), base), STEPS)
    return Model(theta[:-1] * ratio, float(theta[-1]))


def held_out(doc_id: Column) -> Column:
    """True for a third of all documents: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, toxic and weight of the rows that the model is fitted on."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.xxhash64("doc_id")
    picks = [known.where(F.col("toxic") == F.lit(c)).orderBy(draw, "doc_id").limit(sample_rows) for c in (False, True)]
    picked = picks[0].union(picks[1]).withColumnsRenamed({"doc_id": "_id"})
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).drop("_id")  # two times sample_rows at most
    order = W.partitionBy("toxic").orderBy(draw, "doc_id", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_bytes", F.sum(F.octet_length("text")).over(order)).where(F.col("_bytes") <= sample_bytes).drop("_bytes")
    share = F.when(F.col("toxic"), totals.get(True, 0)).otherwise(totals.get(False, 0)) / F.count(F.lit(1)).over(W.partitionBy("toxic"))
    return rows.withColumn("weight", share.cast("double"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the labelled documents that aren't held out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if len(b)]:
            t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
            m = fit(texts_of(t["text"].combine_chunks()), t["toxic"].to_numpy(), t["weight"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([m.intercept])], ["weights", "intercept"])

    found = sample(docs, labels, sample_rows, sample_bytes).repartition(1).mapInArrow(work, "weights binary, intercept double").collect()
    if not found:
        return fit(pa.array([], pa.large_string()), np.zeros(0, bool), np.zeros(0))
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["intercept"])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row. The model has 2**BITS weights."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sent.value.score(texts_of(b["text"])))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
