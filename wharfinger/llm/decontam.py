"""Benchmark decontamination with suffix arrays over the training text.

A task turns its batch of documents (a shard) into word codes, sorts the suffixes into a
suffix array and looks every benchmark suffix up by binary search, word by word. The
interval that is left after a window's words holds all places of the window; going on until
it is empty gives the longest match. Suffixes whose next words cannot all be benchmark
words in benchmark order are left out of the array first: they match no window.

Documents are not shuffled. The benchmark is handed out in blocks of about BLOCK_BYTES of text,
one pass of the documents for each; the driver and a task hold one block at a time. With
several blocks what a pass finds is saved, and a document's spans are put together at the end.

Defined results: null or wordless text has no words and no hits; an item without words is
in nothing; repeated rows are judged each for itself; items that share an id count once; a null
item_id counts as the empty string; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfinger.llm.scratch import Scratch
from wharfinger.llm.words import Words, covered, pair, sliced, split_words, spread, sums, texts_of

BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
SPANS = "array<struct<doc_word:int,n_words:int,item_id:string,item_word:int>>"

_BYTES = np.full(256, 0x20, np.uint8)  # what is no word, by byte
_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
_BYTES[0x80:] = np.arange(0x80, 0x100)


def lower_words(texts: pa.Array) -> Words:
    """Words are runs of a-z, 0-9 and everything outside ASCII, after A-Z became a-z."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    plain = _BYTES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)
    return split_words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)))


@dataclass
class Benchmark:
    """A block of items as word codes from 1 on, each item followed by a 0."""

    vocab: pa.Array
    codes: np.ndarray
    item: np.ndarray
    ids: list[str]
    starts: np.ndarray
    sizes: np.ndarray
    query: np.ndarray
    window: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: pa.Array, n: int) -> Benchmark:
        w = lower_words(texts)
        codes, at = separated(w.codes + 1, w)
        counts = w.counts
        starts = w.offsets[:-1] + np.arange(len(counts))
        many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        query = spread(starts, many)
        pairs = np.zeros(1 << FILTER_BITS, bool)
        pairs[bigram(codes[:-1], codes[1:])] = True
        item = np.full(len(codes), -1)
        item[at] = w.doc_of()
        return cls(w.vocab, codes, item, ["" if i is None else str(i) for i in ids], starts, counts, query, np.minimum(counts, n)[item[query]], pairs)


def separated(codes: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The codes with a 0 after each document, and where each code went."""
    at = np.arange(len(codes)) + w.doc_of()
    out = np.zeros(len(codes) + len(w.offsets), np.int64)
    out[at] = codes
    return out, at


def bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (pair(a.astype(np.uint64), b.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def suffixes(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of the suffixes at the given places, in order of their first `depth`
    codes: sorted by a few codes, then only what is still tied by the next few."""
    bits = max(1, int(codes.max()).bit_length()) if len(codes) else 1
    step = max(1, 63 // bits)
    last = len(codes) - 1
    order, group, d = at.copy(), np.zeros(len(at), np.int64), 0
    tied = np.arange(len(at))
    while len(tied) and d < depth:
        key = np.zeros(len(tied), np.int64)
        for k in range(step):
            key = (key << bits) | codes[np.minimum(order[tied] + d + k, last)]
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        key, g = key[by], group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new & np.append(new[1:], True)
        ended = (key & ((1 << bits) - 1)) == 0
        tied = tied[~alone & ~ended]
        d += step
    return order


def narrow(codes: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each [lo, hi) of the array, the suffixes whose code at place k is wanted."""
    last = len(codes) - 1
    ends = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while len(live := np.flatnonzero(a < b)):
            mid = (a[live] + b[live]) // 2
            c = codes[np.minimum(array[mid] + k, last)]
            below = c <= want[live] if right else c < want[live]
            a[live] = np.where(below, mid + 1, a[live])
            b[live] = np.where(below, b[live], mid)
        ends.append(a)
    return ends[0], ends[1]


@dataclass
class Found:
    """Places of windows: the n words at `word` of document `doc` are those at `item_word` of an item."""

    doc: np.ndarray
    word: np.ndarray
    n: np.ndarray
    item: np.ndarray
    item_word: np.ndarray


def search(w: Words, bench: Benchmark) -> Found:
    """All places of the block's windows in the batch, each with the length of the longest
    match that begins there."""
    known = pc.index_in(w.vocab, value_set=bench.vocab)
    known = pc.fill_null(pc.add(known, 1), 0).to_numpy().astype(np.int64) if len(w.vocab) else np.zeros(0, np.int64)
    codes, at = separated(known[w.codes], w)
    size = int(bench.window.min()) if len(bench.window) else 0
    if not size or not len(at):
        return Found(*[np.zeros(0, np.int64)] * 5)
    good = np.zeros(len(codes), bool)
    both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    good[both] = bench.pairs[bigram(codes[both], codes[both + 1])]
    broken = np.flatnonzero(~good)
    after = broken[np.searchsorted(broken, at)]
    array = suffixes(codes, at[(known[w.codes] > 0) & (after - at + 1 >= size)], int(bench.sizes.max()))

    query, window = bench.query, bench.window
    lo, hi, live, k, hits = np.zeros(len(query), np.int64), np.full(len(query), len(array)), np.arange(len(query)), 0, []
    while len(live):
        lo[live], hi[live] = narrow(codes, array, lo[live], hi[live], k, bench.codes[query[live] + k])
        live = live[lo[live] < hi[live]]
        k += 1
        full = live[window[live] == k]
        if len(full):
            hits.append((np.repeat(full, hi[full] - lo[full]), array[spread(lo[full], hi[full] - lo[full])]))
        live = live[window[live] > k]
    if not hits:
        return Found(*[np.zeros(0, np.int64)] * 5)
    q, place = (np.concatenate(x) for x in zip(*hits, strict=True))
    n, item_at = window[q].copy(), query[q]
    on = np.arange(len(q))
    while len(on):  # on to the end of the longest match
        on = on[(c := codes[place[on] + n[on]]) == bench.codes[item_at[on] + n[on]]]
        on = on[codes[place[on] + n[on]] > 0]
        n[on] += 1
    doc = np.searchsorted(w.offsets[1:] + np.arange(len(w.offsets) - 1), place, "left")
    item = bench.item[item_at]
    return Found(doc, place - doc - w.offsets[doc], n, item, item_at - bench.starts[item])


def split_benchmark(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The items (item_id, text) in blocks of about `limit` bytes of text. Each is collected,
    broadcast and released for itself, so the driver never holds more than one. Rows that repeat an
    item's id and text are one; the blocks go by both, so copies of a text under other ids spread."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()  # copies of an item are one
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = total // limit + 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items for k in range(parts)]


def handed_out(block: DataFrame, n: int) -> Broadcast:
    """The index of one block, for all tasks."""
    rows = block.toArrow()
    index = Benchmark.of(rows["item_id"].to_pylist(), texts_of(pa.chunked_array(rows["text"].chunks, pa.string()).combine_chunks()), n)
    return block.sparkSession.sparkContext.broadcast(index)


def found_spans(rows: DataFrame, bench: Broadcast, kind: str, every: bool) -> DataFrame:
    """row, doc_id, n_words and spans of one block's items; every: also of rows without any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = bench.value
        for b in (part for whole in batches for part in sliced(whole)):
            w = lower_words(texts_of(b["text"]))
            f = search(w, items)
            order = np.argsort(f.doc, kind="stable")
            ids = pa.array(items.ids, pa.string()).take(pa.array(f.item[order]))
            values = pa.StructArray.from_arrays([pa.array(f.word[order], pa.int32()), pa.array(f.n[order], pa.int32()), ids, pa.array(f.item_word[order], pa.int32())], ["doc_word", "n_words", "item_id", "item_word"])
            counts = np.bincount(f.doc, minlength=len(b))
            spans = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), values)
            out = pa.RecordBatch.from_arrays([b["row"], b["doc_id"], pa.array(w.counts, pa.int64()), spans], ["row", "doc_id", "n_words", "spans"])
            yield out if every else out.filter(pa.array(counts > 0))

    return rows.mapInArrow(work, f"row long, doc_id {kind}, n_words long, spans {SPANS}")


def hit_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words and spans for each row: every place of an item's window of n words (of
    all its words, if it has fewer), with the length of the longest match from there on."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = split_benchmark(benchmark, limit)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if len(blocks) == 1:
        return found_spans(rows, handed_out(blocks[0], n), kind, True).select("doc_id", "n_words", "spans")
    scratch = Scratch(docs.sparkSession)
    rows, found = scratch.save(rows, "rows"), []
    for k, block in enumerate(blocks):
        bench = handed_out(block, n)
        found.append(scratch.save(found_spans(rows, bench, kind, k == 0), f"found{k}"))
        bench.destroy()
    each = found[0]
    for x in found[1:]:
        each = each.union(x)
    each = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return each.select("doc_id", "n_words", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, spans = b["n_words"].to_numpy(), b["spans"]
            bounds = spans.offsets.to_numpy().astype(np.int64)
            flat = spans.values.slice(bounds[0], bounds[-1] - bounds[0])
            bounds = bounds - bounds[0]
            ends = np.concatenate(([0], np.cumsum(words)))
            base = np.repeat(ends[:-1], np.diff(bounds))
            hit = covered(base + flat.field("doc_word").to_numpy(), flat.field("n_words").to_numpy().astype(np.int64), int(ends[-1]))
            ids = pa.ListArray.from_arrays(bounds.astype(np.int32), flat.field("item_id"))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_words"], pa.array(sums(hit, ends)), ids], ["doc_id", "n_words", "n_hit", "ids"])

    spans = hit_spans(docs, benchmark, n, limit)
    rows = spans.mapInArrow(work, f"doc_id {kind}, n_words long, n_hit long, ids array<string>")
    rows = rows.withColumn("ids", F.array_sort(F.array_distinct("ids")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows, all columns, in which no item's window occurs."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    blocks = split_benchmark(benchmark, limit)
    scratch = Scratch(docs.sparkSession)
    for k, block in enumerate(blocks):
        bench = handed_out(block, n)

        def work(batches: Iterator[pa.RecordBatch], bench=bench) -> Iterator[pa.RecordBatch]:
            for b in (part for whole in batches for part in sliced(whole)):
                f = search(lower_words(texts_of(b["text"])), bench.value)
                clean = np.ones(len(b), bool)
                clean[f.doc] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(work, schema)
        if len(blocks) > 1:
            docs = scratch.save(docs, f"clean{k}")
            bench.destroy()
            scratch.drop(f"clean{k - 1}")
    return docs
