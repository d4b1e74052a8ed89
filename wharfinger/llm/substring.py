"""Removal of word windows that occur earlier in the corpus.

Documents are dealt to blocks once. A block sends a piece to each shard, so blocks and shards
grow with the square root of the input: there are some two pieces for PIECE_BYTES of text, whatever
its size, and no limit to either. Tasks go through a block in parts of PART_BYTES of text and
keep 16 bytes a window of it. Each block makes a count-min sketch of its windows,
a sparse piece for each shard of the hash space; a shard adds up the pieces of all blocks and
tells each block which of its cells count two or more. A sum can only overestimate, so
windows below two are alone and go no further. Of the others each block sends every distinct
window once, with its first place, and the shard groups them exactly and answers with those
whose first place is elsewhere. So a window that a third of all documents hold is one row a
block. Nothing is broadcast and no piece is larger than its block or its shard.

Defined results: null text has no words; texts of fewer words than a window lose none;
places are ordered by doc_id (null last), then start; rows that share a doc_id count as
parts of one document in the order of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfinger.llm.words import U64, Words, covered, mix, slices, split_words, sums, texts_of, window_starts, windows

BLOCK_BYTES, PART_BYTES, PIECE_BYTES = 8 << 20, 8 << 20, 4096
CELLS_PER_WINDOW, BYTES_PER_WINDOW = 4, 6
ROWS = (U64(0), U64(0x6A09E667F3BCC909))  # the sketch's rows: what a window's hash is mixed with for its cell
LAST = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + "".join(f"{a.dtype.str:4}" for a in arrays).encode() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, k, 8), 8 + 8 * k, []
    kinds = [np.dtype(raw[at + 4 * i : at + 4 * i + 4].decode().strip()) for i in range(k)]
    at += 4 * k
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * kind.itemsize
    return out


def steps(sorted_: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, in the least type that holds them."""
    d = np.diff(sorted_, prepend=sorted_[:1] * 0)
    return d.astype(np.min_scalar_type(int(d.max())) if len(d) else np.uint8)


class Shape:
    """How many blocks and shards there are, and cells in a row of a shard's sketch."""

    def __init__(self, n_bytes: int, least: int = BLOCK_BYTES) -> None:
        self.block_bytes = max(least, math.isqrt(n_bytes * PIECE_BYTES))
        self.n_blocks = n_bytes // self.block_bytes + 1
        self.shard_bits = (self.n_blocks - 1).bit_length()
        want = max(1, n_bytes // BYTES_PER_WINDOW * CELLS_PER_WINDOW >> self.shard_bits)
        self.cell_bits = max(10, want.bit_length())

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.shard_bits)).astype(np.int64) if self.shard_bits else np.zeros(len(h), np.int64)

    def cells(self, h: np.ndarray) -> list[np.ndarray]:
        """For each row of the sketch, shard and cell in one number."""
        mask = U64((1 << self.cell_bits) - 1)
        return [(self.shard(h) << self.cell_bits) | ((mix(h ^ r) if r else h) & mask).astype(np.int64) for r in ROWS]

    def split(self, keys: np.ndarray) -> list[tuple[int, slice]]:
        """The slices of sorted keys that belong to each shard."""
        shards = keys >> self.cell_bits
        bounds = np.flatnonzero(np.diff(shards, prepend=-1, append=-1))
        return [(int(shards[a]), slice(a, b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Part:
    """Some documents of a block, in order, with the hashes of their windows."""

    def __init__(self, doc_id: pa.Array, texts: pa.Array, n: int, before: tuple[int, int]) -> None:
        self.doc_id, self.n = doc_id, n
        self.ids = pc.fill_null(doc_id, LAST).to_numpy()
        self.words: Words = split_words(texts)
        self.starts = window_starts(self.words.offsets, n)
        self.h = windows(self.words.hashes(), n)[self.starts]
        run = np.maximum.accumulate(np.where(np.append(True, self.ids[1:] != self.ids[:-1]), np.arange(len(self.ids)), 0))
        self.begin = self.words.offsets[:-1][run]  # where the words of a doc_id begin; rows may share it
        if before[0] == self.ids[0]:
            self.begin = np.where(run == 0, self.begin - before[1], self.begin)
        self.after = (int(self.ids[-1]), int(self.words.offsets[-1] - self.begin[-1]))

    def check(self) -> np.ndarray:
        """32 more bits for each window, of other word hashes."""
        return (windows(self.words.hashes(1), self.n)[self.starts] >> U64(32)).astype(np.uint32)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and the word's number within all rows of that doc_id."""
        row = np.searchsorted(self.words.offsets, at, "right") - 1
        return self.ids[row], at - self.begin[row]


def parts(block: pa.Table, n: int) -> Iterator[Part]:
    """The block's documents in order, in parts of about PART_BYTES of text."""
    block = block.select(["doc_id", "text"])
    block = block.take(pc.sort_indices(block, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
    if not len(block):
        return
    texts, before = texts_of(block["text"].chunk(0)), (-1, 0)
    doc_id = block["doc_id"].chunk(0)
    for i, j in slices(texts, PART_BYTES):
        part = Part(doc_id.slice(i, j - i), texts.slice(i, j - i), n, before)
        before = part.after
        yield part


def gone_windows(p: Part, h: np.ndarray, check: np.ndarray, later: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which windows of the part go. (h, check) are the block's answers in order; the first window
    of an answer stays unless it starts earlier elsewhere (later). seen: answers met before."""
    gone = np.zeros(len(p.h), bool)
    if not len(h):
        return gone
    at = np.searchsorted(h, p.h)
    near = np.flatnonzero(h[np.minimum(at, len(h) - 1)] == p.h)
    own = p.check()[near]
    while (off := (check[at[near]] != own) & (h[np.minimum(at[near] + 1, len(h) - 1)] == p.h[near]) & (at[near] + 1 < len(h))).any():
        at[near[off]] += 1
    near = near[check[at[near]] == own]
    gone[near] = True
    which, first = np.unique(at[near], return_index=True)
    fresh = ~seen[which]
    gone[near[first[fresh]]] = later[which[fresh]] > 0
    seen[which] = True
    return gone


def kept_words(p: Part, gone: np.ndarray) -> pa.Table:
    """doc_id, n_words, n_removed, removed and text of the part without the words of gone windows."""
    w, total = p.words, len(p.words.codes)
    out = covered(p.starts[gone], p.n, total)
    edge = np.diff(np.concatenate(([False], out, [False])).astype(np.int8))
    heads = w.offsets[:-1][w.counts > 0]
    edge[heads] |= out[heads].astype(np.int8)  # a run ends with its document
    begin = np.flatnonzero(edge[:-1] > 0)
    row = np.searchsorted(w.offsets, begin, "right") - 1
    stay = np.flatnonzero(~out)
    after = np.append(stay, total)[np.searchsorted(stay, begin)]
    runs = pa.StructArray.from_arrays([pa.array(begin - w.offsets[row], pa.int32()), pa.array(np.minimum(after, w.offsets[row + 1]) - begin, pa.int32())], ["word", "n_words"])
    spans = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(p.ids))))).astype(np.int32), runs)
    kept = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(~out)))[w.offsets]), w.vocab.take(pa.array(w.codes[~out])))
    text = pc.binary_join(kept.cast(pa.list_(pa.large_string())), pa.scalar(" ", pa.large_string()))
    return pa.table({"doc_id": p.doc_id, "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(sums(out, w.offsets)), "removed": spans, "text": text.cast(pa.string())})


def piece_table(shard: list[int], block: list[int], data: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(shard, pa.int32()), "block": pa.array(block, pa.int32()), "data": pa.array(data, pa.binary())})


def cut(docs: DataFrame, n: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, removed (runs of removed words) and text (the kept words,
    joined by a space) for each row: without the words of a window that starts earlier too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shape = Shape(n_bytes, block_bytes)

    def sketch(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.zeros(0, U64), *(p.h for p in parts(table, n))])
        pieces: dict[int, list[np.ndarray]] = {}
        for keys in shape.cells(h):
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            counts = np.minimum(np.diff(first, append=len(keys)), 255).astype(np.uint8)
            for shard, at in shape.split(cells := keys[first]):
                pieces.setdefault(shard, []).extend((steps(cells[at] & ((1 << shape.cell_bits) - 1)), counts[at]))
        block = table["block"][0].as_py()
        return piece_table(list(pieces), [block] * len(pieces), [pack(*x) for x in pieces.values()])

    def merge(table: pa.Table) -> pa.Table:
        sums_ = [np.zeros(1 << shape.cell_bits, np.uint8) for _ in ROWS]
        parts = [unpack(x) for x in table["data"].to_pylist()]
        for p in parts:
            for r, total in enumerate(sums_):
                at = np.cumsum(p[2 * r], dtype=np.int64)
                total[at] = np.minimum(total[at].astype(np.int64) + p[2 * r + 1], 255)
        answers = [pack(*[np.packbits(total[np.cumsum(p[2 * r], dtype=np.int64)] > 1) for r, total in enumerate(sums_)]) for p in parts]
        return pa.table({"block": table["block"], "shard": table["shard"], "data": pa.array(answers, pa.binary())})

    def candidates(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs_):
            return piece_table([], [], [])
        hot = dict(zip(answers["shard"].to_pylist(), map(unpack, answers["data"].to_pylist()), strict=True))
        few = list(parts(docs_, n)) if docs_["text"].nbytes <= 2 * PART_BYTES else None  # a longer block is gone through twice
        h = np.concatenate([np.zeros(0, U64), *(p.h for p in few or parts(docs_, n))])
        counted = []
        for r, keys in enumerate(shape.cells(h)):
            keys.sort()
            cells = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
            flags = [np.unpackbits(hot[s][r], count=at.stop - at.start) for s, at in shape.split(cells)]
            counted.append(cells[np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)])
        del h
        live = []
        for p in few or parts(docs_, n):
            held = np.ones(len(p.h), bool)
            for keys, known in zip(shape.cells(p.h), counted, strict=True):
                held &= known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else False
            at = np.flatnonzero(held)
            live.append((p.h[at], p.check()[at], *p.place(p.starts[at])))
        if not live:
            return piece_table([], [], [])
        h, check, doc, word = (np.concatenate(x) for x in zip(*live, strict=True))
        at = np.arange(len(h))
        order = np.lexsort((at, check, h))
        h, check, doc, word = h[order], check[order], doc[order], word[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1]))[: len(h)])
        many = np.diff(first, append=len(h)) > 1
        h, check, doc, word = h[first], check[first], doc[first], word[first]
        shards = shape.shard(h)
        bounds = np.flatnonzero(np.diff(shards, prepend=-1, append=-1))
        rows = [(int(shards[i]), pack(h[i:j], check[i:j], doc[i:j], word[i:j].astype(np.int32), many[i:j].astype(np.uint8))) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        block = docs_["block"][0].as_py()
        return piece_table([s for s, _ in rows], [block] * len(rows), [x for _, x in rows])

    def earliest(table: pa.Table) -> pa.Table:
        """For each block the windows that start earlier elsewhere (1), and those that start
        first in the block but again in it (0)."""
        parts = [unpack(x) for x in table["data"].to_pylist()]
        h, check, doc, word, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((word, doc, check, h))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
        later = np.ones(len(h), np.uint8)
        later[order[first]] = 0
        ends, answers = np.cumsum([len(p[0]) for p in parts]), []
        for p, end in zip(parts, ends, strict=True):
            own = later[end - len(p[0]) : end]
            told = (own > 0) | (p[4] > 0)
            answers.append(pack(p[0][told], p[1][told], own[told]))
        return pa.table({"block": table["block"], "data": pa.array(answers, pa.binary())})

    def remove(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        told = [unpack(x) for x in answers["data"].to_pylist()]
        h, check, later = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((U64, np.uint32, np.uint8), zip(*told, strict=True) if told else ((), (), ()), strict=True))
        order = np.lexsort((check, h))
        h, check, later = h[order], check[order], later[order]
        seen = np.zeros(len(h), bool)
        out = [kept_words(p, gone_windows(p, h, check, later, seen)) for p in parts(docs_, n)]
        return pa.concat_tables(out)

    n_parts = max(shape.n_blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # with fewer Spark would deal the texts out again
    block = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(shape.n_blocks)), F.lit(0)).cast("int")
    dealt = docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(n_parts, "block")
    piece = "shard int, block int, data binary"
    hot = dealt.groupBy("block").applyInArrow(sketch, piece).groupBy("shard").applyInArrow(merge, "block int, shard int, data binary")
    sent = dealt.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(candidates, piece)
    told = sent.groupBy("shard").applyInArrow(earliest, "block int, data binary")
    result = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, removed array<struct<word:int,n_words:int>>, text string")
    return result.withColumn("doc_id", F.col("doc_id").cast(kind))
