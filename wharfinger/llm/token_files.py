"""Token ids of whole documents in doc_id order, as grammar-compressed shards.

Documents are sorted by doc_id over range partitions; a task encodes its range slice by
slice and writes a shard for each. Shards are rows of a Parquet table, so Spark commits
them and finds them again; the payload is the binary layout in grammar.py. Reading adds up
the shards' sizes in order, which gives each document its place among all ids.

Defined results: null text is the empty text, which still gets the end id; a null doc_id
comes first; rows that share a doc_id are written one after the other in the order of the
lengths of their texts, then of the texts, so that a rerun writes the same ids, and many of them are dealt to several tasks;
a text of any length is a slice by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wharfinger.llm import grammar
from wharfinger.llm.words import give_back, slices, split_words, spread, sums, texts_of

PART_BYTES, SLICE_BYTES = 16 << 20, 2 << 20  # of text: a task's share, which may come as one batch, and that of a shard
MEMO, JOINED, AT_ONCE = 1_200_000, 2000, 1000
BROADCAST_SHARDS = 200_000


def hashed(words: list[str] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word, in two halves."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Encoder:
    """Ids of texts by a file of the tokenizers library.

    by_word: the tokenizer drops white space and never looks across it, so that each distinct
    word is encoded once. Words of letters are encoded many at a time; the mark of a word's
    last token tells them apart, and if there are not as many marks as words, they are
    encoded one by one. Texts that may hold the tokenizer's added tokens go whole."""

    def __init__(self, path: str, by_word: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.base = self.tokenizer.get_vocab_size()
        self.last = np.zeros(self.base, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """What is known of words: sorted hashes, the word's number, and where its ids are."""
        self.keys, self.seconds, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The library's results are far larger than the ids, so few are held at a time."""
        out = []
        for i in range(0, len(texts), AT_ONCE):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        return out

    def learn(self, words: list[str], letters: np.ndarray) -> list[str]:
        """Adds the ids of new words, in the order returned."""
        plain, rest = [w for w, x in zip(words, letters, strict=True) if x], [w for w, x in zip(words, letters, strict=True) if not x]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        sizes, flat, order = [], [], []
        for g in groups:
            ids = self.whole([" ".join(g)])[0]
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(g) or len(ids) and ends[-1] != len(ids) - 1:
                rest += g
                continue
            sizes.append(np.diff(ends, prepend=-1))
            flat.append(ids)
            order += g
        single = self.whole(rest)
        sizes.append(np.array([len(x) for x in single], np.int64))
        flat += single
        order += rest
        new = np.concatenate(sizes)
        self.starts, self.sizes = np.append(self.starts, len(self.flat) + np.cumsum(new) - new), np.append(self.sizes, new)
        self.flat = np.concatenate([self.flat, *flat])
        return order

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in starts and sizes."""
        listed = words.to_numpy(zero_copy_only=False)
        keys, seconds = hashed(listed)
        at = self.find(keys, seconds)
        out = self.numbers[at] if len(self.numbers) else np.zeros(len(at), np.int32)
        if len(new := np.flatnonzero(at < 0)):
            letters = pc.match_substring_regex(words.take(pa.array(new)), r"^\p{L}+$").to_numpy(zero_copy_only=False)
            first = len(self.sizes)
            key, second = hashed(self.learn([listed[i] for i in new], letters))
            order = np.argsort(key)
            place = np.searchsorted(self.keys, key[order])
            self.keys, self.seconds = np.insert(self.keys, place, key[order]), np.insert(self.seconds, place, second[order])
            self.numbers = np.insert(self.numbers, place, first + order)
            out[new] = self.numbers[self.find(keys[new], seconds[new])]
        return out

    def find(self, keys: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        """Where the words with these hashes are known, -1 for those that aren't."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        last = len(self.keys) - 1
        at = np.minimum(np.searchsorted(self.keys, keys), last)
        while (off := (self.keys[at] == keys) & (self.seconds[at] != seconds) & (at < last)).any():  # two words share the first half
            at[off] += 1
        return np.where((self.keys[at] == keys) & (self.seconds[at] == seconds), at, -1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has)."""
        if not self.by_word:
            each = self.whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        w = split_words(texts)
        lower = pc.ascii_lower(w.vocab)
        special, word = np.zeros(len(texts), bool), np.zeros(len(lower), bool)
        for t in self.added:  # looked for in the words, if it has no white space
            if t.split() == [t]:
                word |= pc.match_substring(lower, t.lower()).to_numpy(zero_copy_only=False)
            else:
                special |= pc.match_substring(texts, t, ignore_case=True).to_numpy(zero_copy_only=False)
        if word.any():
            special |= sums(word[w.codes], w.offsets) > 0
        if special.any():
            each: list = [None] * len(texts)
            for i, ids in zip(np.flatnonzero(special), self.whole(texts.filter(pa.array(special)).to_pylist()), strict=True):
                each[i] = ids
            ids, n = self.encode(texts.filter(pa.array(~special)))
            for i, x in zip(np.flatnonzero(~special), np.split(ids, np.cumsum(n)[:-1]) if len(n) else [], strict=True):
                each[i] = x
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        if len(self.keys) > MEMO:
            self.forget()
        if not len(w.codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        parts = pc.extract_regex(lower, r"^(?P<stem>\p{L}+)(?P<tail>[!-/:-@\[-`{-~]+)$")
        stem = pc.coalesce(parts.field("stem"), lower) if parts.null_count == 0 else pc.if_else(parts.is_valid(), parts.field("stem"), lower)
        stem = stem.dictionary_encode()
        tail = pc.if_else(parts.is_valid(), parts.field("tail"), pa.scalar("", pa.large_string())).dictionary_encode()
        a = self.look_up(stem.dictionary)[stem.indices.to_numpy()]
        b = self.look_up(tail.dictionary)[tail.indices.to_numpy()]
        both = np.stack([a, b], axis=1).reshape(-1)  # stem and tail of each distinct word
        flat = self.flat[spread(self.starts[both], self.sizes[both])]
        size = self.sizes[a] + self.sizes[b]
        sizes = size[w.codes]
        return flat[spread((np.cumsum(size) - size)[w.codes], sizes)], sums(sizes, w.offsets)


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool) -> Encoder:
    return Encoder(path, by_word)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, by_word: bool = False) -> None:
    """Writes the shards of docs to a new table at path."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc, seq = encoder(tokenizer, by_word), 0
        for b in batches:
            texts = texts_of(b["text"])
            for i, j in slices(texts, SLICE_BYTES):
                ids, n = enc.encode(texts.slice(i, j - i))
                ends = np.cumsum(n) + np.arange(len(n))
                with_end = np.full(len(ids) + len(n), end_id, np.uint32)
                inner = np.ones(len(with_end), bool)
                inner[ends] = False
                with_end[inner] = ids
                doc_id = b["doc_id"].slice(i, j - i)
                data = grammar.to_bytes(grammar.induce(with_end, enc.base), n + 1, pc.fill_null(doc_id, 0).to_numpy(), pc.is_null(doc_id).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b["part"].slice(i, 1), pa.array([seq], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([len(with_end)], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "data"])
                seq += 1
                del ids, n, ends, with_end, inner, data
                give_back()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").alias("tie"))
    sorted_ = keyed.repartitionByRange(n_bytes // PART_BYTES + 1, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    shards = sorted_.withColumn("part", F.spark_partition_id()).mapInArrow(work, "part int, seq int, n_docs long, n_tokens long, data binary")
    shards.write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq and start: the ids in all shards before. Sums of parts are ordered in one
    task, a row for each range partition; the shards of a part are ordered beside each other."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return sizes.withColumn("inner", inner).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("start"))


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as u32, little-endian) and, if wanted,
    ids of each document in the table at path."""
    shards = spark.read.parquet(path)
    starts = shard_starts(shards)
    if shards.count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, start in zip(b["data"], b["start"].to_pylist(), strict=True):
                g, n, doc_id, null = grammar.from_bytes(data.as_py())
                flat = g.expand(g.symbols)
                ends = np.cumsum(n, dtype=np.int64)
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends - n, ends, strict=True)]
                out = [pa.array(doc_id, mask=null.astype(bool)), pa.array(start + ends - n), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return shards.join(starts, ["part", "seq"]).select("data", "start").mapInArrow(work, schema)


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """start and ids: the ids from start to stop among all of the table at path, a row for each shard
    that has some of them. Other parts are left out by their numbers, other shards by their sizes."""
    shards = spark.read.parquet(path)
    met = shard_starts(shards).join(shards.select("part", "seq", "n_tokens"), ["part", "seq"]).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    ends = met.agg(F.min("part"), F.max("part")).first()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, first, n in zip(b["data"], b["start"].to_pylist(), b["n_tokens"].to_pylist(), strict=True):
                g = grammar.from_bytes(data.as_py())[0]
                a, z = max(0, start - first), min(n, stop - first)
                yield pa.RecordBatch.from_arrays([pa.array([first + a]), pa.array([g.range(a, z)], pa.list_(pa.int32()))], ["start", "ids"])

    rows = shards.where(F.col("part").between(ends[0], ends[1])) if ends[0] is not None else shards.limit(0)
    return rows.select("part", "seq", "data").join(F.broadcast(met), ["part", "seq"]).select("data", "start", "n_tokens").mapInArrow(work, "start long, ids array<int>")
