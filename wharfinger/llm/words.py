"""Arrow and NumPy helpers that look at a whole batch of texts at once.

Every helper takes what Spark hands to one task (an Arrow batch) and keeps
documents apart by offsets, so no per-row Python loop is needed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SLICE_BYTES = 4 << 20  # of text that a task works on at once
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


@dataclass
class Words:
    """codes[offsets[i]:offsets[i+1]] are document i's words, as places in vocab."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word, computed once for each distinct one."""
        by_code = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocab.to_numpy(zero_copy_only=False)), U64, len(self.vocab))
        return by_code[self.codes] if len(by_code) else np.zeros(0, U64)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> Words:
    """Words are maximal runs without the bytes 0x20 and 0x09-0x0D."""
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    encoded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(encoded.indices.to_numpy(), before[bounds - bounds[0]], encoded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x ^ (x >> U64(30))
    x *= _M2
    x ^= x >> U64(27)
    x *= _M3
    x ^= x >> U64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ordered pairs (a, b)."""
    return mix(a * _M1 + b)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """out[i] hashes h[i:i+n] in order; built from the powers of two that make up n."""
    done, total, power, width = 0, None, h, 1
    while True:
        if n & width:
            part = power[done:]
            total = part if total is None else pair(total[: len(part)], part)
            done += width
        width *= 2
        if width > n:
            break
        power = pair(power[: max(0, len(power) - width // 2)], power[width // 2 :])
    size = max(0, len(h) - n + 1)
    return total[:size]


def window_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Where windows of n words start that lie within one document."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    return spread(offsets[:-1], counts)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] values for each i."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def covered(starts: np.ndarray, lengths, total: int) -> np.ndarray:
    """True for each of total places that lies in some span."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum over each document's slice."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): an order that puts equal rows side by side, earlier rows first, and
    which of the ordered rows begin a group. A hash sorts, the columns themselves decide."""
    h = columns[0].astype(U64)
    for c in columns[1:]:
        h = pair(h, c.astype(U64))
    order = np.argsort(h, kind="stable")
    hs, first = h[order], np.ones(len(h), bool)
    if len(h):
        first[1:] = hs[1:] != hs[:-1]
        inner = np.flatnonzero(~first)
        if any((c[order[inner]] != c[order[inner - 1]]).any() for c in columns):  # two rows share a hash by chance
            order = np.lexsort(columns[::-1])
            first = np.ones(len(h), bool)
            first[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order, first


def sliced(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text at most, so that a task's memory
    follows the slice, not the batch; a longer text is a part by itself."""
    for a, b in slices(texts_of(batch[column]), limit):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """What this process has freed, in earlier tasks too, goes back to the system: a worker lives on from
    stage to stage beside the executor, whose heap doesn't shrink either."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes at most."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b
