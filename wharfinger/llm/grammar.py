"""Re-Pair grammars of token ids, and the binary shard that holds one.

A round counts the pairs of neighbours, gives the most frequent ones a nonterminal each and
replaces them from left to right. A shard keeps the rules, how many ids each symbol stands for,
and how many stand before every MARK-th one, so that any range of ids is decoded without the rest.

Layout, little-endian: "WRP2", four u32 (base, number of rules, symbols, documents), then u32
rules[n][2], u32 lengths[n], u32 symbols[], u32 tokens of each document, i64 doc_id of each
document, u8 whether that doc_id is null, i64 marks[].
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from wharfinger.llm.words import spread

MAGIC = b"WRP2"
MARK = 1024
TOP, LEAST, BUCKET_BITS = 8192, 4, 20  # a rule is three numbers, so pairs found four times pay
_U64 = np.uint64


@dataclass
class Grammar:
    """Symbols below base are ids; base + i stands for the pair rules[i]."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    _marks: np.ndarray | None = None

    def size_of(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for: rules are written out once, then copied."""
        sizes, n = self.lengths.astype(np.int64), len(self.lengths)
        at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        flat = np.zeros(int(at[-1]), np.uint32)
        todo, symbol, place = np.arange(n), self.rules.reshape(-1).astype(np.int64), None
        first = self.size_of(symbol[0::2]) if n else np.zeros(0, np.int64)
        place = np.stack([at[:-1], at[:-1] + first], axis=1).reshape(-1)
        while len(todo):
            leaf = symbol < self.base
            flat[place[leaf]] = symbol[leaf]
            symbol, place = symbol[~leaf], place[~leaf]
            pairs = self.rules[symbol - self.base].astype(np.int64)
            first = self.size_of(pairs[:, 0])
            place = np.stack([place, place + first], axis=1).reshape(-1)
            symbol = pairs.reshape(-1)
            todo = symbol
        out = np.repeat(symbols.astype(np.uint32), self.size_of(symbols))
        rule = np.flatnonzero(symbols >= self.base)
        sizes_ = self.size_of(symbols)
        ends = np.cumsum(sizes_)
        index = symbols[rule].astype(np.int64) - self.base
        out[spread((ends - sizes_)[rule], sizes_[rule])] = flat[spread(at[index], sizes[index])]
        return out

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop: a mark leads near the first symbol, and only symbols that
        reach into the range are opened, level by level."""
        m = max(0, int(np.searchsorted(self.marks, start, "right")) - 1)
        at, a, parts = int(self.marks[m]) if len(self.marks) else 0, m * MARK, []
        first = at
        while a < len(self.symbols) and at < stop:
            parts.append(self.symbols[a : a + MARK])
            at += int(self.size_of(parts[-1]).sum())
            a += MARK
        part = np.concatenate([np.zeros(0, np.uint32), *parts])
        while True:
            ends = first + np.cumsum(self.size_of(part))
            lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
            first, part = (int(ends[lo - 1]) if lo else first), part[lo:hi]
            rule = part >= self.base
            if not rule.any():
                return part[start - first : stop - first]
            width = 1 + rule.astype(np.int64)
            out = np.repeat(part, width)
            at_ = (np.cumsum(width) - width)[rule]
            pairs = self.rules[part[rule].astype(np.int64) - self.base]
            out[at_], out[at_ + 1] = pairs[:, 0], pairs[:, 1]
            part = out

    @property
    def marks(self) -> np.ndarray:
        """How many ids stand before every MARK-th symbol."""
        if self._marks is None:
            sizes = self.size_of(self.symbols)
            self._marks = (np.cumsum(sizes) - sizes)[::MARK]
        return self._marks


def induce(ids: np.ndarray, base: int, top: int = TOP, least: int = LEAST) -> Grammar:
    """A grammar of the ids, all below base. Each round takes at most `top` pairs that occur
    `least` times or more; pairs that meet in a bucket with another one wait for a later round.
    It goes on until two rounds in a row find no pair; a round looks only at pairs that may still
    be frequent."""
    symbols, rules = ids.astype(np.uint32), []
    known, size = 0, np.ones(base, np.uint32)
    open_ = np.arange(len(symbols) - 1)  # where pairs begin that may still be frequent
    turn = idle = 0
    while len(open_) and idle < 2:
        turn += 1
        idle += 1
        bits = min(BUCKET_BITS, len(open_).bit_length() + 1)
        n = 1 << bits
        key = symbols[open_].astype(_U64) | (symbols[open_ + 1].astype(_U64) << _U64(32))
        bucket = ((key * _U64(0x9E3779B97F4A7C15 + 2 * 0x2545F4914F6CDD1D * turn & (1 << 64) - 1)) >> _U64(64 - bits)).view(np.int64)
        holder = np.empty(n, _U64)
        holder[bucket] = key
        bucket[holder[bucket] != key] = n  # the last one takes those that wait
        counts = np.bincount(bucket, minlength=n + 1)
        counts[-1] = 0
        chosen = np.flatnonzero(counts >= least)
        if len(chosen) > top:
            chosen = chosen[np.argpartition(-counts[chosen], top)[:top]]
        counts[-1] = least
        stay = counts[bucket] >= least  # a pair of old symbols never becomes more frequent
        if not len(chosen):
            open_ = open_[stay]
            continue
        number = np.full(n + 1, -1, np.int32)
        number[chosen] = np.arange(len(chosen), dtype=np.int32)
        rule = number[bucket]
        hit = np.flatnonzero(rule >= 0)
        at, rule = open_[hit], rule[hit]
        run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        start = np.repeat(at[run], np.diff(run, append=len(at)))
        even = (at - start) % 2 == 0
        at, rule = at[even], rule[even]
        used = np.bincount(rule, minlength=len(chosen))
        paid = used[rule] > 1
        at, rule = at[paid], rule[paid]
        if not len(at):
            open_ = open_[stay]
            continue
        order = np.cumsum(used > 1) - 1
        pairs = holder[chosen[used > 1]]
        new = pairs.view(np.uint32).reshape(-1, 2)
        rules.append(new)
        size = np.append(size, size[new[:, 0]] + size[new[:, 1]])
        symbols[at] = (base + known + order[rule]).astype(np.uint32)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        mark = np.zeros(len(symbols), bool)  # pairs that stay open, and those with a new symbol
        mark[open_[stay]] = True
        mark[at] = True
        symbols, mark = symbols[keep], mark[keep]
        fresh = np.flatnonzero(symbols >= base + known)
        mark[np.maximum(fresh - 1, 0)] = True
        open_ = np.flatnonzero(mark[:-1])
        known += len(new)
        idle = 0
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return Grammar(base, all_rules, size[base:].astype(np.uint32), symbols)


def to_bytes(g: Grammar, tokens: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray) -> bytes:
    head = MAGIC + struct.pack("<4I", g.base, len(g.rules), len(g.symbols), len(tokens))
    return b"".join([head, *(np.ascontiguousarray(x, k).tobytes() for x, k in ((g.rules, "<u4"), (g.lengths, "<u4"), (g.symbols, "<u4"), (tokens, "<u4"), (doc_ids, "<i8"), (nulls, "u1"), (g.marks, "<i8")))])


def from_bytes(data: bytes) -> tuple[Grammar, np.ndarray, np.ndarray, np.ndarray]:
    """The grammar, and of each document its tokens, doc_id and whether that is null."""
    if data[:4] != MAGIC:
        raise ValueError("not a grammar shard")
    base, r, s, d = struct.unpack_from("<4I", data, 4)
    at, out = 20, []
    for n, kind in ((2 * r, "<u4"), (r, "<u4"), (s, "<u4"), (d, "<u4"), (d, "<i8"), (d, "u1"), (-(-s // MARK), "<i8")):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return Grammar(base, out[0].reshape(-1, 2), out[1], out[2], out[6]), *out[3:6]
