"""Near-duplicates by a chosen-path join of MinHash signatures.

Documents with equal shingle sets form a class; one document stands for it. A class gets 64
minwise tokens. In each of TREES trees a node chooses one of the 64 places (a second one with
probability 1/threshold - 1, so that a pair at the threshold meets in as many nodes at each
depth), and its members go on to a child for each value there. Nodes with at most SMALL members
compare them all by their sketches. Of a larger node only counts are gathered and its members
go deeper. What is still together at depth STAR is mostly one family: there each member is
first paired with one drawn at random, the closest pair of each document is confirmed, and a
node whose members are all connected by then is done. If at most `outside` members stand outside
its largest component, these meet the family's members in packed blocks, on full sets; a node
with more of them goes deeper in SUBTREES trees of its own. At depth DEEPEST every node is compared in
blocks. So no bucket is capped and no group is ever gathered, and hot nodes and families are
dealt by salts.

Candidates are confirmed on the full shingle sets; those whose ends are connected already
need no confirming. Components come from the confirmed links.

Recall: a pair at similarity 0.8 is missed by one tree with probability 0.16 at depth 1 and 0.36
at depth 3, by all of 14 trees with less than 1e-6 if places were drawn anew; trees draw from one
signature of 64 places, which makes it some 2e-5. From depth 3 on a pair is still together d
places deeper in one tree with about 1 / (1 + d / 6); in one of eight subtrees with 0.99 at
d = 10, 0.89 at d = 20 and 0.69 at d = 40. So the miss of one tree grows from 0.36 to 0.43 at depth
23 and 0.56 at most, that of 14 trees to 1e-5 and 3e-4. Besides, sketches that differ in more than FAR
places are no candidates: for a pair at 0.8 that is the tail of 64 draws at 0.15, 2e-7.

Defined results: null or wordless text has the empty set and is linked with nothing; rows
that repeat a doc_id are one document with several sets, linked by any of them, so they share a component; a row
without doc_id is a document of its own, after all that have one: its component_id is null if
nothing with a doc_id is reached, and one such row of a component is kept; a document of fewer
words than a shingle has its whole sequence as the one member of its set; texts of any length are
read whole; doc_ids are below 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfinger.llm.components import absorb, components
from wharfinger.llm.running import running
from wharfinger.llm.scratch import Scratch, free_name
from wharfinger.llm.words import SLICE_BYTES, U64, mix, pair, slices, split_words, spread, texts_of, windows

PLACES, TREES, SMALL, STAR = 64, 14, 16, 3
BROADCAST_NODES = 500_000  # ids of nodes, 8 bytes each
FAR = 26  # unequal places of a sketch beyond which a pair is no candidate
UNNAMED = 1 << 62  # from here on: numbers of classes that no doc_id can name
OUTSIDE, SUBTREES, DEEPEST = 4096, 8, 43
PACK, PACK_SHINGLES, PACKS_MET, GRID = 256, 1 << 18, 16, 1 << 22  # documents and shingles of a pack, packs that meet in a group, cells of a matrix
SALTS, BROADCAST_ROWS = 16, 100_000
CHUNK = 256  # documents whose sets are sorted together; the upper 56 bits of a hash stay

_ODD = mix(np.arange(1, PLACES + 1, dtype=U64)) | U64(1)
_EVEN_BITS = U64(0x5555555555555555)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, counts, hashes) of up to CHUNK documents: sorted distinct shingles."""
    for i, j in slices(texts, SLICE_BYTES):
        for a, n, key in _sets(texts.slice(i, j - i), k):
            yield i + a, n, key


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    w = split_words(pc.ascii_lower(texts))
    h = w.hashes()
    for a in range(0, len(texts), CHUNK):
        off = w.offsets[a : a + CHUNK + 1]
        n, base = np.diff(off), off[0]
        part = h[base : off[-1]]
        start = spread(off[:-1] - base, np.maximum(n - k + 1, 0))
        keys, docs = [windows(part, k)[start]], [np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))]
        for size in range(1, k):
            if len(few := np.flatnonzero(n == size)):
                keys.append(pair(windows(part, size)[off[few] - base], np.full(len(few), size, U64)))
                docs.append(few)
        key, doc = np.concatenate(keys), np.concatenate(docs)
        key = np.sort((doc.astype(U64) << U64(56)) | (key >> U64(8)))
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        yield a, np.bincount((key >> U64(56)).astype(np.int64), minlength=len(n)), key & U64((1 << 56) - 1)


def digests(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two sums of hashes over each set."""
    full = np.flatnonzero(n)
    at, out = np.concatenate(([0], np.cumsum(n)[:-1]))[full], np.zeros((2, len(n)), U64)
    if len(full):
        y = mix(x + U64(1))
        out[0, full], out[1, full] = np.add.reduceat(y, at), np.add.reduceat(mix(y), at)
    return out.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """_row, doc_id, n_shingles, d1 and d2 (a digest of the set) and sig (its minwise tokens)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, n, x in shingle_sets(texts_of(b["text"]), k):
                full = np.flatnonzero(n)
                at = np.concatenate(([0], np.cumsum(n)[:-1]))[full]
                sig = np.zeros((len(n), PLACES), np.uint32)
                if len(full):
                    y = mix(x + U64(1))
                    for j in range(PLACES):
                        sig[full, j] = np.minimum.reduceat(y * _ODD[j], at) >> U64(32)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PLACES * 4), len(n), [None, pa.py_buffer(sig)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b["_row"].slice(a, len(n)), b["doc_id"].slice(a, len(n)), pa.array(n), *map(pa.array, digests(x, n)), raw], ["_row", "doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select("_row", "doc_id", "text").mapInArrow(work, f"_row long, doc_id {kind}, n_shingles long, d1 long, d2 long, sig binary")


def places_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, PLACES)


def sketch(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each place, in two words of 64 bits."""
    bits = mix(sig.astype(U64)) & U64(3)
    shift = (np.arange(32) * 2).astype(U64)
    return tuple(np.bitwise_or.reduce(bits[:, i : i + 32] << shift, axis=1).view(np.int64) for i in (0, 32))


def unequal(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """In how many of the 64 places two sketches differ."""
    n = np.zeros(len(a1), np.int64)
    for a, b in ((a1, b1), (a2, b2)):
        x = (a ^ b).view(U64)
        n += np.bitwise_count((x | (x >> U64(1))) & _EVEN_BITS)
    return n


def unequal_sql(a: Column, b: Column) -> Column:
    """unequal() as an expression over two structs with s1 and s2."""
    each = [F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(int(_EVEN_BITS)))) for x in (a[s].bitwiseXOR(b[s]) for s in ("s1", "s2"))]
    return each[0] + each[1]


def children(node: np.ndarray, sig: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): where each row goes from its node."""
    rows, out = [], []
    draw = mix(node ^ U64(0x5851F42D4C957F2D))
    place = [(draw & U64(63)).astype(np.int64), ((draw >> U64(6)) & U64(63)).astype(np.int64)]
    chance = (draw >> U64(12)).astype(np.float64) / 2.0**52
    for i, go in enumerate((np.ones(len(node), bool), (chance < second) & (place[0] != place[1]))):
        r = np.flatnonzero(go)
        rows.append(r)
        out.append(pair(node[r], (place[i][r].astype(U64) << U64(32)) | sig[r, place[i][r]]))
    return np.concatenate(rows), np.concatenate(out)


LEVEL = "node long, id long, s1 long, s2 long"


def descend(members: DataFrame, second: float, trees: int = 0, steps: int = 1, copies: int = 1) -> DataFrame:
    """LEVEL rows so many steps deeper. trees: members are at the roots of so many trees; copies:
    each node is the root of so many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            sig = places_of(b["sig"])
            row = np.tile(np.arange(len(b)), max(trees, 1))
            node = mix(np.repeat(np.arange(1, trees + 1, dtype=U64), len(b))) if trees else b["node"].to_numpy().view(U64)
            if copies > 1:
                row, node = np.tile(row, copies), pair(np.tile(node, copies), np.repeat(np.arange(1, copies + 1, dtype=U64), len(node)))
            for _ in range(steps):
                r, node = children(node, sig[row], second)
                row = row[r]
            s1, s2 = sketch(sig)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b["id"].take(pa.array(row)), pa.array(s1[row]), pa.array(s2[row])], ["node", "id", "s1", "s2"])

    return members.mapInArrow(work, LEVEL)


PAIRS = "a long, b long, u long"


def compare_small(rows: DataFrame) -> DataFrame:
    """PAIRS of members of one node with close sketches; nodes have SMALL members at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            node, ids, s1, s2 = (t[c].to_numpy() for c in ("node", "id", "s1", "s2"))
            old = 0 if kept is None else len(kept)
            for step in range(1, SMALL):
                i = np.flatnonzero(node[step:] == node[:-step]) if step < len(node) else np.zeros(0, np.int64)
                if not len(i):
                    break
                i = i[i + step >= old]
                u = unequal(s1[i], s2[i], s1[i + step], s2[i + step])
                i, u = i[u <= FAR], u[u <= FAR]
                x, y = ids[i], ids[i + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(u)], ["a", "b", "u"])
            kept = t.slice(max(0, len(t) - SMALL)).combine_chunks()  # its node may go on in the next batch

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(work, PAIRS).where("a < b")


class Nodes:
    """The rows of a level, parted by the size of their nodes."""

    def __init__(self, level: DataFrame, scratch: Scratch, name: str) -> None:
        self.level = scratch.save(level, name)
        self.nodes = scratch.save(self.level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select("node"), f"{name}large")
        self.n = self.nodes.count()
        self.hint = "broadcast" if self.n <= BROADCAST_NODES else "merge"

    def small(self) -> DataFrame:
        return self.level.join(self.nodes.hint(self.hint), "node", "left_anti")

    def large(self) -> DataFrame:
        return self.level.join(self.nodes.hint(self.hint), "node", "left_semi")


def salted(rows: DataFrame, each: DataFrame, key: str) -> DataFrame:
    """rows joined with one row a key, dealt by key and salt, so that no key is in one task."""
    copies = each.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def by_node(rows: DataFrame, each: DataFrame, n: int) -> DataFrame:
    """rows joined with one row a node, of n nodes at most."""
    return rows.join(F.broadcast(each), "node") if n <= BROADCAST_ROWS else salted(rows, each, "node")


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.groupBy("a", "b").agg(F.min("u").alias("u"))


def closest(pairs: DataFrame, each: str) -> DataFrame:
    """The closest pair of each id."""
    return pairs.groupBy(each).agg(F.min(F.struct("u", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def labelled(rows: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the component of an id column."""
    r = roots.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return rows.join(r, F.col(column) == F.col("_u"), "left").withColumn(name, F.coalesce("_v", column)).drop("_u", "_v")


def split_families(rows: DataFrame, n: int, outside: int) -> tuple[DataFrame, DataFrame]:
    """(family, id, label, other) of the nodes with few members outside their largest
    component, which names the family, each id once; and the rows of nodes with more. There are n nodes;
    rows (node, id, label) should be a written table: it is read once for sizes and once for each result."""
    sizes = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    nodes = sizes.groupBy("node").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).where(F.col("all") > F.col("top.n"))
    nodes = nodes.select("node", F.col("top.label").alias("family"), (F.col("all") - F.col("top.n")).alias("others"))
    open_ = by_node(rows, nodes, n)
    members = open_.where(F.col("others") <= outside).select("family", "id", "label", (F.col("label") != F.col("family")).alias("other")).distinct()
    return members, open_.where(F.col("others") > outside).select("node", "id")


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): of each outside member a link with each component of its family in which it
    has one. Members come in packs of about PACK documents or PACK_SHINGLES shingles, so a join row
    is a pair of packs; PACKS_MET packs of either side meet in a group, so no family is in one task."""
    full = members.join(sets.hint("merge"), "id").withColumn("m", F.size("set"))
    wanted = lambda who: F.greatest(F.ceil(F.count_if(who) / F.lit(PACK)), F.ceil(F.sum(F.when(who, F.col("m"))) / F.lit(PACK_SHINGLES)), F.lit(1))
    packs = full.groupBy("family").agg(wanted(F.col("other")).alias("nx"), wanted(F.lit(True)).alias("ny"))
    full = salted(full.drop("m"), packs, "family").withColumn("r", F.xxhash64("id"))
    groups = lambda n: F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / F.lit(PACKS_MET)))

    def packed(rows: DataFrame, name: str, n: str, own: str, met: str) -> DataFrame:
        """Packs with the number of their own group, repeated for each group that they meet."""
        rows = rows.groupBy("family", "nx", "ny", F.pmod("r", F.col(n)).alias("k")).agg(F.collect_list(F.struct("id", "label", "set")).alias(name))
        return rows.select("family", name, F.floor(F.col("k") / F.lit(PACKS_MET)).alias(own), F.explode(groups("ny" if n == "nx" else "nx")).alias(met))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b["x"], b["y"], strict=True):
                u, v = linked(x.values, y.values, percent)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    x, y = packed(full.where("other"), "x", "nx", "gx", "gy"), packed(full, "y", "ny", "gy", "gx")
    return x.join(y.hint("merge"), ["family", "gx", "gy"]).select("x", "y").mapInArrow(work, "u long, v long")


def linked(x: pa.StructArray, y: pa.StructArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of x and y with enough in common and other labels, one for each id of x and label of y.
    Shingles that both packs have are counted by a product of 0/1 matrices."""
    packs = []
    for p in (x, y):
        lists = p.field("set")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        packs.append((p.field("id").to_numpy(), p.field("label").to_numpy(), sizes, lists.flatten().to_numpy()))
    common = np.intersect1d(packs[0][3], packs[1][3])
    both = np.zeros((len(packs[0][0]), len(packs[1][0])), np.float64)
    step = max(1, GRID // max(1, *both.shape))
    for a in range(0, len(common), step):  # the product a range of shingles at a time
        grids = []
        for ids, _, sizes, flat in packs:
            at = np.searchsorted(part := common[a : a + step], flat)
            held = at < len(part)
            held[held] = part[at[held]] == flat[held]
            grid = np.zeros((len(ids), len(part)), np.float32)
            grid[np.repeat(np.arange(len(ids)), sizes)[held], at[held]] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    both = both.astype(np.int64)
    union = packs[0][2][:, None] + packs[1][2][None, :] - both
    i, j = np.nonzero((100 * both >= percent * union) & (packs[0][1][:, None] != packs[1][1][None, :]))
    first = np.unique(np.stack([i, packs[1][1][j]], axis=1), axis=0, return_index=True)[1] if len(i) else i
    return packs[0][0][i[first]], packs[1][0][j[first]]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")).hint("merge"), sets.select(F.col("id").alias("b"), F.col("set").alias("y")).hint("merge")
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("both")
    return both.where(F.lit(100) * F.col("both") >= F.lit(percent) * union).select(F.col("b").alias("u"), F.col("a").alias("v"))


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """n_shingles, d1, d2 and set (sorted shingle hashes) of each row, with its id if texts have
    one; rows with a digest of their own (x1, x2) are left out if their set has another."""
    keys = [c for c in ("id", "x1", "x2") if c in texts.columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, n, x in shingle_sets(texts_of(b["text"]), k):
                d, part = digests(x, n), b.slice(a, len(n))
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(x.view(np.int64)))
                out = pa.RecordBatch.from_arrays([part["id"] if keys else pa.nulls(len(n), pa.int64()), pa.array(n), pa.array(d[0]), pa.array(d[1]), lists], ["id", "n_shingles", "d1", "d2", "set"])
                yield out.filter(pa.array((d[0] == part["x1"].to_numpy()) & (d[1] == part["x2"].to_numpy()))) if keys else out

    return texts.select(*keys, "text").mapInArrow(work, "id long, n_shingles long, d1 long, d2 long, set array<long>")


SET = ["d1", "d2", "n_shingles"]


def named_classes(full: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, doc_id, sig, SET) of each distinct set, and how many have a number in place of a name. The
    least doc_id names a class; if several classes have it, that with the least digest, and the
    others, as those without any, get numbers from UNNAMED on, in order of digests."""
    classes = scratch.save(full.groupBy(*SET).agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig")), "classes")
    owners = classes.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("own")).select("own.*")
    extra = scratch.save(classes.select(*SET).join(owners.hint("merge"), SET, "left_anti"), "extra")
    n = extra.count()
    if not n:
        return classes.select(F.col("doc_id").alias("id"), "doc_id", "sig", *SET), 0
    numbers = running(extra, [F.col(c) for c in SET], scratch, "numbers").select(*SET, (F.col("before") + F.lit(UNNAMED)).alias("_number"))
    out = classes.join(numbers.hint("merge"), SET, "left").select(F.coalesce("_number", "doc_id").alias("id"), "doc_id", "sig", *SET)
    return scratch.save(out, "named"), n


def links_of_ids(full: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(u, v) between the classes of each doc_id that has several."""
    several = scratch.save(full.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("a"), F.max(F.struct(*SET)).alias("b")).where("a <> b").select("doc_id"), "several")
    if several.isEmpty():
        return None
    own = full.select("doc_id", *SET).join(several.hint("merge"), "doc_id", "left_semi").distinct()
    own = scratch.save(own.join(reps.select("id", *SET).hint("merge"), SET).select("doc_id", "id"), "owned")
    least = own.groupBy("doc_id").agg(F.min("id").alias("v"))
    return scratch.save(salted(own, least, "doc_id").where("id <> v").select(F.col("id").alias("u"), "v"), "linked_ids")


def sets_of(docs: DataFrame, needed: DataFrame, numbered: int, k: int) -> DataFrame:
    """id and set of the needed classes (id, doc_id, SET), each from a row that has its digest."""
    named = needed.where(F.col("id") < UNNAMED).select("id", F.col("d1").alias("x1"), F.col("d2").alias("x2"), F.col("id").alias("doc_id"))
    out = full_sets(docs.join(named.hint("merge"), "doc_id"), k).select("id", "set")
    if numbered:
        others = needed.where(F.col("id") >= UNNAMED)
        rows = docs.where("doc_id is null").unionByName(docs.join(others.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
        out = out.union(full_sets(rows.select("text"), k).drop("id").join(others.select("id", *SET).hint("merge"), SET).select("id", "set"))
    return out.dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, outside: int = OUTSIDE, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (it is
    the document's own) for each row of docs, whose doc_id is an integer, and _row if `row` names a
    column of numbers that tell rows apart."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    docs = docs.select(number.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession)
    signed = scratch.save(signatures(docs, k), "signed")
    full = signed.where("n_shingles > 0")
    reps, numbered = named_classes(full, scratch)
    repeats = links_of_ids(full, reps, scratch)
    second, depth, found = 100 / percent - 1, 1, []
    at = Nodes(descend(reps, second, trees), scratch, "level1")
    while True:
        found.append(compare_small(at.small()))
        if not at.n or depth == STAR:
            break
        depth += 1
        at = Nodes(descend(at.large().select("node", "id").join(reps.select("id", "sig"), "id"), second), scratch, f"level{depth}")
    pairs = [scratch.save(together(found), "pairs")]
    inside = scratch.save(at.large(), f"inside{depth}")
    for d in range(1, depth + 1):
        scratch.drop(f"level{d}")
    needed = pairs[0].select(F.explode(F.array("a", "b")).alias("id")).union(inside.select("id")).distinct()
    needed = reps.drop("sig").join(needed.hint("merge"), "id", "left_semi")
    sets = scratch.save(sets_of(docs.select("doc_id", "text"), needed, numbered, k), "sets")
    roots, tried, links, first = None, [], [], True
    while first or at.n:
        tries = pairs[-1]
        if at.n:
            one = inside.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "id").alias("r"), "id", "s1", "s2")).alias("p"))
            star = by_node(inside, one, at.n).withColumn("u", unequal_sql(F.struct("s1", "s2"), F.col("p")).cast("long"))
            star = star.where((F.col("u") <= FAR) & (F.col("id") != F.col("p.id"))).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), "u")
            pairs.append(scratch.save(star.distinct(), f"star{depth}"))
            tries = tries.union(pairs[-1])
        tried.append(scratch.save(closest(tries.union(tries.select(F.col("b").alias("a"), F.col("a").alias("b"), "u")), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"tried{depth}"))
        links.append(scratch.save(confirmed(tried[-1], sets, percent), f"links{depth}"))
        roots = components(links[-1].unionByName(repeats) if repeats else links[-1], scratch, f"root{depth}_") if roots is None else absorb(roots, links[-1], scratch, f"root{depth}_")
        first = False
        if not at.n:
            break
        labels = scratch.save(labelled(inside.select("node", "id"), roots, "id", "label"), f"labels{depth}")
        members, deeper = split_families(labels, at.n, outside if depth < DEEPEST else 1 << 62)
        links.append(scratch.save(family_links(scratch.save(members, f"family{depth}"), sets, percent), f"inner{depth}"))
        roots = absorb(roots, links[-1], scratch, f"joined{depth}_")
        at = Nodes(descend(deeper.join(reps.select("id", "sig"), "id"), second, steps=2, copies=SUBTREES if depth == STAR else 1), scratch, f"level{depth + 2}")
        scratch.drop(f"inside{depth}")
        scratch.drop(f"labels{depth}")
        depth += 2
        pairs.append(scratch.save(compare_small(at.small()), f"pairs{depth}"))
        inside = scratch.save(at.large(), f"inside{depth}")
        scratch.drop(f"level{depth}")
    every = labelled(labelled(together(pairs), roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b")
    for x in tried:
        every = every.join(x, ["a", "b"], "left_anti")
    more = scratch.save(confirmed(every, sets, percent), "more")
    roots = absorb(roots, more, scratch, "final")
    named = reps.join(roots, F.col("id") == F.col("u"), "left").select(*SET, F.coalesce("v", "id").alias("_root"), "id")
    rows = signed.select("_row", "doc_id", *SET).join(named, SET, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("_root") < UNNAMED, F.col("_root"))
    kept = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("component_id"))
    if numbered:  # of rows without doc_id one may stand for its class
        first = full.where("doc_id is null").groupBy(*SET).agg(F.min("_row").alias("_first"))
        rows = rows.join(first.select("_first"), F.col("_row") == F.col("_first"), "left")
        kept = kept.when(F.col("n_shingles") > 0, (F.col("id") == F.col("_root")) & (F.col("id") >= UNNAMED) & F.col("_first").isNotNull())
    return rows.withColumn("component_id", component).withColumn("kept", kept.otherwise(F.col("n_shingles") == 0)).select("doc_id", "n_shingles", "component_id", "kept", *(["_row"] if row else []))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are linked with a smaller doc_id. A row without a doc_id
    goes if it is linked with a document that has one, or with another such row that comes before
    it: of a component without doc_ids one row stays. Rows that share a doc_id stay or go together."""
    if docs.where("doc_id is null").isEmpty():
        gone = near_duplicates(docs.select("doc_id", "text"), k, percent).where(~F.col("kept")).select("doc_id").distinct()
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    at = free_name(docs, "_at")  # rows need names of their own
    held = Scratch(docs.sparkSession).save(docs.withColumn(at, F.monotonically_increasing_id()), "rows")
    gone = near_duplicates(held, k, percent, row=at).where(~F.col("kept")).select(F.col("_row").alias(at))
    return held.join(gone.hint("merge"), at, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
