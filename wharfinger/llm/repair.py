"""Repair of conversations by the cheapest edits that make roles alternate.

A conversation's turns and the four states of the pattern (system)? (user assistant)* (at the start,
after system, after user, after assistant) are the nodes of a graph: Keep, Rerole and Delete go on
by one turn, Insert changes the state alone. Costs are integers of at most 3, so distances
to the end come from buckets of nodes by distance, taken in turn (Dial's queue); then, from
the first node, the least letter whose arc is tight is followed, which gives the least of the cheapest
audits.

No conversation is one task's: turns are ordered by ranges and cut into chunks by bytes. Of a
conversation over several chunks each gives its least costs from state to state; these are combined from the end,
which gives each chunk the distances after it; each chunk walks from all four states; the walks
are combined from the start, and each chunk walks once more from its own state. Only one letter a turn
and, for the digest, one stream of texts come together.

Defined results: a null role or text is one space (so the text is blank), a null conv_id is a
conversation, a null turn comes first; turns that share a number are ordered by role and a digest of
the text; repeated rows are duplicates; roles count by their first character; texts of any length are
whole; a conversation with no rows left has zeros and empty strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfinger.llm.running import running
from wharfinger.llm.scratch import Scratch

CHUNK_BYTES = 1 << 20
ROW_BYTES = 64  # that a turn counts besides its role and text
SPACES = " \t\n\x0b\f\r"

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
GOAL = (0, FAR, FAR, 0)
KEEP, TRUNCATED, GONE = 0, 4, 8  # a turn's kind: the place of its initial in "sua" (3: another), and TRUNCATED; or GONE
_AFTER_KEEP = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _arcs(kind: int) -> list[list[tuple[str, int, int]]]:
    """(letter, next state, cost) out of each state over a turn of this kind, in order of letters."""
    out = []
    for s in range(4):
        arcs = [("D", s, 3)]
        if kind < GONE:
            more = int(kind >= TRUNCATED)
            if s in _AFTER_KEEP[kind % 4]:
                arcs.append(("K", _AFTER_KEEP[kind % 4][s], more))
            arcs.append(("R", _NEXT[s], 2 + more))
        out.append(arcs)
    return out


OVER = [_arcs(k) for k in range(GONE + 1)]
INSERT = [("I", _NEXT[s], 2) for s in range(4)]
OUT = [[sorted([*over[s], INSERT[s]]) for s in range(4)] for over in [*OVER, [[]] * 4]]  # the last: after all turns
_BACK = [[[(s, cost) for s in range(4) for _, to, cost in arcs[s] if to == t] for t in range(4)] for arcs in OVER]
_BACK_INSERT = [[(s, 2) for s in range(4) if _NEXT[s] == t] for t in range(4)]


def distances(kinds: bytes, ends) -> list[int]:
    """Least costs from each node (4 * turns before it + state) on, where ends are those of the four
    states after the last turn."""
    n = len(kinds)
    dist = [FAR] * (4 * n + 4)
    low = min(ends)
    buckets: list[list[int]] = [[] for _ in range(max((e for e in ends if e < FAR), default=low) - low + 4)]
    for s, e in enumerate(ends):
        if e < FAR:
            dist[4 * n + s] = e
            buckets[e - low].append(4 * n + s)
    d = 0
    while d < len(buckets):
        for v in buckets[d]:  # grows by arcs that cost nothing
            if dist[v] != d + low:
                continue
            i, s = v >> 2, v & 3
            before = [(4 * i + p, c) for p, c in _BACK_INSERT[s]]
            if i:
                before += [(4 * i - 4 + p, c) for p, c in _BACK[kinds[i - 1]][s]]
            for u, c in before:
                if d + low + c < dist[u]:
                    dist[u] = d + low + c
                    while d + c >= len(buckets):
                        buckets.append([])
                    buckets[d + c].append(u)
        buckets[d] = []
        d += 1
    return dist


def walk(kinds: bytes, dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """The letters of the least tight path from a state before the first turn to the end, and the
    state there; inserts after the last turn are the next chunk's, if there is one."""
    i, letters, n = 0, [], len(kinds)
    while i < n or (last and dist[4 * i + state]):
        here = dist[4 * i + state]
        for letter, to, cost in OUT[kinds[i] if i < n else -1][state]:
            if dist[4 * (i + (letter != "I")) + to] + cost == here:
                break
        letters.append(letter)
        state = to
        i += letter != "I"
    return "".join(letters), state


def repaired(letters: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) of the turns after the edits."""
    out, i = [], 0
    for letter in letters:
        if letter == "D":
            i += 1
            continue
        state = SYSTEM if letter == "K" and state == START and roles[i][:1] == "s" else _NEXT[state]
        role = roles[i] if letter == "K" else "user" if state == USER else "assistant"
        out.append((role, "" if letter == "I" else texts[i]))
        i += letter != "I"
    return out


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the crc32 of conv_id:turn draws."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), draw.alias("_draw")).where("_draw <> 0")
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def kind_of(role: Column, text: Column) -> Column:
    """A turn's kind by itself: GONE if blank."""
    ended = F.rtrim(text, F.lit(SPACES))
    initial = F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)
    return F.when(ended == "", GONE).otherwise(initial + F.when(F.right(ended, F.lit(1)).isin(".", "!", "?"), KEEP).otherwise(TRUNCATED)).cast("tinyint")


def ordered(turns: DataFrame, scratch: Scratch, chunk_bytes: int) -> DataFrame:
    """turns with digest, kind, at (its place, rising) and chunk."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    size = F.octet_length("role") + F.octet_length("text") + F.lit(ROW_BYTES)
    rows = rows.select("*", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), kind_of(F.col("role"), F.col("text")).alias("kind"), size.cast("long").alias("size"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("_row")]
    run = running(scratch.save(rows, "turns"), order, scratch, "ordered", weight="size")
    return scratch.save(run.select("conv_id", "turn", "role", "text", "digest", "kind", F.col("before").alias("at"), F.floor(F.col("before") / F.lit(chunk_bytes)).cast("long").alias("chunk")), "chunks")


def _segments(t: pa.Table) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one conversation; rows are in order."""
    ids, a = t["conv_id"].to_pylist(), 0
    for b in range(1, len(ids) + 1):
        if b == len(ids) or ids[b] != ids[a]:
            yield a, b
            a = b


def _outer(rows: DataFrame) -> DataFrame:
    """Of each chunk the first and the last conversation, which may go on beyond it: conv_id,
    chunk, at (of its first turn), kinds (a byte a turn), and moves (least costs from state to state)."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        found = list(_segments(t))
        found = found[:1] + found[1:][-1:]
        kinds, at, chunk = t["kind"].to_pylist(), t["at"].to_pylist(), key[0].as_py()
        out = []
        for a, b in found:
            seq = bytes(kinds[a:b])
            to = [distances(seq, [0 if s == e else FAR for s in range(4)])[:4] for e in range(4)]
            out.append((chunk, at[a], seq, [to[e][s] for s in range(4) for e in range(4)]))
        ids = t["conv_id"].combine_chunks().take(pa.array([a for a, _ in found], pa.int64()))
        return pa.table([ids, *(pa.array(c, x) for c, x in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))], ["conv_id", "chunk", "at", "kinds", "moves"])

    return rows.groupBy("chunk").applyInArrow(work, f"conv_id {_type(rows)}, chunk long, at long, kinds binary, moves array<long>")


def _type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _ends(outer: DataFrame) -> DataFrame:
    """at, ends (least costs of what follows a chunk, by state), last and pieces: from the last chunk of a
    conversation backwards, a row a chunk."""

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("at", "descending")])
        goal, rows = [distances(b"", GOAL)[s] for s in range(4)], []
        ends = goal
        for k, moves in enumerate(t["moves"].to_pylist()):
            rows.append((ends, k == 0))
            ends = [min(moves[4 * s + e] + ends[e] for e in range(4)) for s in range(4)]
        return pa.table([t["at"].combine_chunks(), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows]), pa.array([len(rows)] * len(rows), pa.int64())], ["at", "ends", "last", "pieces"])

    return outer.select("conv_id", "at", "moves").groupBy("conv_id").applyInArrow(work, "at long, ends array<long>, last boolean, pieces long")


def _exits(outer: DataFrame) -> DataFrame:
    """outer with exits: the state after a chunk for each state before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kinds, ends, last in zip(b["kinds"].to_pylist(), b["ends"].to_pylist(), b["last"].to_pylist()):
                dist = distances(kinds, GOAL if last else ends)
                out.append([walk(kinds, dist, s, last)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["at"], pa.array(out, pa.list_(pa.int64()))], ["conv_id", "at", "exits"])

    return outer.select("conv_id", "at", "kinds", "ends", "last").mapInArrow(work, f"conv_id {_type(outer)}, at long, exits array<long>")


def _entries(exits: DataFrame) -> DataFrame:
    """at and entry: the state before each chunk."""

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        state, out = START, []
        for e in t["exits"].to_pylist():
            out.append(state)
            state = e[state]
        return pa.table([t["at"].combine_chunks(), pa.array(out, pa.int64())], ["at", "entry"])

    return exits.groupBy("conv_id").applyInArrow(work, "at long, entry long")


MARKS = "chunk long, at long, ends array<long>, last boolean, pieces long, entry long"
PIECES = "chunk long, pieces long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, turns array<struct<role:string,text:string>>"
LEGAL = {"su", "ua", "au"}


def _pieces(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Each conversation's part in each chunk, repaired. marks: the turns that are duplicates (entry is
    null) and the state and distances around the outer parts of chunks."""

    def work(key: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        given = {x["at"]: x for x in m.to_pylist() if x["entry"] is not None}
        again = {x["at"] for x in m.to_pylist() if x["entry"] is None}
        kinds, at, roles, texts = (t[c].to_pylist() for c in ("kind", "at", "role", "text"))
        found, out = list(_segments(t)), []
        for a, b in found:
            blank = sum(k == GONE for k in kinds[a:b])
            twice = sum(at[i] in again and kinds[i] != GONE for i in range(a, b))
            seq = bytes(GONE if at[i] in again else kinds[i] for i in range(a, b))
            mark = given.get(at[a]) or {"ends": GOAL, "last": True, "pieces": 1, "entry": START}
            dist = distances(seq, GOAL if mark["last"] else mark["ends"])
            letters, to = walk(seq, dist, mark["entry"], mark["last"])
            cost = dist[mark["entry"]] - (0 if mark["last"] else dist[4 * len(seq) + to])
            initials = [r[:1] for r in roles[a:b]]
            illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
            turns = [{"role": r, "text": x} for r, x in repaired(letters, mark["entry"], roles[a:b], texts[a:b])]
            out.append((key[0].as_py(), mark["pieces"], blank, twice, sum(TRUNCATED <= k < GONE for k in seq), illegal, initials[0], initials[-1], cost, letters, turns))
        ids = t["conv_id"].combine_chunks().take(pa.array([a for a, _ in found], pa.int64()))
        types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        columns = zip(*out) if out else [[]] * len(types)
        names = ["chunk", "pieces", "blank", "duplicate", "truncated", "illegal", "first", "last", "cost", "audit", "turns"]
        return pa.table([ids, *(pa.array(c, x) for c, x in zip(columns, types))], ["conv_id", *names])

    return rows.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(work, f"conv_id {_type(rows)}, {PIECES}")


def repair(turns: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(pieces, gaps): the parts of conversations by chunk, in order of conv_id and chunk, with
    faults, audit and turns after repair; and the missing turn numbers of each conversation."""
    scratch = Scratch(turns.sparkSession)
    rows = ordered(turns, scratch, chunk_bytes)
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at")
    again = scratch.save(rows.select("conv_id", "chunk", "at").join(firsts, "at", "left_anti"), "again")
    gone = again.select("at", F.lit(GONE).cast("tinyint").alias("_gone"))
    slim = rows.select("conv_id", "chunk", "at", "kind").join(gone, "at", "left").withColumn("kind", F.coalesce("_gone", "kind")).drop("_gone")
    outer = scratch.save(_outer(slim), "outer")
    outer = scratch.save(outer.join(scratch.save(_ends(outer), "ends"), "at"), "joined")
    entries = _entries(scratch.save(_exits(outer), "exits"))
    marks = outer.select("chunk", "at", "ends", "last", "pieces").join(entries, "at").select("chunk", "at", "ends", "last", "pieces", "entry")
    marks = marks.union(again.select("chunk", "at", F.lit(None).cast("array<long>"), F.lit(None).cast("boolean"), F.lit(None).cast("long"), F.lit(None).cast("long")))
    pieces = scratch.save(_pieces(rows, marks), "pieces")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    return pieces, rows.groupBy("conv_id").agg(gaps.alias("gaps"))


def repaired_turns(turns: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """conv_id, chunk, place (in the chunk), role and text of the repaired conversations' turns."""
    pieces, _ = repair(turns, chunk_bytes)
    return pieces.select("conv_id", "chunk", F.posexplode("turns").alias("place", "_turn")).select("conv_id", "chunk", "place", "_turn.role", "_turn.text")


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def report(turns: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of
    each conversation with rows."""
    pieces, gaps = repair(turns, chunk_bytes)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    whole = pieces.where("pieces = 1").select("conv_id", *COUNTS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    cut = pieces.where("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the conversation that is being read: id, counts, letters, digest, initial of the last turn, lines so far
        for b in batches:
            for r in b.to_pylist():
                if held and held[0] != r["conv_id"]:
                    yield close(held)
                    held = None
                if held is None:
                    held = [r["conv_id"], [0] * len(COUNTS), [], hashlib.sha256(), None, False]
                elif held[4] + r["first"] not in LEGAL:
                    held[1][3] += 1
                held[1] = [x + r[c] for x, c in zip(held[1], COUNTS)]
                held[2].append(r["audit"])
                for x in r["turns"]:
                    held[3].update(("\n" * held[5] + f"{x['role']}:{x['text']}").encode())
                    held[5] = True
                held[4] = r["last"]
        if held:
            yield close(held)

    kind = cut.schema["conv_id"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def close(h: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[0]], arrow), *(pa.array([x], pa.int64()) for x in h[1]), pa.array(["".join(h[2])]), pa.array([h[3].hexdigest()])], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    long = cut.mapInArrow(work, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
    out = whole.union(long).alias("w").join(gaps.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return out.select("conv_id", "gaps", *COUNTS, "audit", "repaired_sha256")


def damaged_report(turns: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """report() of the damaged turns, with a row for each conversation before the damage."""
    every = turns.select(F.col("conv_id").alias("_c")).distinct()
    out = every.join(report(damage(turns), chunk_bytes), F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_c").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS)), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
