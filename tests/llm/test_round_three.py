"""Importance resampling, repair of conversations and slots against plain versions, on odd tables too."""

import random
import zlib
from collections import Counter

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import DOCS, PASSAGE, empty, pairs, table

from wharfinger.llm import importance, mixing, repair, running, slots
from wharfinger.llm.scratch import Scratch

TURNS = "conv_id long, turn long, role string, text string"


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_importance(spark):
    docs = table(spark, clashing=True).withColumn("bucket", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("_at", F.lit(1))
    target = [PASSAGE, None, "", "the of passage1 passage2 passage3", "w1 w2 w3"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").withColumn("word", F.lit(1))
    want = brute.importance(pairs(docs), target)
    assert by_text(importance.scores(docs, goal).collect()) == by_text(want)
    drawn = importance.resample(docs, goal)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in want if r[4]}
    assert importance.scores(empty(spark), goal).count() == importance.resample(empty(spark), goal).count() == 0
    assert by_text(importance.scores(docs, goal.limit(0)).collect()) == by_text(brute.importance(pairs(docs), []))


def test_importance_of_rows_without_a_doc_id(spark, monkeypatch):
    """Half of the rows are one document without an id; ranges hold few rows, ranks have no gaps."""
    monkeypatch.setattr(running.running, "__defaults__", (None, 7))
    rows = [(None, PASSAGE)] * 60 + [(i, f"{PASSAGE} more{i % 5}") for i in range(50)] + [(3, None), (4, "")]
    got = importance.scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("more1 passage3",)], "text string")).collect()
    assert by_text(got) == by_text(brute.importance(rows, ["more1 passage3"]))
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 110 * 25 // 100 + 1))


def test_trigrams(spark):
    one = spark.createDataFrame([(1, "A b c d")], "_row long, text string")
    got = Counter(r["bucket"] for r in importance.grams(one, [], orders=3, buckets=1 << 30).collect())
    assert got == Counter(zlib.crc32(g) % (1 << 30) for g in (b"a", b"b", b"c", b"d", b"a b", b"b c", b"c d", b"a b c", b"b c d"))


def talk(seed, conversations, longest):
    rng, out = random.Random(seed), []
    say = ["Hello there.", "No end", "What?", "", " \n", "Go on!", "Yes. ", "Grüße…", "so it goes.\n"]
    for c in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user" if turn % 2 == 0 else "assistant", "system" if turn == 0 else "assistant", "tool"])
            out.append((c, turn if rng.random() < 0.95 else turn + 1, role, rng.choice(say) if rng.random() < 0.6 else f"Line {rng.random()}."))
    return out


@pytest.mark.parametrize("chunk", [1, 300, repair.CHUNK_BYTES])
def test_repair(spark, chunk):
    """Chunks of a turn each, of some turns, and of everything: the same results as brute force; one
    conversation holds half of all turns, and some copies of it nearly all texts."""
    rows = talk(1, 40, 9) + talk(2, 1, 3) + [(100, i, r, t) for i, (_, _, r, t) in enumerate(talk(3, 30, 9))]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(spark.createDataFrame(rows, TURNS), chunk).collect()}
    assert got == brute.repair(rows)
    damaged = {r["conv_id"]: tuple(r)[1:] for r in repair.damaged_report(spark.createDataFrame(rows, TURNS), chunk).collect()}
    want = brute.repair(brute.damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
    assert damaged == {c: want.get(c, nothing) for c in {r[0] for r in rows}}


def test_repair_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (7, None, "user", "One."), (7, None, "assistant", "Two."), (8, 3, "", "x"), (9, 0, "system", "Only this."), (10, 5, "user", "long word. " * 200000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("kind", F.lit("extra")).withColumn("at", F.lit("extra")).withColumn("chunk", F.lit("extra")).withColumn("_c", F.lit("extra"))
    plain = [(c, t, *(" " if x is None else x for x in (r, x))) for c, t, r, x in rows]
    for chunk in (1, 500, repair.CHUNK_BYTES):
        assert {r["conv_id"]: tuple(r)[1:] for r in repair.report(df, chunk).collect()} == brute.repair(plain)
        assert {r["conv_id"] for r in repair.damaged_report(df, chunk).collect()} == {None, 7, 8, 9, 10}
    assert repair.damaged_report(df.limit(0)).count() == repair.repaired_turns(df.limit(0)).count() == 0
    text = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "user", "Yo.")], TURNS.replace("conv_id long", "conv_id string"))
    assert [(r["audit"], r["cost"]) for r in repair.report(text, 1).collect()] == [("KR", 2)]


def test_distances_and_least_walk():
    """Every short sequence of kinds: the walk's cost is the distance, and no other audit of that cost is smaller."""
    import itertools

    for kinds in itertools.chain.from_iterable(itertools.product((0, 1, 2, 3, 5, 8), repeat=n) for n in range(4)):
        seq = bytes(kinds)
        dist = repair.distances(seq, repair.GOAL)
        letters, end = repair.walk(seq, dist, repair.START, True)
        best, todo = None, [(0, repair.START, "", 0)]
        while todo:
            i, s, done, cost = todo.pop()
            if cost > dist[0]:
                continue
            if i == len(seq) and s in (repair.START, repair.ASSISTANT) and (best is None or (cost, done) < best):
                best = (cost, done)
            for letter, to, c in (repair.OVER[seq[i]][s] if i < len(seq) else []) + [repair.INSERT[s]]:
                todo.append((i + (letter != "I"), to, done + letter, cost + c))
        assert (dist[0], letters) == best and end in (repair.START, repair.ASSISTANT)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still me."), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes.")]
    got = sorted(map(tuple, repair.repaired_turns(spark.createDataFrame(rows, TURNS), 1).collect()))
    assert [r[3:] for r in got] == [("user", "Hi."), ("assistant", ""), ("user", "Still me."), ("assistant", "Yes.")]


def plain_map(n, n_slots):
    shards = [0] * n_slots
    for k in range(1, n):
        for s in range(k):
            own = [i for i, x in enumerate(shards) if x == s]
            for i in own[n_slots // (k + 1) + (s < n_slots % (k + 1)) :]:
                shards[i] = k
    return shards


def test_slots(spark):
    docs = table(spark, clashing=True).withColumn("slot", F.lit("extra")).withColumn("_first", F.lit(1))
    shards = slots.SlotMap(spark, f"{Scratch(spark).path}/map")
    assert shards.create(8) == 1 and shards.grow() == 2 and shards.versions() == [1, 2]
    want = [plain_map(n, slots.SLOTS) for n in (8, 9)]
    assert [shards._shards(v) for v in (1, 2)] == want and Counter(want[1]).most_common()[0][1] - min(Counter(want[1]).values()) <= 1
    got = slots.placed(docs, shards, 1, 2).collect()
    texts = dict(pairs(docs))
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert (r["shard"], r["grown_shard"]) == (want[0][r["virtual_slot"]], want[1][r["virtual_slot"]]) and r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda r: (r["virtual_slot"], r["doc_id"]))
    assert slots.placed(empty(spark), shards).count() == 0


def test_slots_of_rows_without_a_doc_id(spark, monkeypatch):
    """Half of the rows are one row many times: places have no gaps; rows without an id spread by text."""
    monkeypatch.setattr(running.running, "__defaults__", (None, 9))
    rows = [(5, "same")] * 100 + [(None, f"text {i}") for i in range(60)] + [(None, None), (None, ""), (6, None)]
    shards = slots.SlotMap(spark, f"{Scratch(spark).path}/map", 64)
    shards.create(4)
    got = slots.placed(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    assert len(got) == len(rows) and len({r["shard"] for r in got if r["doc_id"] is None}) == 4 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_versions_of_a_map(spark):
    path = f"{Scratch(spark).path}/map"
    shards = slots.SlotMap(spark, path, 300)
    shards.create(3)
    loads = spark.createDataFrame([(i, 1, 1000 if i < 10 else 1 + i % 7) for i in range(300)], "slot int, records long, bytes long")
    assert shards.level(loads, slack=0.1) == 2
    load = {r["slot"]: r["bytes"] for r in loads.collect()}
    total = lambda v: [sum(load[i] for i, s in enumerate(shards._shards(v)) if s == k) for k in range(3)]
    assert max(total(2)) <= 1.1 * sum(total(2)) / 3 < max(total(1)) and sum(total(1)) == sum(total(2))
    assert spark.read.parquet(f"{path}/version=2").count() < 100  # an edit holds what it moves
    with pytest.raises(ValueError):
        shards.commit({0: 1}, 1)  # another edit was the second version
    with pytest.raises(ValueError):
        shards.at(9)
    assert shards.versions() == [1, 2] and shards.level(loads, slack=0.1) == 3 and shards._shards(2) == shards._shards(3)
    with pytest.raises(ValueError):
        slots.SlotMap(spark, path, slots.MOST_SLOTS + 1)


def test_written_shards(spark, tmp_path):
    docs = table(spark).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit("mine"))
    shards = slots.SlotMap(spark, f"{Scratch(spark).path}/map")
    shards.create(5)
    name = slots.write_shards(docs, shards, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and by_text(back.select(*docs.columns).collect()) == by_text(docs.collect())
    at = {r["doc_id"]: r["shard"] for r in slots.placed(docs, shards).collect()}
    assert {r["doc_id"]: r[name] for r in back.collect()} == at
    loads = slots.slot_loads(docs).agg(F.sum("records"), F.sum("bytes")).first()
    assert tuple(loads) == (docs.count(), sum(len((t or "").encode()) + 1 for _, t in pairs(docs)))


def test_sizes_of_the_tables(spark):
    """Law of the key: 8 shards of sf0.001 all have rows, and a ninth takes about its part."""
    from wharfinger.llm import queries

    got = queries.op13_slots(spark, SF).collect()
    assert {r["law"] for r in got} == {"key"} and len({r["shard"] for r in got}) == 8
    assert 0 < sum(r["grown_shard"] == 8 for r in got) < len(got) / 4
    assert DOCS.startswith("doc_id")


def test_mixing_of_rows_without_a_doc_id(spark):
    """Half of the rows have no doc_id: they spread over the buckets by text, and in any order of rows the same words are taken."""
    rows = [(None, f"w{i} x y", "a") for i in range(60)] + [(i, f"v{i} x y", "a") for i in range(50)] + [(7, "one two three", "b"), (7, "four five six", "b"), (8, "z", "b")]
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string")
        mixed = mixing.mix_documents(df, share=0.5, bucket_rows=10)
        got.append(by_text(mixed.select("doc_id", "text").collect()))
    assert got[0] == got[1]
    taken = sum(len(t.split()) for d, t in got[0] if d is None)
    assert 0 < taken < 180  # one key for all would take all of them or nearly none
    keys = spark.createDataFrame(rows, "doc_id long, text string, source string").where("doc_id is null").select(mixing.random_key(F.col("doc_id"), F.col("text")).alias("k"))
    assert keys.distinct().count() == 60
