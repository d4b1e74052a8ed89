"""Queries over the training-data tables, and SQL with the same rows where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfinger.llm import chat, decontam, importance, licence, mixing, neardup, quality, repair, rollup, slots, substring, token_files, toxicity
from wharfinger.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.resolve(licence.as_files(table(spark, sf_dir, "documents")))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, one of them sent twice: all documents come in by words; those whose text
    an earlier row has (by doc_id, null last) go out again; the others are counted by pieces too; the word
    counts of those with repeated lines are revised to count each line once."""
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    once = F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
    pieces = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(text, 256).alias("digest"), mixing.word_count(text).alias("words"), mixing.word_count(once).alias("once"), pieces.alias("pieces"))
    docs = scratch.save(docs.withColumn("row", F.monotonically_increasing_id()), "counts")
    first = docs.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("f")).select(F.col("f.row").alias("row"), F.lit(False).alias("copy"))
    docs = scratch.save(docs.join(first, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(True))).drop("digest", "row"), "marked")
    by_words, by_pieces = docs.withColumn("tokenizer", F.lit("words-1")), docs.withColumn("tokenizer", F.lit("pieces-1"))
    totals = rollup.Rollup(spark, f"{scratch.path}/totals")
    totals.commit("1", rollup.signed(by_words, new="words"))
    for _ in range(2):
        totals.commit("2", rollup.signed(by_words.where("copy"), old="words"))
    totals.commit("3", rollup.signed(by_pieces.where("not copy"), new="pieces"))
    totals.commit("4", rollup.signed(by_words.where("not copy and once <> words"), old="words", new="once"))
    return totals.totals()


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).drop("source")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.cut(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).path}/tokens"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, word_tokenizer(), end_id=1, by_word=True)
    return token_files.read_tokens(spark, path, ids=False)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_report(table(spark, sf_dir, "conversations"))


def op13_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of 8 shards and its next version, with 9: the law is that of the key."""
    shards = slots.SlotMap(spark, f"{Scratch(spark).path}/map")
    now = shards.create(8)
    rows = slots.placed(table(spark, sf_dir, "documents"), shards, now, later=shards.grow())
    return rows.withColumn("law", F.lit("key"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_licence_scan, op2_token_rollup, op3_mix_sources, op4_substring_dedup, op5_chat, op6_near_duplicates, op7_decontaminate, op8_toxicity, op9_quality_rules, op10_token_files, op11_importance, op12_repair, op13_slots)
}

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))))[1:15])::BIGINT AS k
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM totals),
leveled AS (
  SELECT a.*, a.cap / a.weight AS ratio,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM ranked)
            - coalesce((SELECT sum(b.cap) FROM ranked b WHERE b.cap / b.weight < a.cap / a.weight), 0))
         / (SELECT sum(b.weight) FROM ranked b WHERE b.cap / b.weight >= a.cap / a.weight) AS level
  FROM ranked a),
goals AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * (SELECT max(level) FROM leveled WHERE level <= ratio), cap)) AS target
  FROM leveled),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
          + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
FROM run
"""

OP7 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
placed AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, placed.n, item_id FROM placed JOIN win ON placed.k = win.k AND placed.n = win.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM dw WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM inter JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS d, b AS r FROM two UNION SELECT d, two.b FROM reach JOIN two ON two.a = reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id, coalesce(m, doc_id) >= doc_id AS kept
FROM dw LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(r) AS m FROM reach GROUP BY d) USING (doc_id)
"""

OP4 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM dw WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [x FOR x, j IN w IF NOT list_contains(ps, j)] END, ' ')) AS kept_sha256
FROM dw LEFT JOIN lists USING (doc_id)
"""

OP1 = r"""
WITH files AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), (doc_id // 4096)::VARCHAR, (doc_id // 256)::VARCHAR, (doc_id // 16)::VARCHAR) AS dir
  FROM documents),
lines AS (SELECT doc_id, dir, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)licen[cs]e|copyright|all rights reserved|spdx-')), chr(10)) AS header FROM files),
found AS (SELECT * FROM lines WHERE header <> ''),
known(licence, header) AS (VALUES
TEMPLATE_ROWS),
units AS (SELECT 'd' || doc_id AS u, NULL AS licence, header FROM found UNION ALL SELECT 't' || licence, licence, header FROM known),
tf AS (
  SELECT u, licence, w, count(*) AS tf FROM (SELECT u, licence, unnest(regexp_extract_all(lower(header), '[a-z0-9.\-]+')) AS w FROM units) GROUP BY ALL),
idf AS (SELECT w, ln((1.0::DOUBLE + (SELECT count(*) FROM units)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY w),
v AS (SELECT u, licence, w, tf * idf AS x FROM tf JOIN idf USING (w)),
norm AS (SELECT u, sqrt(sum(x * x)) AS n FROM v GROUP BY u),
cosine AS (
  SELECT a.u, b.licence, round(sum(a.x * b.x) / (any_value(p.n) * any_value(q.n)), 6) AS score
  FROM v a JOIN v b ON a.w = b.w AND a.licence IS NULL AND b.licence IS NOT NULL
  JOIN norm p ON p.u = a.u JOIN norm q ON q.u = b.u GROUP BY a.u, b.licence),
own AS (
  SELECT doc_id, dir, licence, score
  FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, licence) AS r FROM cosine) c JOIN found ON c.u = 'd' || doc_id
  WHERE r = 1 AND score >= 0.6),
given AS (
  SELECT dir AS up, licence AS dir_licence FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, doc_id, licence) AS r FROM own) WHERE r = 1),
nearest AS (
  SELECT d.dir, max_by(up, length(up)) AS origin, max_by(dir_licence, length(up)) AS dir_licence
  FROM (SELECT DISTINCT dir FROM files) d JOIN given ON d.dir = up OR starts_with(d.dir, up || '/') GROUP BY d.dir)
SELECT f.doc_id, f.dir || '/' || f.doc_id AS path, o.licence AS own, o.score, coalesce(o.licence, n.dir_licence) AS licence,
       CASE WHEN o.licence IS NULL THEN n.origin END AS origin
FROM files f LEFT JOIN own o ON o.doc_id = f.doc_id LEFT JOIN nearest n ON n.dir = f.dir
""".replace("TEMPLATE_ROWS", ",\n".join(f"  ('{k}', '{v}')" for k, v in sorted(licence.TEMPLATES.items())))

OP2 = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS t FROM documents
  QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS LAST) = 1),
once AS (
  SELECT source, lang, t, array_to_string(list_filter(string_split(t, chr(10)), lambda x, i: list_position(string_split(t, chr(10)), x) = i), chr(10)) AS o FROM d),
n AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(o, '[^\x20\x09-\x0D]+')) AS tokens FROM once
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) FROM once)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(tokens)::BIGINT AS n_tokens FROM n GROUP BY ALL
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS l,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
  FROM t GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, n_turns, count(*)::BIGINT AS n_equal, l, any_value(chat) AS chat FROM c GROUP BY n_turns, l)
SELECT conv_id, n_turns, n_equal, chat FROM one
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_turns > one.n_turns AND c.l[1:one.n_turns] = one.l)
"""

#: (bytes in hexadecimal) -> their crc32, for texts that FIELD names; the table comes from the polynomial.
CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(FIELD)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c >> 8, crc_table.rest[xor(c & 255, b) + 1]))"""
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS rest)"""


def crc_sql(field: str) -> str:
    return f"xor({CRC.replace('FIELD', field)}, 4294967295)"


OP11 = rf"""
WITH {CRC_TABLE},
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
dw AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
flat AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM dw),
bucket AS (SELECT g, {crc_sql("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM flat), crc_table),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM flat JOIN bucket USING (g) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
mean AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM flat JOIN bucket USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) >= 20 AS fit,
         ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM dw LEFT JOIN mean USING (r) WHERE side = 'd'),
full_score AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored),
placed AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST, n_features, weight) AS p FROM full_score)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= (SELECT count(*) FROM scored WHERE fit) * 25 // 100 THEN p END::BIGINT AS rank FROM placed
"""


def _grown_sql(n: int, slots: int) -> str:
    """The map of n + 1 shards from that of n."""
    return f"""m{n + 1} AS (
  SELECT slot, CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY slot) > {slots} // {n + 1} + (shard < {slots} % {n + 1})::INT THEN {n} ELSE shard END AS shard FROM m{n})"""


OP13 = f"""
WITH {CRC_TABLE},
m1 AS (SELECT i::INT AS slot, 0 AS shard FROM range(4096) t(i)),
{", ".join(_grown_sql(n, 4096) for n in range(1, 9))},
sized AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {crc_sql("coalesce(text, '')")}::BIGINT AS text_crc32,
         (('0x' || md5('slot:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))))[1:15])::BIGINT % 4096)::INT AS virtual_slot
  FROM documents, crc_table)
SELECT doc_id, size, text_crc32, virtual_slot, m8.shard::INT AS shard, m9.shard::INT AS grown_shard, 'key' AS law,
       row_number() OVER (PARTITION BY m8.shard ORDER BY virtual_slot, doc_id NULLS LAST, text_crc32, size) - 1 AS slot
FROM sized JOIN m8 ON m8.slot = virtual_slot JOIN m9 ON m9.slot = virtual_slot
"""

SPACED = "[^\\x20\\x09-\\x0D]"


def _over(state: int) -> str:
    """The least (cost in nine digits, then letters) in a state after one more turn, or after an insert for 'i'."""
    add = lambda s, cost, letter: f"printf('%09d', d{s}[1:9]::INT + {cost}) || d{s}[10:] || '{letter}'"
    ways = [add(state, 3, "D")]
    keeps = {1: [("s", 0)], 2: [("u", 0), ("u", 1), ("u", 3)], 3: [("a", 2)]}.get(state, [])
    ways += [f"CASE WHEN NOT gone AND initial = '{i}' THEN {add(s, 'more', 'K')} END" for i, s in keeps]
    ways += [f"CASE WHEN NOT gone THEN {add(s, '2 + more', 'R')} END" for s in {2: (0, 1, 3), 3: (2,)}.get(state, ())]
    return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]


_INSERTED = """SELECT conv_id, i, d0, d1, e2 AS d2, least(d3, printf('%09d', e2[1:9]::INT + 2) || e2[10:] || 'I') AS d3
    FROM (SELECT *, least(d2, printf('%09d', d0[1:9]::INT + 2) || d0[10:] || 'I', printf('%09d', d1[1:9]::INT + 2) || d1[10:] || 'I', printf('%09d', d3[1:9]::INT + 2) || d3[10:] || 'I') AS e2 FROM ("""

OP12 = rf"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p, NOT regexp_matches(text, '{SPACED}') AS blank FROM damaged),
faults AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS twice, role[1] AS initial,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) AS earlier,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM placed),
turns AS (SELECT *, blank OR twice AS gone, (NOT blank AND NOT twice AND cut)::INT AS more FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(twice) AS duplicate, sum(more) AS truncated,
         count_if(earlier IS NOT NULL AND (earlier || initial) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id),
steps AS (
  {_INSERTED}SELECT conv_id, 0::BIGINT AS i, '000000000' AS d0, '900000000' AS d1, '900000000' AS d2, '900000000' AS d3 FROM counts))
  UNION ALL
  {_INSERTED}SELECT s.conv_id, p AS i, {_over(0)} AS d0, {_over(1)} AS d1, {_over(2)} AS d2, {_over(3)} AS d3
    FROM steps s JOIN turns t ON t.conv_id = s.conv_id AND t.p = s.i + 1))),
best AS (SELECT s.conv_id, least(d0, d3)[1:9]::BIGINT AS cost, least(d0, d3)[10:] AS audit FROM steps s JOIN counts c ON c.conv_id = s.conv_id AND c.n = s.i),
letters AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j, audit[j] AS letter FROM best),
at_turn AS (
  SELECT *, CASE WHEN letter <> 'I' THEN count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) END AS p, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS k FROM letters),
lined AS (
  SELECT a.conv_id, j, letter, k, role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text,
         max((letter = 'K' AND k = 1 AND initial = 's')::INT) OVER (PARTITION BY a.conv_id) AS led
  FROM at_turn a LEFT JOIN turns t ON t.conv_id = a.conv_id AND t.p = a.p WHERE letter <> 'D'),
joined AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole FROM lined GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id = coalesce(o.conv_id::VARCHAR, ' ') LEFT JOIN best b ON b.conv_id = c.conv_id LEFT JOIN joined x ON x.conv_id = c.conv_id
"""

ORACLES: dict[str, str] = {"op1_licence_scan": OP1, "op2_token_rollup": OP2, "op5_chat": OP5, "op3_mix_sources": OP3, "op4_substring_dedup": OP4, "op6_near_duplicates": OP6, "op7_decontaminate": OP7, "op11_importance": OP11, "op12_repair": OP12, "op13_slots": OP13}
