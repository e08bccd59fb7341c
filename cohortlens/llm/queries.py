"""Registered queries of this subpackage, with the SQL each must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, chat, collocations, decontaminate, exact_dedup, langid, license_scan, line_dedup, sharding, simhash, topk, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register ``fn(table)`` over one whole table."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            SQL[name] = sql
        return fn
    return wrap


@query("op1_chat_format", "conversations", r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS LAST, role, text) AS turns FROM t GROUP BY conv_id),
prefixes AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM c, LATERAL (SELECT unnest(range(1, len(turns))) AS k)),
reps AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns),
kept AS (SELECT * FROM reps ANTI JOIN prefixes USING (turns)),
placed AS (SELECT conv_id, len(turns) AS n_turns, n_copies, unnest(turns) AS x, unnest(range(len(turns))) AS p FROM kept)
SELECT conv_id, p // 64 AS part, n_turns, n_copies,
       string_agg('<|im_start|>' || replace(x.role, '<|', '< |') || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY p) AS text
FROM placed GROUP BY ALL""")
def op1(conversations: DataFrame) -> DataFrame:
    return chat.format_chats(conversations)


@query("op2_jump_shards", "documents", r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(n::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
d AS (SELECT doc_id, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::UHUGEINT AS key FROM documents),
bytes AS (SELECT doc_id, key, hex(text) AS h FROM d),
sums AS (SELECT doc_id, key, length(h) // 2 + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table),
jumps AS (
  SELECT key AS k0, key, n, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT key FROM d), (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT k0, k1, n, j, floor((j + 1) * (2147483648::DOUBLE / ((k1 // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k1 FROM jumps WHERE j < n)),
found AS (SELECT k0, max(b) FILTER (n = 16) AS shard, max(b) FILTER (n = 17) AS grown_shard FROM jumps GROUP BY k0)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM sums JOIN found ON key = k0""")
def op2(documents: DataFrame) -> DataFrame:
    return sharding.shard_documents(documents, 16)


DECONTAMINATION_SQL = r"""
WITH cut(kind, id, w) AS (
  SELECT 'doc', doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM documents
  UNION ALL
  SELECT 'item', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
parts AS (SELECT DISTINCT kind, id, unnest(list_transform(range(greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM cut),
sizes AS (SELECT id, count(*) AS n_item FROM parts WHERE kind = 'item' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*)::DOUBLE / any_value(n_item) AS containment
FROM parts d JOIN parts i ON d.s = i.s AND d.kind = 'doc' AND i.kind = 'item' JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= (0.8 - 1e-9) * any_value(n_item)"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return decontaminate.find_items(read("documents"), read("benchmark")).drop("_t")


QUERIES["op3_decontamination"], SQL["op3_decontamination"] = op3, DECONTAMINATION_SQL


@query("op4_exact_dedup", "documents", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, first_value(n) OVER g AS keep_n, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = keep_n AS kept, text_sha256 FROM w""")
def op4(documents: DataFrame) -> DataFrame:
    return exact_dedup.exact_dedup(documents)


@query("op5_line_dedup", "documents", r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
blank AS (SELECT doc_id, line, i, regexp_matches(line, '[^\x20\x09-\x0D]') AS ink FROM raw),
numbered AS (SELECT *, greatest(sum(ink::INT) OVER (PARTITION BY doc_id ORDER BY i), 1) - 1 AS n FROM blank),
unit AS (SELECT doc_id, n, string_agg(line, chr(10) ORDER BY i) AS line FROM numbered GROUP BY ALL),
lines AS (SELECT doc_id, n, line, trim(line, E' \t\n\x0b\x0c\r') AS t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM unit),
runs AS (SELECT a.doc_id, a.n, b.n AS e, string_agg(c.t, chr(0) ORDER BY c.n) AS content, sum(c.w) AS w, first(a.w) AS wa, arg_max(c.w, c.n) AS wb
         FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + 4
         JOIN lines c ON c.doc_id = a.doc_id AND c.n BETWEEN a.n AND b.n WHERE a.w > 0 GROUP BY 1, 2, 3),
short AS (SELECT * FROM runs WHERE w >= 5 AND (w - wa < 5 OR w - wb < 5)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, n) AS k FROM short) WHERE k > 1),
gone AS (SELECT DISTINCT l.doc_id, l.n FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.n BETWEEN r.n AND r.e)
SELECT l.doc_id, count(*) FILTER (l.w > 0) AS n_lines, count(g.n) AS n_deleted,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL), '')) AS text_md5
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id""")
def op5(documents: DataFrame) -> DataFrame:
    return line_dedup.delete_repeated(documents).select(
        "row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.md5("text").alias("text_md5"))


@query("op6_simhash", "documents")
def op6(documents: DataFrame) -> DataFrame:
    return simhash.near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_bpe_trie", "documents")
def op7(documents: DataFrame) -> DataFrame:
    encoded = bpe.encode(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_warc", "pages", r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN lead IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN lead IS DISTINCT FROM page_id THEN lead END AS refers_to FROM m""")
def op8(pages: DataFrame) -> DataFrame:
    return warc.round_trip(pages).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


@query("op9_language_id", "documents")
def op9(documents: DataFrame) -> DataFrame:
    out = langid.held_out(F.col("doc_id"))
    return langid.predict(documents, langid.fit(documents.where(~out))).select(
        "row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def _license_sql() -> str:
    known = [f"('{name}', '{label}', {str(phrase).lower()}, {len(w) - 2}, {q}, '{' '.join(w[q:q + 3])}')"
             for name, label, phrase, w in license_scan.templates() for q in range(len(w) - 2)]
    return rf"""
WITH known(template, label, phrase, grams, q, gram) AS (VALUES {', '.join(known)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 2)) AS p, unnest(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS words FROM d WHERE len(w) > 2),
hits AS (SELECT doc_id, p, k.* FROM g JOIN known k ON words = gram),
lines AS (SELECT doc_id, template, label, phrase, grams, p - q AS diagonal, bit_or(1::BIGINT << q) AS mask, min(p) AS lo, max(p) AS hi FROM hits GROUP BY ALL),
exact AS (SELECT doc_id, label, phrase, lo, 1.0::DOUBLE AS score FROM lines WHERE phrase AND bit_count(mask) = grams),
steps AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > 4 OR lo - lag(hi) OVER o > grams, true) AS new
          FROM lines WHERE NOT phrase WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
parts AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM steps),
merged AS (SELECT doc_id, template, label, phrase, grams, part, bit_or(mask) AS mask, min(lo) AS lo, max(hi) AS hi FROM parts GROUP BY ALL),
near AS (SELECT doc_id, label, phrase, lo, bit_count(mask)::DOUBLE / grams AS score FROM merged
         WHERE bit_count(mask)::DOUBLE / grams >= 0.8 AND hi - lo + 3 <= 2 * (grams + 2)),
found AS (SELECT * FROM exact UNION ALL SELECT * FROM near),
per AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(lo) FILTER (phrase) AS first_word, max(lo) FILTER (phrase) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
        FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""


@query("op10_license_scan", "documents", _license_sql())
def op10(documents: DataFrame) -> DataFrame:
    return license_scan.scan_licenses(documents)


@query("op11_whitening", "embeddings")
def op11(embeddings: DataFrame) -> DataFrame:
    # A deviation that a long can't hold is null; the operator has it as a decimal.
    return whitening.whiten(embeddings).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query("op12_collocations", "documents", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 5) r(m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 30),
halves AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM c, range(1, 4) x(k) WHERE k < m),
often AS MATERIALIZED (SELECT lang, phrase, a FROM f WHERE a >= 30),
cuts AS (SELECT h.lang, h.phrase, h.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * h.a // (l.a::HUGEINT + r.a))::BIGINT AS score
         FROM halves h JOIN often l ON l.lang = h.lang AND l.phrase = head JOIN often r ON r.lang = h.lang AND r.phrase = rest),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) y(s), range(1, 4) z(i) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
free AS (SELECT low.* FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM free JOIN totals USING (lang) QUALIFY rank <= 2000""")
def op12(documents: DataFrame) -> DataFrame:
    return collocations.collocations(documents)


@query("op13_top_k", "embeddings", r"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.i <> c.i AND q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10""")
def op13(embeddings: DataFrame) -> DataFrame:
    return topk.top_k(embeddings)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
