"""Queries of the ten operators, their SQL, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, licenses, lm_score, minhash, quality, sharding, suffix_dedup, warc
from .common import table

SHARDS = 40


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    estimates = quality.estimate(docs)
    seen = quality.cascade(docs, quality.plan(estimates), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    return seen.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"), order=3, alpha=0.4)
    return scored.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("perplexity", 4).alias("perplexity"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = licenses.scan(table(spark, sf_dir, "documents"))
    return seen.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), least=400)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    made = bpe.encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return bpe.digests(made, path, pattern)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")), keep="page_id")
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", F.octet_length("block").cast("long").alias("n_bytes"), "block_digest", "payload_digest", "source_content_type", "http_headers", F.sha2("block", 256).alias("block_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, grown=SHARDS + 1)
    return sharding.number(placed, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=0.8).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_lm_score, op4_license_scan, op5_suffix_dedup, op6_byte_bpe, op7_decontaminate, op8_warc_derivatives, op9_sharding, op10_minhash_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT doc_id, i, {'a': word, 'b': lead(word) OVER o, 'c': lead(word, 2) OVER o} AS tri, lead(word, 2) OVER o AS last FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g WHERE last IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_bang, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
    length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F]', '', 'g')) AS n_controls, strlen(t) AS n_bytes
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN u ON u.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (n_words > 0 AND (10 * n_symbols > n_words OR 2 * n_bang > n_words OR NOT word_chars BETWEEN 2 * n_words AND 12 * n_words))
    OR (n_upper > n_lower AND n_upper > 20) OR (word_chars > 0 AND 10 * n_digits > 3 * word_chars) OR 100 * n_controls > n_bytes
    OR (n_lines >= 5 AND 2 * n_dup_lines > n_lines)) AS kept
FROM b""",
    "op9_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
s AS (SELECT unnest(range({SHARDS + 1})) AS s),
h AS (SELECT k, s, substr(md5(k || ':' || s), 1, 13) AS u FROM (SELECT DISTINCT k FROM d), s),
a AS (SELECT k, s AS shard FROM (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY u DESC, s) AS r FROM h WHERE s < {SHARDS}) WHERE r = 1),
b AS (SELECT k, s AS grown_shard FROM (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY u DESC, s) AS r FROM h) WHERE r = 1),
crc AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS n))),
x AS (SELECT doc_id, t, k, list_transform(range(strlen(t)), lambda i: CAST('0x' || substr(hex(encode(t)), 2 * i + 1, 2) AS BIGINT)) AS bs FROM d),
y AS (SELECT doc_id, t, k, xor(4294967295, list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) AS crc FROM x, crc)
SELECT doc_id, strlen(t) + 16 AS size, crc AS text_crc32, 'key' AS law, a.shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY CAST('0x' || substr(md5(y.k), 1, 6) AS BIGINT) % {sharding.SLOT_PARTS}, doc_id NULLS FIRST, crc, strlen(t)) - 1 AS slot, b.grown_shard
FROM y JOIN a ON a.k = y.k JOIN b ON b.k = y.k""",
    "op10_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT g, count(*) AS df FROM g GROUP BY g),
p AS (SELECT g.doc_id, g.g, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY df, g.g) AS r FROM g JOIN f ON f.g = g.g JOIN n ON n.doc_id = g.doc_id),
q AS (SELECT doc_id, g, n FROM p WHERE r <= n // 5 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM q a JOIN q b ON a.g = b.g AND a.doc_id < b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN g x ON x.doc_id = c.a JOIN g y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op3_lm_score": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT doc_id, i, w AS w1, lag(w) OVER o AS w2, lag(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, count(*) OVER (PARTITION BY w1) AS c1, count(*) OVER (PARTITION BY w2, w1) AS c2, count(*) OVER (PARTITION BY w3, w2, w1) AS c3 FROM g),
x AS (SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2, (SELECT count(*) FROM p) AS n FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN i >= 2 AND c3 >= 1 THEN log10(c3 / b2) WHEN i >= 1 AND c2 >= 1 THEN log10(c2 / b1) + log10(0.4) * least(1, i - 1)
  ELSE log10(c1 / n) + log10(0.4) * least(2, i) END AS s FROM x),
t AS (SELECT doc_id, count(*) AS n_words, sum(s) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(score, 0.0), 4) AS score, round(pow(10, -score / n_words), 4) AS perplexity FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
}
