"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hosts, html, leaks, packing, quotes, sequences, shuffle, simhash, urls, warc
from .common import materialise
from .encoding import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_groups(table(spark, sf_dir, "documents"))


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.tokenise(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    return shuffle.shuffle_shards(docs, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: action, host and path of each rule.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES) + " AS t(action, host, path)")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hosts.measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return hosts.with_verdicts(materialise(docs.drop("text"), "measured")).select("doc_id", *hosts.MEASURES, "base_failed", "kept")


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_simhash_golay, op3_warc_zstd, op4_block_tree, op5_arrow_sequences, op6_hypergeometric_shards, op7_pigeonhole_leaks, op8_url_rules, op9_quotation_linking, op10_host_rules,
    )}


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS last FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM m
"""

_URL_SQL = """
WITH r(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT c.page_id, c.host, c.path, r.host || r.path AS rule, r.action,
  row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action DESC) AS n
  FROM c LEFT JOIN r ON (c.host = r.host OR suffix(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM d WHERE n = 1
"""

_HOST_SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
u AS (SELECT doc_id, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM u) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {hosts.MIN_WORDS} OR 100 * n_repeat_words > {hosts.MAX_REPEATED} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR 100 * n_symbols > {hosts.MAX_SYMBOLS} * word_chars THEN 1 ELSE 0 END) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
z AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 1.0 END AS k FROM q),
x AS (SELECT source, (f + m * k) / (n + k) AS rate FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate <= {hosts.MAX_RATE}, TRUE) AS kept
FROM b LEFT JOIN x ON b.source = x.source
"""


def oracle_sql() -> dict:
    return {"op3_warc_zstd": _WARC_SQL, "op8_url_rules": _URL_SQL, "op10_host_rules": _HOST_SQL}
