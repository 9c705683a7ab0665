"""One query for each corpus operator, over its whole table, and the same in DuckDB SQL where that can be said."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, decontaminate, language_id, ogg_media, passages, quality_knn, secrets, shards, simhash_dedup, url_cascade

RANKS = "byte_bpe_50k.tiktoken"
# Fixed values of the url query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The data bring no list of hosts, so one is made by a rule: hosts whose MD5 begins with a digit below this.
LISTED_BELOW = "4"
SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.probe(ogg_media.store_texts(_table(spark, sf_dir, "documents")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    hosts = pages.select(url_cascade.url_host(F.col("url")).alias("host")).distinct()
    cascade = url_cascade.build(hosts, "host", F.md5(F.col("host").cast("binary")) < LISTED_BELOW)
    return url_cascade.judge(pages, [url_cascade.parse_rule(*r) for r in RULES], cascade)


_OP3_SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h.partition('/')[0]}', '/{h.partition('/')[2]}')" for v, h in RULES)}),
fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN host <> '' AND md5(host) < '{LISTED_BELOW}' THEN 'block' ELSE 'allow' END) AS verdict
FROM fit WHERE n = 1
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.train(docs, _table(spark, sf_dir, "labels")))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.report(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), decontaminate.indexes(_table(spark, sf_dir, "benchmark")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"), SHARD_BYTES)


_OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), depths AS (SELECT unnest(range(0, {shards.BITS + 1}))::INT AS depth),
sums AS (SELECT depth, h >> ({shards.BITS} - depth) AS p, sum(bytes)::BIGINT AS shard_bytes FROM d, depths GROUP BY ALL),
fit AS (
  SELECT d.*, s.depth, s.shard_bytes, row_number() OVER (PARTITION BY d.doc_id, d.h ORDER BY s.depth) AS n
  FROM d JOIN sums s ON (d.h >> ({shards.BITS} - s.depth)) = s.p WHERE s.shard_bytes <= {SHARD_BYTES}
)
SELECT doc_id, bytes, depth || ':' || lpad(CASE WHEN depth = 0 THEN '' ELSE bin(h >> ({shards.BITS} - depth)) END, depth, '0') AS shard, depth, shard_bytes, false AS oversize
FROM fit WHERE n = 1
"""



def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.train(secrets.default_samples(spark).unionAll(secrets.ordinary_words(docs))))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg_media": op1_ogg_media,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {"op3_url_filter": _OP3_SQL, "op8_sharding": _OP8_SQL}
