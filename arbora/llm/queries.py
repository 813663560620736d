"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, mixing, pu_quality, quality_rules, simhash, token_store, toxicity, url_filters, warc
from .common import crc_fold, table

TOXIC_AT, QUALITY_AT = 0.3, 0.7
URL_RULES: list[url_filters.Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_file() -> str:
    """The default vocabulary file; every operator takes its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.score_quality(docs, quality_rules.fit(docs, labels))


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels), TOXIC_AT)
    return found.select("doc_id", F.coalesce(crc_fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), at_least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, _ = pu_quality.fit(docs, labels)
    found = pu_quality.score(docs, model, QUALITY_AT)
    return found.select("doc_id", F.coalesce(crc_fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judged(pages, url_filters.links_in(pages), URL_RULES)


def op8_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").alias("n_removed"), F.col("removed").alias("removed_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_simhash_pivots, op2_quality_rules, op3_systematic_mix, op4_toxicity_mil, op5_warc_chain, op6_pu_quality, op7_redirect_rules, op8_dac_tokens, op9_decontaminate, op10_line_winnow]
    return {f.__name__: f for f in made}


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), own AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w, source_size * 3 AS cap FROM own
), steps AS (
  SELECT *,
    coalesce(sum(cap) OVER f1, 0) AS filled,
    sum(w) OVER f2 AS open,
    sum(source_size) OVER () AS total,
    row_number() OVER f0 AS k
  FROM weighed
  WINDOW f0 AS (ORDER BY cap::DOUBLE / w, source IS NULL, source),
    f1 AS (ORDER BY cap::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f2 AS (ORDER BY cap::DOUBLE / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), levels AS (
  SELECT *, (total - filled)::DOUBLE / open::DOUBLE AS level FROM steps
), found AS (
  SELECT arg_min(level, k) AS level FROM levels WHERE level * w <= cap
), targets AS (
  SELECT l.source, l.source_size, least(l.cap::DOUBLE, f.level * l.w) AS target FROM levels l CROSS JOIN found f
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    ('0x' || substr(md5('mix|' || coalesce(s.source, '')), 1, 6))::BIGINT AS u,
    CASE WHEN t.source_size > 0 THEN round(t.target / t.source_size * 16777216.0)::BIGINT ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) AS i
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (((u + i * rate) >> 24) - ((u + (i - 1) * rate) >> 24)))::BIGINT AS taken FROM rated
"""

OP5_SQL = r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
  SELECT page_id, payload_bytes, hex,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, (i // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest
  FROM payloads
), firsts AS (SELECT hex, min(page_id) AS first FROM coded GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM coded JOIN firsts USING (hex)
"""


OP7_SQL = r"""
WITH RECURSIVE rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(action, h, p)
), tags AS (
  SELECT url, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b'))[1], '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target
  FROM pages WHERE contains(url, '://')
  UNION ALL
  SELECT url, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b'))[1], '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)
  FROM pages WHERE contains(url, '://')
), links AS (
  SELECT DISTINCT url AS src, CASE
      WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
      WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:]*:)//', 1) || t
      WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || t
      ELSE rtrim(regexp_extract(url, '^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || t END AS dst
  FROM (SELECT url, replace(target, '&amp;', '&') AS t FROM tags WHERE target <> '')
), urls AS (
  SELECT url FROM pages UNION SELECT src FROM links UNION SELECT dst FROM links
), rests AS (
  SELECT url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls
), cut AS (
  SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS search FROM rests
), best AS (
  SELECT c.host, c.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.action, length(r.h || r.p)) AS action
  FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p) GROUP BY ALL
), judged AS (
  SELECT cut.*, cut.host || cut.path || cut.search AS key, rule, action FROM cut LEFT JOIN best USING (host, path)
), pairs AS (
  SELECT DISTINCT a.key AS x, b.key AS y FROM links l JOIN judged a ON a.url = l.src JOIN judged b ON b.url = l.dst WHERE a.key <> '' AND b.key <> ''
), both_ways AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
caught(key) AS (
  SELECT b.x FROM both_ways b JOIN judged j ON j.key = b.x WHERE j.action = 'block'
  UNION SELECT b.y FROM caught c JOIN both_ways b ON b.x = c.key
)
SELECT p.page_id, j.host, j.path, j.rule, coalesce(j.action, CASE WHEN c.key IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages p JOIN judged j ON j.url IS NOT DISTINCT FROM p.url LEFT JOIN (SELECT DISTINCT key FROM caught) c ON c.key = j.key
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are held against brute force, round trips and held-out rows in tests."""
    return {"op3_systematic_mix": OP3_SQL, "op5_warc_chain": OP5_SQL, "op7_redirect_rules": OP7_SQL}
