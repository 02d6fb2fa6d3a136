"""The registered queries of the ten operators, their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lifetrace.llm import alignment, chat, classifier, decontam, jaccard, mixing, negatives, pii, quality, secrets, simhash, tokenids, urls
from lifetrace.llm.common import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


@query
def op2_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recovered(read(spark, sf_dir, "conversations"))


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.quotas(read(spark, sf_dir, "documents"))


@query
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encoded(read(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontam.report(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


ORACLES["op7_decontamination"] = r"""
WITH folded AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, sizes)),
found AS (SELECT rid, i, n, item FROM spots JOIN windows USING (n, phrase)),
hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "binary") AS names
  FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""



@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urls.decide(urls.captures_of(pages), urls.entries_of(pages))


ORACLES["op10_url_filters"] = r"""
WITH parts AS (
  SELECT page_id, url, ((page_id * 37) % 365 + 365) % 365 AS day, ((page_id * 53) % 365 + 365) % 365 AS listed,
    regexp_replace(coalesce(url, ''), '#.*$', '') AS url_key,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host_key
  FROM pages),
keyed AS (
  SELECT *, coalesce(nullif(regexp_extract(host_key, '([^.]+\.[^.]+)$', 1), ''), host_key) AS domain_key FROM parts),
entries AS (
  SELECT 'host' AS kind, host_key AS key, listed AS since, true AS blocks FROM keyed WHERE page_id % 5 = 0
  UNION ALL SELECT 'host', host_key, listed, false FROM keyed WHERE page_id % 7 = 0
  UNION ALL SELECT 'domain', domain_key, listed, true FROM keyed WHERE page_id % 11 = 0
  UNION ALL SELECT 'domain', domain_key, listed, false FROM keyed WHERE page_id % 13 = 0
  UNION ALL SELECT 'url', url_key, listed, true FROM keyed WHERE page_id % 17 = 0
  UNION ALL SELECT 'url', url_key, listed, false FROM keyed WHERE page_id % 19 = 0),
daily AS (SELECT kind, key, since, bool_or(blocks) AS blocks FROM entries WHERE key <> '' GROUP BY ALL)
SELECT page_id, url, day, coalesce(u.blocks, h.blocks, d.blocks, false) AS blocked,
  CASE WHEN u.since IS NOT NULL THEN 'url' WHEN h.since IS NOT NULL THEN 'host' WHEN d.since IS NOT NULL THEN 'domain' END AS by,
  coalesce(u.since, h.since, d.since) AS since
FROM keyed
ASOF LEFT JOIN (SELECT * FROM daily WHERE kind = 'url') u ON u.key = url_key AND day >= u.since
ASOF LEFT JOIN (SELECT * FROM daily WHERE kind = 'host') h ON h.key = host_key AND day >= h.since
ASOF LEFT JOIN (SELECT * FROM daily WHERE kind = 'domain') d ON d.key = domain_key AND day >= d.since"""



@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(read(spark, sf_dir, "embeddings"))


ORACLES["op11_hard_negatives"] = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
met AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.parts, b.parts), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place
  FROM met WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.rid, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN met n ON n.rid = p.rid AND NOT n.same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(read(spark, sf_dir, "documents"))


@query
def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(read(spark, sf_dir, "documents"))


ORACLES["op13_ngram_jaccard_join"] = r"""
WITH RECURSIVE folded AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM folded WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
common AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.rid < y.rid GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rid AS a, rid AS b FROM folded
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
least AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN folded ON folded.rid = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM folded LEFT JOIN sizes USING (rid) LEFT JOIN least USING (rid)"""
