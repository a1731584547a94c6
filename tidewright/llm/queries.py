"""The contract queries of the ten training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, exact_dedup, html_extract, language, mixing, quality, simhash_dedup, token_files, url_filter
from .common import held_out, spread, table



def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = language.fit(docs)
    found = language.identify_languages(docs.drop("lang"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return byte_bpe.coded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return simhash_dedup.near_duplicates(docs, words=4, radius=4)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = v.vec_id"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR) || ':20') AS key FROM d),
blocks AS (SELECT source, key, sum(size) AS words FROM k GROUP BY source, key),
sizes AS (SELECT source, sum(size) AS source_size FROM k GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM sizes),
weighed AS (SELECT *, [5, 2, 1][CAST(place % 3 AS INTEGER) + 1] AS weight, source_size * 2 AS cap FROM placed),
leveled AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
open AS (SELECT arg_min(level, {'r': CAST(cap AS DOUBLE) / weight, 'p': place}) AS level FROM leveled WHERE cap > level * weight),
goal AS (
  SELECT l.source, l.source_size, CASE WHEN l.cap > l.level * l.weight THEN o.level * l.weight ELSE CAST(l.cap AS DOUBLE) END AS target
  FROM leveled l CROSS JOIN open o),
passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM goal),
rest AS (SELECT *, target - passes * source_size AS rest FROM passed),
run AS (
  SELECT b.source, b.key, b.words, r.rest, sum(b.words) OVER (PARTITION BY b.source ORDER BY b.key) AS through
  FROM blocks b JOIN rest r ON b.source IS NOT DISTINCT FROM r.source),
cut AS (
  SELECT source, coalesce(max(key) FILTER (WHERE through <= rest), '') AS cutoff,
         any_value(rest) - coalesce(max(through) FILTER (WHERE through <= rest), 0) AS gap
  FROM run WHERE rest > 0 GROUP BY source),
closing AS (
  SELECT r.source, arg_min(r.key, {'off': abs(r.words - c.gap), 'key': r.key}) AS key
  FROM run r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
  WHERE r.rest > 0 AND r.key > c.cutoff AND abs(r.words - c.gap) < c.gap GROUP BY r.source)
SELECT k.doc_id, CAST(k.size AS BIGINT) AS size, CAST(g.source_size AS BIGINT) AS source_size, g.target,
       CAST(k.size * (g.passes + CASE WHEN k.key <= c.cutoff OR k.key = z.key THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k JOIN rest g ON k.source IS NOT DISTINCT FROM g.source
LEFT JOIN cut c ON k.source IS NOT DISTINCT FROM c.source LEFT JOIN closing z ON k.source IS NOT DISTINCT FROM z.source"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_embedding_near_dedup, op2_token_files, op3_quality_classifier, op4_language_id, op5_byte_bpe,
        op6_html_extract, op7_url_filter, op8_exact_dedup, op9_simhash_near_dedup, op10_mixing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": OP1_SQL,
        "op7_url_filter": url_filter.oracle(),
        "op8_exact_dedup": OP8_SQL,
        "op10_mixing": OP10_SQL,
    }
