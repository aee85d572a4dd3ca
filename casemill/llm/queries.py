"""Queries opN_... over the driver's tables, each with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, interleave, licenses, lines, manifest, packing, quality, quality_rules, simhash, tokens, topk, url_filter, whitening
from .common import ready, table

SHARDS = 24
URL_RULES = [url_filter.parse_rule(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]
#: Hosts with one of these labels are known for spam: all their urls that were seen are listed.
SPAM_LABELS = ("spam-farm", "cheap-pills")


def listed_urls(pages: DataFrame) -> DataFrame:
    """canonical: the url list, from the whole of pages."""
    host = url_filter.host_of(F.col("url"))
    spam = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, SPAM_LABELS)))
    return pages.filter(spam).select(url_filter.canonical(F.col("url")).alias("canonical"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, listed_urls(pages), URL_RULES)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = interleave.interleave(table(spark, sf_dir, "documents"), SHARDS)
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")


def op4_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    made = whitening.fit(whitening.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 1_000_000), 32)
    rows = made.apply().select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*map(F.lit, made.explained.tolist())).cast("array<double>")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(made.error).alias("identity_error"))


def op12_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    rows = topk.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return topk.top_k(rows, F.col("id") % 50 == 0, 5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    one_line = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = manifest.prove(manifest.manifest(table(spark, sf_dir, "documents"), one_line, tampered))
    proof = manifest.digest(F.array_join("siblings", ""))
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified", "source")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    ready(spark)
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filter, op2_decontaminate, op3_interleaved_shards, op4_quality_ranker, op5_token_counts, op6_license_scan, op7_quality_rules, op8_line_dedup, op9_simhash, op10_best_two_fit, op11_whitening, op12_max_score, op13_merkle_manifest, pipeline]
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, url, contains(url, '://') AS ok,
         translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS query
  FROM pages),
canon AS (
  SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path,
         CASE WHEN ok THEN regexp_replace(host, '^www\.|:(?:80|443)$', '', 'g') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_filter(string_split(coalesce(query, ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=]*|ref|gclid|fbclid)(?:=|$)')) AS kept FROM parts)),
listed AS (SELECT DISTINCT canonical AS listed_url FROM canon WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills'])),
ruled AS (
  SELECT *, listed_url IS NOT NULL AS listed,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM canon LEFT JOIN listed ON canonical = listed_url)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM ruled
"""

OP7_SQL = r"""
WITH raw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, text, list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM raw),
stats AS (SELECT rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 len(list_filter(words, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]') AND strlen(w) > 1)) AS n_upper,
                 length(text) - length(replace(text, '!', '')) AS n_shouts,
                 len(list_distinct(words)) AS n_distinct, coalesce(list_max(map_values(list_aggregate(words, 'histogram'))), 0)::BIGINT AS n_top,
                 greatest(len(words) - 2, 0) AS n_trigrams, len(list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS n_distinct_trigrams,
                 list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS paragraphs
          FROM split),
grams AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
full_stats AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_upper, n_shouts, n_distinct, n_top, n_trigrams, n_distinct_trigrams, paragraphs, coalesce(n_repeat_words, 0) AS n_repeat_words FROM stats LEFT JOIN covered USING (rid)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM full_stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * greatest(1, n_words) OR (2 * n_upper > n_words AND n_words >= 5)
            OR (4 * n_shouts > n_words AND n_words >= 5) OR (n_words > 0 AND NOT word_chars BETWEEN 2 * n_words AND 20 * n_words)
            OR 2 * n_dup_lines > greatest(1, n_lines) OR 4 * n_top > n_words OR 50 * n_distinct < n_words
            OR 2 * (n_trigrams - n_distinct_trigrams) > n_trigrams OR 2 * (len(paragraphs) - len(list_distinct(paragraphs))) > len(paragraphs)) AS kept
FROM base
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op7_quality_rules": OP7_SQL}
