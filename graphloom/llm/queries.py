"""The corpus operators' queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, mixing, packing, quality, secret_scan, simhash, substring_dedup, token_files, url_rules
from .common import table

BYTE_TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_TOKENIZER), leading_space=True, end_id=0, capacity=2048)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_file_digest(docs, public_tokenizers.path(WORD_TOKENIZER), leading_space=False, end_id=2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=400)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(1.0, 2.0, 3.0), most_repeats=3)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.RULES, default="allow")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10, recall=0.99)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.judge_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), distance=4, shingle=4, seed=42)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 returns but for the words taken."""
    return op3_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op6 returns."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 returns but for the model's verdict."""
    return op9_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mix": op3_source_mix,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_url_rules": op7_url_rules,
    "op8_nearest": op8_nearest,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "pipeline": pipeline,
    "mix_targets": mix_targets,
    "secret_counts": secret_counts,
    "quality_statistics": quality_statistics,
}

ORACLE_SQL: dict[str, str] = {
    "mix_targets": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), full_ AS (  -- sources in the order in which they reach three times their size as the level rises
  SELECT *, 3 * n / w AS level, sum(3 * n) OVER o AS capped, sum(w) OVER () - sum(w) OVER o AS rest_w, sum(n) OVER () AS total FROM s
  WINDOW o AS (ORDER BY 3 * n / w, source NULLS LAST)
), found AS (  -- the level at which all is shared out, once those below it are full
  SELECT min(CASE WHEN rest_w = 0 THEN level ELSE greatest(level, (total - capped) / rest_w) END) FILTER (WHERE fits) AS level FROM (
    SELECT *, rest_w = 0 OR (total - capped) / rest_w <= coalesce(lead(level) OVER (ORDER BY level, source NULLS LAST), 1e308) AS fits FROM (
      SELECT source, level, capped, rest_w, total FROM full_ UNION ALL SELECT NULL, -1, 0, sum(w), sum(n) FROM s))
  WHERE (total - capped) / greatest(rest_w, 1) >= level OR rest_w = 0
)
SELECT doc_id, size, n::BIGINT AS source_size, round(least(3 * n, w * (SELECT level FROM found))::DOUBLE, 3) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
""",
    "secret_counts": r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM documents
""",
    "quality_statistics": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS k FROM w) WHERE k > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
""",
    "op7_url_rules": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT s.page_id, s.host, s.path, r.verdict, r.rhost || r.rpath AS rule
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
""",
}
