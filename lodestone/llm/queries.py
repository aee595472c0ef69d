"""Queries that apply the corpus operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import hidden_markov, ordinal_quality, prefix_free, quality_rules, secret_scan, simhash_vptree, soft_mixing, string_tiling, token_output, url_filter
from .common import table

URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


#: Shares of the tokens that the mixing query aims at.
DOMAIN_TARGETS = {"good": 0.94, "toxic": 0.03, "low": 0.03}


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.report(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_quality.select(docs, ordinal_quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = soft_mixing.domain_labels(table(spark, sf_dir, "labels"), 20000)
    return soft_mixing.report(table(spark, sf_dir, "documents"), labelled, DOMAIN_TARGETS)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.report(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_output.write_blocks(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_output.read_back(blocks.df)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, q, rule, verdict) AS (VALUES
  ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
m AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS k
  FROM p LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL}
