"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, html, licences, mixing, sharding, simhash, tokens, toxicity, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


#: Target powers over the observed shares of tokens, and the share of tokens to keep.
MIX_TARGETS: dict[str, mixing.Target] = {"source": 0.7, "lang": 0.8, "topic": 0.9}
MIX_KEEP = 0.8
URL_RULES: urls.Rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SHARD_BYTES = 16 << 20


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), MIX_TARGETS, MIX_KEEP)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "word_bpe_49k.json", limit=2048)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels"), URL_RULES)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"), threshold=0.3)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=4, reach=4)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents", "doc_id", "text"), SHARD_BYTES)


def op8_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.by_document(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flagged(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_token_counts": op2_token_counts,
        "op3_url_rules": op3_url_rules,
        "op4_html_text": op4_html_text,
        "op5_toxicity": op5_toxicity,
        "op6_simhash": op6_simhash,
        "op7_sharding": op7_sharding,
        "op8_collisions": op8_collisions,
        "op9_licences": op9_licences,
        "op10_template_leaks": op10_template_leaks,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_rules": urls.oracle(URL_RULES),
        "op7_sharding": sharding.oracle(SHARD_BYTES),
        "op10_template_leaks": decontaminate.oracle(),
    }
