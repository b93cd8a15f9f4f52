"""The corpus pipeline: stages over `documents`, each written and read again before the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
empty tables and further columns of any name; all but the last return the columns
they got. Null and blank texts count as empty texts and are kept by the stages
that judge a text alone; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaesitor.llm import decontaminate, mixing, sharding, simhash, toxicity
from quaesitor.llm.common import table, written
from quaesitor.llm.queries import MIX_KEEP, MIX_TARGETS, SHARD_BYTES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under 0.3; texts without a known term, empty ones too, share one score. A score of 0.3 goes. Repeated rows share their fate, null ids are judged like others."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: fingerprints over five-word shingles, linked at 4 or fewer differing bits. The smallest id stays, with all its rows; an id of several texts stays if it is the smallest of one of their components; empty texts are one group; rows with a null id stay."""
    return simhash.without_near_copies(docs, words=5, reach=4)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, copied or with other values. Null or empty items match nothing; repeated items count once; empty texts and null ids are judged like others."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic shares. A null source or language is a value of its own; repeated ids, and all null ids, share their draw; empty texts have the weight of their cell."""
    return mixing.sampled(docs, MIX_TARGETS, MIX_KEEP)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row: none is lost, whatever ids repeat or are null; a text over the limit has a shard of its own."""
    return sharding.extendible_shards(docs, SHARD_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Learned scores, fingerprints and raked weights are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table: one row per document that the first four keep, with its shard. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
