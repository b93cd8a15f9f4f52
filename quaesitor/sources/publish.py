"""Saves mined documents under their key and publishes a small pointer event for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph

SAVED = ["item_subtype", "repo_name", "doc", "content_sha256", "processed"]


def keyed(raw: DataFrame) -> DataFrame:
    """`raw` (item_type, repo, doc JSON) with its key and what is stored beside it.

    The key is the document's id unless that is empty or 0, else its sha, else its
    number; documents with none are passed over. An issue with a `pull_request` entry, null or not, is
    one. The hash is that of the JSON text as it came.
    """
    part = lambda name: F.nullif(F.nullif(F.get_json_object("doc", f"$.{name}"), F.lit("")), F.lit("0"))
    is_pull = F.coalesce(F.array_contains(F.json_object_keys("doc"), "pull_request"), F.lit(False))
    out = raw.select(
        "item_type", F.coalesce(part("id"), part("sha"), F.get_json_object("doc", "$.number")).alias("item_id"),
        F.when(F.col("item_type") == "issue", F.when(is_pull, "pull_request").otherwise("issue")).otherwise(F.col("item_type")).alias("item_subtype"),
        F.col("repo").alias("repo_name"), "doc", F.sha2("doc", 256).alias("content_sha256"), F.lit(False).alias("processed"),
    )
    return out.filter("item_id IS NOT NULL")


def save(store: DataFrame, raw: DataFrame) -> DataFrame:
    """The store (item_type, item_id and SAVED) after a batch: new keys are added, known ones take the batch's document. Of one key's documents in a batch that of the greatest hash stays."""
    return graph.upsert(store, keyed(raw), ["item_type", "item_id"], [], SAVED, [F.col("content_sha256")])


def events(raw: DataFrame) -> DataFrame:
    """(value): a pointer event in JSON for each saved key of a batch; mongo_id is the key's digest."""
    w = Window.partitionBy("item_type", "item_id").orderBy(F.desc("content_sha256"))
    one = keyed(raw).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    pointer = F.struct("item_id", "item_type", "item_subtype", "repo_name", F.sha2(F.concat_ws(":", "item_type", "item_id"), 256).alias("mongo_id"))
    return one.select(F.to_json(pointer).alias("value"))


def publish(raw: DataFrame, stream: str) -> None:
    """Appends a batch's events to the folder that a stream reads. Call it behind the write of save(): an event never points to what is not there."""
    events(raw).write.mode("append").text(stream)
