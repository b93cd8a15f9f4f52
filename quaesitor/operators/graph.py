"""Node and edge tables: keyed upserts without MERGE, written as snapshots."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: For each node and edge: key, columns set once, columns set each time. Fixed values.
UPSERTS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "repository": (["full_name"], ["created_at", "language"], ["stars", "mined_at"]),
    "actor": (["login"], ["type"], []),
    "issue": (["repo", "number"], ["created_at"], ["state", "closed_at", "labels"]),
    "pull_request": (["repo", "number"], ["created_at"], ["state", "merged", "closed_at"]),
    "commit": (["sha"], ["authored_at", "committed_at", "message_summary"], []),
    "text_unit": (["text_unit_id"], ["text", "lang", "token_count", "sha256", "created_at", "position"], ["role", "parent_type", "author_login"]),
    "mailing_list": (["name"], [], []),
    "email_message": (["urn"], ["message_id", "subject", "list", "in_reply_to", "lang"], []),
    "signal": (["signal_id"], ["text_unit_id", "layer", "category", "subcategory", "surface_form", "span_start", "span_end", "rule_id", "rule_version"], ["weight", "status"]),
    "verdict": (["text_unit_id", "model_id", "model_version"], [], ["label", "confidence"]),
    "lexical_marker": (["lemma", "lexicon_version"], ["pos", "category", "subcategory", "polarity"], []),
    "rhetorical_figure": (["figure_id"], ["family", "subtype"], []),
    "references": (["src", "dst"], ["mechanism", "source_text_unit"], []),
    "replies_to": (["src", "dst"], [], []),
    "ignorance_type": (["type_id"], ["name", "definition", "source", "scope"], []),
    "typed_as": (["text_unit_id", "type_id"], [], ["annotator", "confidence", "rationale"]),
}


def collapse(batch: DataFrame, keys: list[str], once: list[str], each: list[str], order: list[Column]) -> DataFrame:
    """One row per key of a batch: the first writer's values of `once`, the last writer's of `each`."""
    at = F.struct(*order, *[F.col(k) for k in keys])
    first, last = F.struct(*[F.col(c) for c in once]), F.struct(*[F.col(c) for c in each])
    aggs = ([F.min_by(first, at).alias("_first")] if once else []) + ([F.max_by(last, at).alias("_last")] if each else [])
    if not aggs:
        return batch.select(*keys).distinct()
    out = batch.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in once], *[F.col(f"_last.{c}").alias(c) for c in each])


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], once: list[str], each: list[str], order: list[Column]) -> DataFrame:
    """The target after the batch: new keys are added, known ones keep their `once` columns and take the batch's `each` columns."""
    b = collapse(batch, keys, once, each, order)
    b = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(c).alias(f"_b_{c}") for c in once + each], F.lit(True).alias("_in_b"))
    t = target.select(*keys, *once, *each, F.lit(True).alias("_in_t"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_b_{k}"))
    j = t.join(b, on, "full_outer")
    pick = lambda a, b, known: F.when(F.col(known).isNotNull(), F.col(a)).otherwise(F.col(b))
    return j.select(
        *[F.coalesce(k, f"_b_{k}").alias(k) for k in keys],
        *[pick(c, f"_b_{c}", "_in_t").alias(c) for c in once],
        *[pick(f"_b_{c}", c, "_in_b").alias(c) for c in each],
    )


def upsert_named(kind: str, target: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    return upsert(target, batch, *UPSERTS[kind], order)


def write_snapshot(df: DataFrame, root: str, name: str, number: int) -> str:
    """Writes a snapshot beside the earlier ones; readers take the greatest number, so a lost job leaves the last one whole."""
    path = os.path.join(root, name, f"snapshot={number:08d}")
    df.write.mode("overwrite").parquet(path)
    return path


def commits(raw: DataFrame) -> DataFrame:
    """Commit nodes: sha, authored_at, committed_at, message_summary (the first line, 200 characters)."""
    return raw.select("sha", F.col("commit.author.date").alias("authored_at"), F.col("commit.committer.date").alias("committed_at"), F.left(F.split("commit.message", r"\r?\n")[0], F.lit(200)).alias("message_summary"))


def parent_key(parent_id: Column) -> dict[str, Column]:
    """What a parent's id tells: kind, sha (after the last colon), urn (after the first)."""
    return {"kind": F.substring_index(parent_id, ":", 1), "sha": F.substring_index(parent_id, ":", -1), "urn": F.regexp_extract(parent_id, "^[^:]*:(.*)$", 1)}


def reference_edges(refs: DataFrame, issues: DataFrame) -> DataFrame:
    """REFERENCES edges to known issues of the same repository; of several between a pair the first mechanism stays."""
    dst = F.concat_ws(":", F.lit("issue"), "repo", F.col("number").cast("string"))
    met = refs.withColumn("dst", dst).join(issues.select(F.col("parent_id").alias("dst")).distinct(), "dst", "left_semi")
    w = Window.partitionBy("parent_id", "dst").orderBy("text_unit_id", "place")
    return met.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("parent_id").alias("src"), "dst", "mechanism", F.col("text_unit_id").alias("source_text_unit"))


def catalogue_of(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, column) of all node tables."""
    return [(name, c) for name, df in tables.items() for c in df.columns]


def label_names(labels: Column) -> Column:
    return F.transform(labels, lambda x: F.coalesce(x["name"], F.lit("")))


__all__ = ["UPSERTS", "catalogue_of", "collapse", "commits", "label_names", "parent_key", "reference_edges", "upsert", "upsert_named", "write_snapshot"]
