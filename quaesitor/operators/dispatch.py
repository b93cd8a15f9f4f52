"""Raw records of mixed types to text units and to the nodes and edges of the artefact graph.

A record has item_type, item_subtype, repo and doc, the artefact as JSON. Every
branch is a filter and a parse within the row; only node keys and edges meet in
shuffles, never texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landing import SCHEMAS
from . import graph, units

KINDS = ("repository", "issue", "pull_request", "commit", "email")


def kind_of() -> Column:
    """The kind of a record: pull requests and issues by subtype, the others by type; null for all else, which is passed over."""
    sub, of = F.col("item_subtype"), F.col("item_type")
    return F.when(of == "email", "email").when(of == "repository", "repository").when(sub == "pull_request", "pull_request").when(sub == "issue", "issue").when(of == "commit", "commit")


def parsed(records: DataFrame, kind: str) -> DataFrame:
    """The records of a kind with the columns of their document; the repository is the record's own. Documents that do not parse have nulls."""
    schema = SCHEMAS[kind] + (", lang string" if kind != "email" else "")
    rows = records.filter(kind_of() == kind).select("repo", F.from_json("doc", schema).alias("d")).select(F.col("repo").alias("_repo"), "d.*")
    return rows.withColumn("_meta", F.struct(F.col("_repo").alias("repo_full_name"))).drop("_repo")


def text_units(records: DataFrame) -> DataFrame:
    """The text units of all records that have an extractor."""
    return units.extract(*(parsed(records, k) for k in ("issue", "pull_request", "commit", "email")))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _id(kind: str) -> Column:
    repo = F.col("_meta.repo_full_name")
    return {"issue": F.concat_ws(":", F.lit("issue"), repo, "number"), "pull_request": F.concat_ws(":", F.lit("pr"), repo, "number"), "commit": F.concat_ws(":", F.lit("commit"), "sha"), "email": F.concat_ws(":", F.lit("email"), "urn")}[kind]


def _mails(records: DataFrame) -> DataFrame:
    return parsed(records, "email").filter(_filled(F.col("urn")).isNotNull())


def actors(records: DataFrame) -> DataFrame:
    """(login, type): the `user` of any record but e-mail, of whatever type it is, and the trimmed senders of e-mail."""
    users = records.filter("item_type IS DISTINCT FROM 'email'").select(F.get_json_object("doc", "$.user.login").alias("login"))
    senders = _mails(records).select(F.trim("headers.from").alias("login"))
    return users.union(senders).filter(F.col("login") != "").distinct().withColumn("type", F.lit("User"))


def repositories(records: DataFrame) -> DataFrame:
    """(full_name) of every repository that a record names, with or without a repository document."""
    named = records.filter("item_type IS DISTINCT FROM 'email'").select(F.col("repo").alias("full_name"))
    return named.union(parsed(records, "repository").select("full_name")).filter(F.col("full_name") != "").distinct()


def contains(records: DataFrame, kind: str) -> DataFrame:
    """CONTAINS edges (src, dst): the repository of an issue, pull request or commit, the list of an e-mail. Without a container no edge."""
    if kind == "email":
        rows = _mails(records).select(_filled(F.col("group")).alias("of"), _id(kind).alias("dst"))
    else:
        rows = parsed(records, kind).select(_filled(F.col("_meta.repo_full_name")).alias("of"), _id(kind).alias("dst"))
    return rows.filter("of IS NOT NULL").select(F.concat(F.lit("list:" if kind == "email" else "repo:"), "of").alias("src"), "dst").distinct()


def authored(records: DataFrame, kind: str) -> DataFrame:
    """AUTHORED edges (src, dst) from known actors only: the author of a commit is no actor unless some other record makes one of it."""
    if kind == "email":
        rows = _mails(records).select(F.trim("headers.from").alias("src"), _id(kind).alias("dst"))
    else:
        rows = parsed(records, kind).select(F.col("author.login" if kind == "commit" else "user.login").alias("src"), _id(kind).alias("dst"))
    return rows.distinct().join(actors(records).select(F.col("login").alias("src")), "src", "left_semi")


def nodes(records: DataFrame, kind: str) -> DataFrame:
    """The nodes of a kind with their upsert columns (graph.UPSERTS)."""
    rows = parsed(records, kind) if kind != "email" else _mails(records)
    repo = F.col("_meta.repo_full_name").alias("repo")
    if kind == "repository":
        return rows.select("full_name", "created_at", "language", F.coalesce("stargazers_count", F.lit(0)).alias("stars"))
    if kind == "issue":
        return rows.select(repo, "number", "created_at", "state", "closed_at", graph.label_names(F.col("labels")).alias("labels"))
    if kind == "pull_request":
        return rows.select(repo, "number", "created_at", "state", F.coalesce("merged", F.lit(False)).alias("merged"), "closed_at")
    if kind == "commit":
        return graph.commits(rows)
    h = F.col("headers")
    return rows.select("urn", h["message_id"].alias("message_id"), h["subject"].alias("subject"), F.col("group").alias("list"), h["in_reply_to"].alias("in_reply_to"), "lang")


def edges(records: DataFrame) -> DataFrame:
    """All CONTAINS and AUTHORED edges: (type, src, dst)."""
    kinds = KINDS[1:]
    made = [f(records, k).select(F.lit(name).alias("type"), "src", "dst") for name, f in (("CONTAINS", contains), ("AUTHORED", authored)) for k in kinds]
    return reduce(DataFrame.unionByName, made)


def sentinels(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, verdicts): the stream parted by the private `__verdict__` key of the payload (map<string, string>)."""
    is_verdict = F.coalesce(F.col("payload")["__verdict__"].isin("true", "1", "True"), F.lit(False))
    return signals.filter(~is_verdict), signals.filter(is_verdict)
