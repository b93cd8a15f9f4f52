"""Schemas and readers of landed artefacts, bulk e-mail pairs and pointer events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_urn

META = "struct<item_type:string,repo_full_name:string,`group`:string,mined_at:string,processed:boolean,content_sha256:string>"
COMMENT = "struct<body:string,user:struct<login:string>,created_at:string>"
ISSUE = f"id bigint, number int, title string, body string, state string, created_at string, closed_at string, user struct<login:string>, labels array<struct<name:string>>, pull_request string, comments int, comments_data array<{COMMENT}>, _meta {META}"
PULL = f"id bigint, number int, title string, body string, state string, created_at string, closed_at string, merged boolean, user struct<login:string>, labels array<struct<name:string>>, comments_data array<{COMMENT}>, issue_comments_data array<{COMMENT}>, _meta {META}"
COMMIT = f"sha string, author struct<login:string>, `commit` struct<message:string,author:struct<name:string,date:string>,committer:struct<date:string>>, _meta {META}"
REPOSITORY = f"full_name string, created_at string, language string, stargazers_count int, _meta {META}"
EMAIL = f"urn string, headers struct<message_id:string,date:string,subject:string,`from`:string,`to`:string,cc:string,in_reply_to:string,`references`:string,list_id:string>, text_plain string, lang string, `group` string, segments array<struct<begin:int,`end`:int,label:string>>, _meta {META}"
SCHEMAS = {"repository": REPOSITORY, "issue": ISSUE, "pull_request": PULL, "commit": COMMIT, "email": EMAIL}
EVENT = "item_id string, item_type string, item_subtype string, repo_name string, mongo_id string"


def read_landing(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed JSON lines of one kind; a record that does not parse has nulls."""
    return spark.read.schema(SCHEMAS[kind]).json(path)


def bulk_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of gzip or plain bulk files; a gzip file is one ordered partition."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return lines


def pair_bulk(lines: DataFrame) -> DataFrame:
    """(file, n, urn, source) of the action and source line pairs in (file, n, line).

    Blank lines are skipped; a source line counts if the line before it is an
    action; a line that is no JSON clears the action; a repeated action begins anew.
    """
    is_json = F.try_parse_json("line").isNotNull()
    action = F.get_json_object("line", "$.index._id")
    rows = lines.filter(F.trim("line") != "").select("file", "n", "line", F.when(is_json, action).alias("action"), is_json.alias("ok"))
    before = Window.partitionBy("file").orderBy("n")
    rows = rows.withColumn("of", F.lag("action").over(before))
    return rows.filter(F.col("ok") & F.col("action").isNull() & F.col("of").isNotNull()).select("file", "n", clean_urn(F.col("of")).alias("urn"), F.col("line").alias("source"))


def parse_bulk(pairs: DataFrame) -> DataFrame:
    return pairs.select("urn", F.from_json("source", EMAIL.split("urn string, ")[1]).alias("r")).select("urn", "r.*")


def in_scope(group: Column, lang: Column, groups: list[str] | None = None, langs: list[str] | None = None) -> Column:
    """Allow-lists of groups and languages; an absent list allows all, a null language counts as ''."""
    ok = F.lit(True)
    if groups:
        ok = ok & F.coalesce(group, F.lit("")).isin(*groups)
    if langs:
        ok = ok & F.coalesce(lang, F.lit("")).isin(*langs)
    return ok


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def least_by(df: DataFrame, keys: list[str], entry: Column, n: int) -> DataFrame:
    """The n least entries of each key, a row each, in column e: groups are cut to n before they meet, so no key fills a task."""
    salted = df.select(*keys, entry.alias("e"), F.pmod(F.xxhash64(entry), F.lit(64)).alias("_salt"))
    cut = lambda c: F.slice(F.array_sort(c), 1, n)
    part = salted.groupBy(*keys, "_salt").agg(cut(F.collect_list("e")).alias("p"))
    return part.groupBy(*keys).agg(cut(F.flatten(F.collect_list("p"))).alias("p")).select(*keys, F.explode("p").alias("e"))


def new_records(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key the target lacks."""
    return batch.join(target.select(key), key, "left_anti")


def parse_events(lines: Column) -> Column:
    """A pointer event from its JSON; null if malformed."""
    return F.from_json(lines, EVENT, {"mode": "PERMISSIVE"})


def content_hash(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)
