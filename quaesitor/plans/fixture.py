"""The discourse corpus over the driver's tables: raw artefacts, made alike here and in the oracle's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUES = [
    "Some doubt is left over the retry logic here.",
    "I'm not sure the ticket may be shut, see #12 and fixes #7.",
    "What makes the cache drop rows is unknown so far.",
    "On arm we can't reproduce it, nor on the spare box.",
    "A stale lock might explain this, but perhaps there is more to it.",
    "That paragraph is vague and ambiguous, and the flag is undocumented.",
    "It seems to need heavy traffic; apparently we hunt a heisenbug.",
    "Why is the upload cut off? It seems tied to the proxy.",
    "Error paths are a blind spot of this suite.",
    "Our notes have a knowledge gap about the scheduler.",
    "I don't know which node wrote it @reviewer.",
    "I think the parser is at fault, maybe the lexer as well.",
    "Without a core dump the on-call was helpless.",
    "A questionable default, and the vendor library is a black box.",
    "The nightly build went green on the release branch.",
    "Obviously the guard belongs there, of course, closes #30.",
    "We have no idea who calls this endpoint.",
    "The port is error-free but was never profiled.",
    "This feels like a kind of starvation, right?",
    "I wonder whether `flush` runs.\n> a quoted remark\nBeyond that it is uncharted ground.",
    "The vendor will never know; their patch has not shipped yet.",
    "As far as I know this is the tip of the iceberg, undefined behaviour aside.",
    "There is a lack of fixtures, TODO resolve #5.",
    "Few read the appendix ![plot](b.svg) <!-- a note --> below.",
    "However it must be the locale, or something.",
    "The revert went into the stable line this morning.",
    "It is hard to tell, who knows, it works on my machine.",
]
N = len(CUES)


def cue(shift: int) -> Column:
    return F.element_at(F.array(*map(F.lit, CUES)), ((F.col("doc_id") + shift) % N + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    d = d.withColumn("body", F.concat(cue(0), F.lit(" "), F.coalesce("text", F.lit(""))))
    author = F.concat(F.lit("user"), (F.col("doc_id") % 37).cast("string"), F.when(F.col("doc_id") % 29 == 0, "[bot]").otherwise(""))
    created = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    return d.withColumns({"author": author, "created": created, "kind": (F.col("doc_id") % 4).cast("int")})


def _meta(kind: str, where: str = "source") -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("item_type"), F.col(where).alias("repo_full_name"), F.col(where).alias("group"), none.alias("mined_at"), F.lit(False).alias("processed"), none.alias("content_sha256"))


def _comment(text: Column) -> Column:
    who = F.struct(F.concat(F.lit("rev"), (F.col("doc_id") % 11).cast("string")).alias("login"))
    return F.struct(text.alias("body"), who.alias("user"), F.col("created").alias("created_at"))


def _issue_like(d: DataFrame, title: int) -> DataFrame:
    return d.select(
        "doc_id", F.col("doc_id").alias("id"), F.col("doc_id").cast("int").alias("number"), cue(title).alias("title"), "body", "lang", "created",
        F.when(F.col("doc_id") % 3 == 0, "closed").otherwise("open").alias("state"), F.col("created").alias("created_at"), F.lit(None).cast("string").alias("closed_at"),
        F.struct(F.col("author").alias("login")).alias("user"), F.array(F.struct(F.lit("bug").alias("name")), F.struct(F.col("lang").alias("name"))).alias("labels"),
        F.array(_comment(cue(1)), _comment(F.lit("```x```")), _comment(cue(2))).alias("three"), _comment(cue(1)).alias("one"), _comment(cue(2)).alias("two"), "source",
    )


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _issue_like(documents(spark, sf_dir).filter("kind = 0"), 3)
    return d.withColumns({"comments_data": F.col("three"), "pull_request": F.lit(None).cast("string"), "_meta": _meta("issue")})


def raw_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _issue_like(documents(spark, sf_dir).filter("kind = 1"), 4)
    return d.withColumns({"comments_data": F.array("one"), "issue_comments_data": F.array("two"), "merged": F.col("doc_id") % 3 == 0, "_meta": _meta("pull_request")})


def raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).filter("kind = 2")
    login = F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("author")).alias("login"))
    name = F.struct(F.concat(F.lit("Dev "), (F.col("doc_id") % 7).cast("string")).alias("name"), F.col("created").alias("date"))
    commit = F.struct(F.col("body").alias("message"), name.alias("author"), F.struct(F.col("created").alias("date")).alias("committer"))
    return d.select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("sha"), login.alias("author"), commit.alias("commit"), "lang", _meta("commit").alias("_meta"), "source")


def raw_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).filter("kind = 3").withColumn("list", F.concat(F.lit("list"), (F.col("doc_id") % 5).cast("string")))
    none = F.lit(None).cast("string")
    reply = F.when(F.col("doc_id") % 8 == 7, F.concat(F.lit("m"), (F.col("doc_id") - 4).cast("string"))).when((F.col("doc_id") % 8 == 3) & (F.col("doc_id") % 5 == 0), F.concat(F.lit("mx"), F.col("doc_id").cast("string")))
    sender = F.when(F.col("doc_id") % 41 == 0, "jenkins@ci").otherwise(F.concat(F.lit(" "), F.col("author"), F.lit(" ")))
    subject = F.when(F.col("doc_id") % 17 == 3, F.concat(F.lit("Re: bug 12 "), cue(5))).otherwise(cue(5))
    headers = F.struct(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("message_id"), F.col("created").alias("date"), subject.alias("subject"), sender.alias("from"), none.alias("to"), none.alias("cc"), reply.alias("in_reply_to"), none.alias("references"), F.col("list").alias("list_id"))
    first = F.length(cue(0)).cast("int")
    way = F.expr("cast(doc_id div 4 % 3 as int)")
    last = F.when(way == 0, F.length("body")).when(way == 1, F.length("body") + 1).otherwise(F.octet_length("body")).cast("int")
    label = F.when(F.col("doc_id") % 16 == 3, "section_heading").when(F.col("doc_id") % 16 == 7, "quotation").when(F.col("doc_id") % 16 == 11, "log_data").otherwise("paragraph")
    span = lambda b, e, x: F.struct(b.alias("begin"), e.alias("end"), x.alias("label"))
    segments = F.array(span(first + 1, last, label), span(F.lit(0), first, F.lit("paragraph")), span(F.lit(5), F.lit(4), F.lit("paragraph")), span(F.lit(2), last + 60, F.lit("closing")))
    return d.select("doc_id", F.concat(F.lit("urn:"), F.col("doc_id").cast("string")).alias("urn"), headers.alias("headers"), F.col("body").alias("text_plain"), "lang", F.col("list").alias("group"), segments.alias("segments"), _meta("email", "list").alias("_meta"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand labels stand for the classifier: each labelled document's first unit has a verdict."""
    d = documents(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    unit = (
        F.when(F.col("kind") == 0, F.concat(F.lit("issue:"), "source", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":body")))
        .when(F.col("kind") == 1, F.concat(F.lit("pr:"), "source", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":body")))
        .when(F.col("kind") == 2, F.concat(F.lit("commit:"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(":commit_message")))
        .otherwise(F.concat(F.lit("email:urn:"), F.col("doc_id").cast("string"), F.lit(":paragraph:1")))
    )
    return d.select(unit.alias("text_unit_id"), F.lit("hand").alias("model_id"), F.lit("1").alias("model_version"), F.col("quality").cast("int").alias("label"), (F.lit(0.5) + (F.col("doc_id") % 50) / 100).cast("double").alias("confidence"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All artefacts as raw records of mixed types: JSON documents, some of a type that nothing reads."""
    made = [(raw_issues(spark, sf_dir), "issue", "issue", "source"), (raw_pulls(spark, sf_dir), "issue", "pull_request", "source"), (raw_commits(spark, sf_dir), "commit", None, "source"), (raw_emails(spark, sf_dir), "email", None, "group")]
    out = [d.select(F.lit(kind).alias("item_type"), F.lit(sub).cast("string").alias("item_subtype"), F.col(repo).alias("repo"), F.to_json(F.struct(*[c for c in d.columns if c not in ("doc_id", "three", "one", "two", "created", "source")])).alias("doc")) for d, kind, sub, repo in made]
    d = documents(spark, sf_dir)
    user = F.struct(F.concat(F.lit("ghost"), (F.col("doc_id") % 3).cast("string")).alias("login"))
    out.append(d.filter("doc_id % 50 = 1").select(F.lit("release"), F.lit(None).cast("string"), F.concat(F.lit("only-"), "source"), F.to_json(F.struct(user.alias("user"), F.col("body").alias("notes")))))
    out.append(d.filter("doc_id % 40 = 2").select(F.lit("repository"), F.lit(None).cast("string"), F.col("source"), F.to_json(F.struct(F.col("source").alias("full_name"), F.col("lang").alias("language"), F.col("doc_id").alias("stargazers_count")))))
    return reduce(DataFrame.union, out)
