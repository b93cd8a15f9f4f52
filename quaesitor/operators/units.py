"""Cuts artefacts into text units: identifiers, positions, offsets and cleaned text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

UNIT = ["text_unit_id", "parent_id", "parent_type", "repo", "parent_number", "role", "position", "text", "lang", "token_count", "sha256", "author_login", "created_at"]
KEPT_LABELS = ("paragraph", "section_heading")


def unit_id(parent: Column, role: Column, position: Column) -> Column:
    return F.when(position < 2, F.concat_ws(":", parent, role)).otherwise(F.concat_ws(":", parent, role, position.cast("string")))


def finish(df: DataFrame, clean: bool = True) -> DataFrame:
    """Cleans `text`, drops units left empty, adds the token count and the hash."""
    text = T.strip_text(F.col("text")) if clean else F.col("text")
    df = df.withColumn("text", text).filter(F.length("text") > 0)
    return df.withColumns({"token_count": T.n_words(F.col("text")), "sha256": F.sha2("text", 256)}).select(*UNIT)


def _rows(df: DataFrame, entries: Column) -> DataFrame:
    """A row for each struct<role, position, text, author_login, created_at> of the array."""
    return df.withColumn("_e", F.explode(entries)).select("parent_id", "parent_type", "repo", "parent_number", "lang", "_e.*").withColumn("text_unit_id", unit_id(F.col("parent_id"), F.col("role"), F.col("position")))


def _entry(role: str, position: int, text: Column, author: Column, created: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(position).alias("position"), text.alias("text"), author.alias("author_login"), created.alias("created_at"))


def _discussion(df: DataFrame, kind: Column, prefix: Column, comments: Column) -> DataFrame:
    """Title 0, body 1, comments from 2 by their place in the whole array, so an empty one leaves a gap."""
    df = df.withColumns({"parent_id": F.concat_ws(":", prefix, "_meta.repo_full_name", F.col("number").cast("string")), "parent_type": kind, "repo": F.col("_meta.repo_full_name"), "parent_number": F.col("number"), "lang": F.col("lang") if "lang" in df.columns else F.lit(None).cast("string")})
    head = [_entry("title", 0, F.col("title"), F.col("user.login"), F.col("created_at")), _entry("body", 1, F.col("body"), F.col("user.login"), F.col("created_at"))]
    tail = F.transform(comments, lambda c, i: F.struct(F.lit("comment_body").alias("role"), (i + 2).alias("position"), c["body"].alias("text"), c["user"]["login"].alias("author_login"), c["created_at"].alias("created_at")))
    return finish(_rows(df, F.concat(F.array(*head), tail)))


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.array())


def from_issues(raw: DataFrame) -> DataFrame:
    """An issue that carries a pull request is one."""
    is_pull = F.col("pull_request").isNotNull()
    kind = F.when(is_pull, "pull_request").otherwise("issue")
    return _discussion(raw, kind, F.when(is_pull, "pr").otherwise("issue"), _or_empty("comments_data"))


def from_pulls(raw: DataFrame) -> DataFrame:
    """Review comments first, then issue comments."""
    return _discussion(raw, F.lit("pull_request"), F.lit("pr"), F.concat(_or_empty("comments_data"), _or_empty("issue_comments_data")))


def from_commits(raw: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    df = raw.select(
        F.concat_ws(":", F.lit("commit"), "sha").alias("parent_id"), F.lit("commit").alias("parent_type"), F.col("_meta.repo_full_name").alias("repo"), F.lit(None).cast("int").alias("parent_number"),
        F.lit("commit_message").alias("role"), F.lit(0).alias("position"), F.col("commit.message").alias("text"), (F.col("lang") if "lang" in raw.columns else none).alias("lang"),
        F.coalesce("author.login", "commit.author.name").alias("author_login"), F.col("commit.committer.date").alias("created_at"),
    )
    return finish(df.withColumn("text_unit_id", unit_id(F.col("parent_id"), F.col("role"), F.col("position"))))


def limit_of(text: Column, kind: str | Column) -> Column:
    """The length of a text in the units of a convention."""
    chars, utf8, utf16 = F.length(text), F.octet_length(text), (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")
    if isinstance(kind, str):
        return {"char": chars, "utf8_bytes": utf8, "utf16_units": utf16}[kind]
    return F.when(kind == "utf8_bytes", utf8).when(kind == "utf16_units", utf16).otherwise(chars)


def convention(text: Column, segments: Column) -> Column:
    """The offset convention that most spans of a text fit: ties go to char, then utf8_bytes, then utf16_units."""
    real = F.filter(segments, lambda s: s["begin"].isNotNull() & s["end"].isNotNull() & (s["begin"] >= 0) & (s["end"] > s["begin"]))
    fit = lambda kind: F.size(F.filter(real, lambda s: s["end"] <= limit_of(text, kind)))
    chars, utf8, utf16 = fit("char"), fit("utf8_bytes"), fit("utf16_units")
    best = F.greatest(chars, utf8, utf16)
    return F.when(chars == best, "char").when(utf8 == best, "utf8_bytes").otherwise("utf16_units")


def resolve(text: Column, begin: Column, end: Column, kind: Column) -> Column:
    """struct<b, e> in characters, or null: not a span, out of bounds by more than the overshoot, or cut to nothing."""
    to = lambda n: F.when(kind == "utf8_bytes", T.utf8_to_chars(text, n)).when(kind == "utf16_units", T.utf16_to_chars(text, n)).otherwise(n)
    n = F.length(text)
    b, e = to(begin), to(end)
    ok = begin.isNotNull() & end.isNotNull() & (begin >= 0) & (end > begin)
    e = F.when((b < n) & (e > n) & (e <= n + T.OVERSHOOT), n).otherwise(e)
    return F.when(ok & (e <= n) & (b < e), F.struct(b.cast("int").alias("b"), e.cast("int").alias("e")))


def with_segments(raw: DataFrame, labels: tuple[str, ...] = KEPT_LABELS) -> DataFrame:
    """Adds convention and kept: array<struct<label, raw text of the span>> in order of (begin, end, place)."""
    df = raw.withColumn("segments", _or_empty("segments")).withColumn("text_plain", F.coalesce("text_plain", F.lit("")))
    df = df.withColumn("convention", convention(F.col("text_plain"), F.col("segments")))
    order = F.array_sort(F.transform("segments", lambda s, i: F.struct(F.coalesce(s["begin"], F.lit(0)).alias("o1"), F.coalesce(s["end"], F.lit(0)).alias("o2"), i.alias("i"), s["begin"].alias("begin"), s["end"].alias("end"), s["label"].alias("label"))))
    spans = F.transform(order, lambda s: F.struct(s["label"].alias("label"), s["i"].alias("i"), s["begin"].alias("begin"), s["end"].alias("end"), resolve(F.col("text_plain"), s["begin"], s["end"], F.col("convention")).alias("span")))
    df = df.withColumn("spans", spans)
    good = F.filter("spans", lambda s: s["label"].isin(*labels) & s["span"].isNotNull())
    cut = F.transform(good, lambda s: F.struct(s["label"].alias("label"), T.strip_text(F.substring("text_plain", s["span"]["b"] + 1, s["span"]["e"] - s["span"]["b"])).alias("text")))
    return df.withColumn("kept", F.filter(cut, lambda s: F.length(s["text"]) > 0))


def from_emails(raw: DataFrame, labels: tuple[str, ...] = KEPT_LABELS) -> DataFrame:
    """The subject, and the kept segments numbered from 1 in order; quotations are never kept by default."""
    flat = raw.filter(F.col("urn").isNotNull()).select("urn", F.col("group").alias("repo"), "lang", "text_plain", "segments", F.col("headers.subject").alias("subject"), F.nullif(F.trim("headers.from"), F.lit("")).alias("author"), F.col("headers.date").alias("sent"))
    df = with_segments(flat, labels)
    head = F.array(_entry("subject", 0, F.col("subject"), F.col("author"), F.col("sent")))
    tail = F.transform("kept", lambda s, i: F.struct(s["label"].alias("role"), (i + 1).alias("position"), s["text"].alias("text"), F.col("author").alias("author_login"), F.col("sent").alias("created_at")))
    df = df.select(F.concat_ws(":", F.lit("email"), "urn").alias("parent_id"), F.lit("email").alias("parent_type"), "repo", F.lit(None).cast("int").alias("parent_number"), "lang", F.explode(F.concat(head, tail)).alias("_e"))
    df = df.select("parent_id", "parent_type", "repo", "parent_number", "lang", "_e.*")
    numbered = F.when(F.col("role") == "subject", F.concat_ws(":", "parent_id", "role")).otherwise(F.concat_ws(":", "parent_id", "role", F.col("position").cast("string")))
    return finish(df.withColumn("text_unit_id", numbered))


def extract(issues: DataFrame, pulls: DataFrame, commits: DataFrame, emails: DataFrame) -> DataFrame:
    """All units; of a unit that comes from several sources the first stays, pulls before issues.

    Only what the issue listing calls a pull request can come twice; the other
    units of a listing are not shuffled. A record that a listing repeats is not
    looked for here: listings are made distinct when they are read.
    """
    first = from_pulls(pulls)
    flagged = F.col("pull_request").isNotNull()
    again = from_issues(issues.filter(flagged)).join(first.select("text_unit_id"), "text_unit_id", "left_anti").select(*UNIT)
    return reduce(DataFrame.unionByName, [first, from_issues(issues.filter(~flagged)), again, from_commits(commits), from_emails(emails)])
