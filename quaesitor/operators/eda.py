"""Profiles of mailing lists and diagnoses of their spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import units

#: Labels of machine-made segments, hints of automated senders, templated subjects, terms of the pre-screen.
MACHINE = ("log_data", "patch", "raw_code", "tabular", "quotation_marker")
BOT_HINTS = ("noreply", "no-reply", "donotreply", "bugzilla", "jenkins", "buildbot", "cron", "daemon", "mailer-daemon", "automated")
TEMPLATED = r"(?i)^[ \t\n\r\f]*(\[?(bug|issue)[ \t\n\r\f]*[0-9]+\]?|re:[ \t\n\r\f]*\[?(bug|issue)[ \t\n\r\f]*[0-9]+\]?|\[jira\]|\[github\]|build (failed|succeeded|broken)|nightly|buildbot|jenkins|cron\b|svn commit|git commit|r[0-9]+[ \t\n\r\f]+-)"
PRESCREEN = ("not sure", "unclear", "unknown", "no idea", "don't know", "dunno", "maybe", "perhaps", "might be", "afaik", "iirc", "seems to", "hard to tell", "can't reproduce", "cannot reproduce")


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.lower(c).contains(t)
    return out


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(F.lit(100.0) * part, whole), 1), F.lit(0.0))


def span_table(emails: DataFrame) -> DataFrame:
    """A row per segment: group, urn, convention, i, label, begin, end, the text's length in characters and in the convention's units, kept label, valid."""
    s = units.with_segments(emails.select("urn", "group", "text_plain", "segments"))
    s = s.select("urn", "group", "convention", F.length("text_plain").alias("n"), units.limit_of(F.col("text_plain"), F.col("convention")).alias("limit"), F.explode_outer("spans").alias("s")).filter("s IS NOT NULL")  # a plain explode would have its condition pushed below and all spans made twice
    return s.select("group", "urn", "convention", "s.i", "s.label", "s.begin", "s.end", "n", "limit", F.col("s.label").isin(*units.KEPT_LABELS).alias("is_kept"), F.col("s.span").isNotNull().alias("valid"))


def segment_profile(emails: DataFrame) -> DataFrame:
    """Per group: shares of machine-made and paragraph segments, validity of the kept ones."""
    t = span_table(emails)
    n = lambda c: F.count_if(c)
    return t.groupBy(F.col("group").alias("grp")).agg(
        pct(n(F.col("label").isin(*MACHINE)), F.count("*")).alias("machine_segment_pct"),
        pct(n(F.col("label") == "paragraph"), F.count("*")).alias("paragraph_segment_pct"),
        pct(n(F.col("is_kept") & F.col("valid")), n(F.col("is_kept"))).alias("kept_span_valid_pct"),
    )


def mail_profile(emails: DataFrame, sample_rate: int = 1, langs: tuple[str, ...] = ("en",), least_tokens: int = 2) -> DataFrame:
    """Per group: automation, offset conventions, kept segments, yield and the pre-screen; yield uses the extraction itself.

    With every `sample_rate`-th message read, scaled figures stand for all. A unit is
    annotatable if its message has one of `langs` and no bot as its sender, and it has `least_tokens` words.
    """
    s = units.with_segments(emails.select("urn", "group", "text_plain", "segments", "lang", F.col("headers.from").alias("sender"), F.col("headers.subject").alias("subject")))
    texts = F.filter(F.concat(F.array(T.strip_text(F.col("subject"))), F.transform("kept", lambda k: k["text"])), lambda t: F.length(t) > 0)
    in_scope = F.coalesce("lang", F.lit("")).isin(*langs) & ~F.coalesce(F.trim("sender").endswith("[bot]"), F.lit(False))
    long = F.when(in_scope, F.size(F.filter("_texts", lambda t: T.n_words(t) >= least_tokens))).otherwise(0)
    s = s.withColumn("_texts", texts)
    n = F.count("*")
    return s.groupBy(F.col("group").alias("grp")).agg(
        pct(F.count_if(contains_any(F.col("sender"), BOT_HINTS)), n).alias("bot_from_pct"),
        pct(F.count_if(F.col("subject").rlike(TEMPLATED)), n).alias("templated_subject_pct"),
        pct(F.count_if(F.col("convention") == "utf8_bytes"), n).alias("utf8_bytes_doc_pct"),
        F.round(F.sum(F.size(F.filter("segments", lambda g: g["label"].isin(*units.KEPT_LABELS)))) / n, 2).alias("kept_segments_per_msg"),
        F.sum(F.size("_texts")).alias("est_text_units"),
        (sample_rate * F.sum(F.size("_texts"))).alias("est_text_units_scaled"),
        (sample_rate * F.sum(long)).alias("est_annotatable_units_scaled"),
        F.round(F.avg(F.length("text_plain")), 0).cast("long").alias("mean_chars_per_msg"),
        pct(F.count_if(contains_any(F.col("text_plain"), PRESCREEN)), n).alias("nk_prescreen_pct"),
    )


def real(begin: Column, end: Column) -> Column:
    """Whether offsets are a span at all."""
    return begin.isNotNull() & end.isNotNull() & (begin >= 0) & (end > begin)


def label_validity(emails: DataFrame) -> DataFrame:
    """Per label: segments that are spans at all, and how many of them lie within their text."""
    return span_table(emails).filter(real(F.col("begin"), F.col("end"))).groupBy("label").agg(F.count("*").alias("segments"), F.count_if("valid").alias("valid"))


def failing_segments(emails: DataFrame, limit: int = 8) -> DataFrame:
    """The first spans that leave their text, with the place of their end in it."""
    bad = span_table(emails).filter(real(F.col("begin"), F.col("end")) & ~F.col("valid"))
    return bad.select("urn", "i", "label", F.round(100.0 * F.col("end") / F.greatest("n", F.lit(1)), 1).alias("position_pct")).orderBy("urn", "i").limit(limit)


def convention_tally(emails: DataFrame) -> DataFrame:
    """Messages by offset convention, with those whose every span fits it (clean) and the others (partial); messages without spans are passed over."""
    t = span_table(emails).filter(real(F.col("begin"), F.col("end"))).withColumn("fits", F.col("end") <= F.col("limit"))
    per = t.groupBy("urn", "convention").agg(F.bool_and("fits").alias("clean"))
    return per.groupBy("convention").agg(F.count("*").alias("n"), F.count_if("clean").alias("clean"), F.count_if(~F.col("clean")).alias("partial"))


def convention_examples(emails: DataFrame, limit: int = 5) -> DataFrame:
    """The first messages of each convention other than char: (convention, urn, n_valid, n_total)."""
    t = span_table(emails).filter(real(F.col("begin"), F.col("end")) & (F.col("convention") != "char"))
    per = t.groupBy("convention", "urn").agg(F.count_if(F.col("end") <= F.col("limit")).alias("n_valid"), F.count("*").alias("n_total"))
    few = per.groupBy("convention").agg(F.slice(F.array_sort(F.collect_list(F.struct("urn", "n_valid", "n_total"))), 1, limit).alias("e"))
    return few.select("convention", F.explode("e").alias("e")).select("convention", "e.*")
