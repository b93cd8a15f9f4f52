"""All queries of the engine with their SQL forms, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annotate, units
from . import analysis, checks, duck, fixture, steps

Query = Callable[[SparkSession, str], DataFrame]

#: Roles in which references are looked for.
REFERENCE_ROLES = ("body", "commit_message", "comment_body")

_kept: dict[tuple, DataFrame] = {}


def _shared(spark: SparkSession, sf_dir: str, name: str, make: Query) -> DataFrame:
    """A base relation that many queries read, kept while the session's queries are over the same tables; what an executor loses is made again from its lineage."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    for other in [k for k in _kept if k[:2] != key[:2]]:
        df = _kept.pop(other)
        if other[0] == key[0]:
            df.unpersist()
    if key not in _kept:
        _kept[key] = make(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _kept[key]


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.extract(fixture.raw_issues(spark, sf_dir), fixture.raw_pulls(spark, sf_dir), fixture.raw_commits(spark, sf_dir), fixture.raw_emails(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.signals(_shared(spark, sf_dir, "text_units", text_units))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("headers")
    return fixture.raw_emails(spark, sf_dir).select("doc_id", "urn", h["message_id"].alias("message_id"), h["in_reply_to"].alias("in_reply_to"), h["from"].alias("sender"), h["subject"].alias("subject"), F.col("group").alias("list"), "lang", h["date"].alias("created"), F.col("text_plain").alias("body"))


def replies(m: DataFrame) -> DataFrame:
    """(reply, parent): a reply finds the messages of its id, never itself; a repeated id gives several parents."""
    r, p = m.alias("r"), m.alias("p")
    return r.join(p, (F.col("r.in_reply_to") == F.col("p.message_id")) & (F.col("r.urn") != F.col("p.urn"))).select(F.col("r.urn").alias("reply"), F.col("p.urn").alias("parent")).distinct()


def references(u: DataFrame) -> DataFrame:
    """(text_unit_id, parent_id, parent_number, repo, place, number, mechanism) of the units in reference roles."""
    found = u.filter(F.col("role").isin(*REFERENCE_ROLES)).select("text_unit_id", "parent_id", "parent_number", "repo", F.posexplode(T.references(F.col("text"))).alias("place", "r"))
    return found.select("text_unit_id", "parent_id", "parent_number", "repo", "place", "r.number", "r.mechanism")


def views(spark: SparkSession, sf_dir: str) -> None:
    """Registers the base relations for the analysis queries."""
    u, s = _shared(spark, sf_dir, "text_units", text_units), _shared(spark, sf_dir, "signals", signals)
    m = mails(spark, sf_dir)
    for name, df in {"text_units": u, "signals": s, "nk": s.filter(annotate.is_evidence()), "verdicts": fixture.verdicts(spark, sf_dir), "mails": m, "replies": replies(m), "refs": references(u)}.items():
        df.createOrReplaceTempView(name)


def _analysis(body: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(analysis.render(body, "spark"))

    return run


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"p05_text_units": text_units, "a02_signals": signals}
    out |= steps.queries()
    return out | {name: _analysis(body) for name, body in analysis.BODIES.items()} | steps.PLANNED


def oracle_sql() -> dict[str, str]:
    base = duck.base()
    out = {"p05_text_units": base + "SELECT * FROM text_units", "a02_signals": base + "SELECT * FROM signals"}
    out |= steps.oracle_sql()
    for name, body in analysis.BODIES.items():
        body = checks.BODIES.get(name) or analysis.render(body, "duck")
        out[name] = base + ("," + body.removeprefix("WITH") if body.startswith("WITH ") else body)
    return out
