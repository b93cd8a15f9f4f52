"""Command line: python -m quaesitor.cli COMMAND ... over landed artefacts and bulk mail."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate, eda, graph, reports, units
from .sources import landing
from .streaming import pipeline


def bulk(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The mails of bulk files in scope, each urn once, at most --max of them."""
    mails = landing.parse_bulk(landing.pair_bulk(landing.bulk_lines(spark, a.path)))
    mails = mails.filter(landing.in_scope(F.col("group"), F.col("lang"), a.groups, a.langs)).dropDuplicates(["urn"])
    return mails.limit(a.max) if a.max else mails


def run(a: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    if a.command == "ingest":
        bulk(spark, a).write.mode("overwrite").parquet(a.out)
        return None
    if a.command == "inventory":
        df = bulk(spark, a).groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("messages"), F.count_distinct("lang").alias("n_langs"), F.mode("lang").alias("top_lang")).filter(F.col("messages") >= a.least).orderBy(F.desc("messages"), "grp")
    elif a.command == "profile":
        mails = bulk(spark, a)
        df = eda.mail_profile(mails).join(eda.segment_profile(mails), "grp").orderBy("grp")
    elif a.command == "diagnose":
        df = eda.label_validity(bulk(spark, a))
    elif a.command == "extract":
        df = units.from_emails(bulk(spark, a))
    elif a.command == "annotate":
        df = annotate.signals(spark.read.parquet(a.path), a.rules)
    elif a.command == "enrich":
        from .plans.catalogue import references

        u = spark.read.parquet(a.path)
        df = graph.reference_edges(references(u), u.filter("parent_type = 'issue'"))
    else:
        pipeline.two_stages(spark, a.path, a.out, a.rules)
        return None
    if a.out:
        reports.write_report(df, a.out, a.format)
    return df


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quaesitor")
    p.add_argument("command", choices=["ingest", "inventory", "profile", "diagnose", "extract", "annotate", "enrich", "stream"])
    p.add_argument("path")
    p.add_argument("--out")
    p.add_argument("--format", choices=["csv", "json"], default="csv")
    p.add_argument("--groups", nargs="*")
    p.add_argument("--langs", nargs="*")
    p.add_argument("--max", type=int, default=0)
    p.add_argument("--least", type=int, default=1)
    p.add_argument("--rules", choices=["0.1", "0.2"], default="0.2")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    df = run(a, SparkSession.builder.appName("quaesitor").getOrCreate())
    if df is not None and not a.out:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
