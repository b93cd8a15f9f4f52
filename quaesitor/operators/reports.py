"""Report sinks, guards and samples that the analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header (quotes doubled, so line breaks in texts survive) or as JSON lines."""
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(kind)


def read_marks(spark, path: str, schema: str, column: str, allowed: tuple[str, ...] = ("yes", "no", "(ambiguous)")) -> DataFrame:
    """A hand-labelled CSV back again: rows whose mark is one of the allowed."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"').filter(F.lower(F.trim(column)).isin(*allowed))


def guard(df: DataFrame, column: str, predicate: Column) -> DataFrame:
    """Filters by the predicate where the table has the column; elsewhere it changes nothing."""
    return df.filter(predicate) if column in df.columns else df


def per_group_sample(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n rows of each group, by a hash of the key: the same rows in any run."""
    w = Window.partitionBy(*groups).orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def silent(expected: list[str], df: DataFrame, column: str) -> list[str]:
    """Which of the expected values a column lacks; the caller's list bounds it."""
    have = {r[0] for r in df.select(column).filter(F.col(column).isin(*expected)).distinct().collect()}
    return [x for x in expected if x not in have]
