"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from quaesitor.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return None if math.isnan(x) else round(float(x), 6)
    return str(x)


def same(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    got = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert same(df.columns, map(tuple, df.collect())) == same(got.columns, got.fetchall())


def test_every_query_has_sql_or_is_named():
    without = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert without == {"a12_classifier", "q402_unit_clusters", "q403_cluster_profile", "q404_exemplars", "q602b_p_value"}


def test_a_plan_reads_what_it_needs(spark, sf):
    plan = catalogue.queries()["s10_scope"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "text" not in plan[plan.rindex("ReadSchema") :]
