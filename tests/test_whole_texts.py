"""The engine and the SQL forms read whole texts: a few long documents whose marks stand at the end."""

import duckdb
import pytest

from quaesitor.plans import catalogue, fixture
from tests.test_oracle import TABLES, same

NAMES = ["p05_text_units", "p09_email_units", "p13_final_spans", "a01_tokens", "a02_signals", "f19_prescreen", "s04_commit_listing", "e08_length_buckets", "x13_references"]


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """The smallest tables with 12 documents: padding, and what is to be found after it."""
    root = tmp_path_factory.mktemp("whole")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"COPY (SELECT * FROM '{sf}/{t}.parquet') TO '{root}/{t}.parquet' (FORMAT parquet)")
    pad = "plain words of no account ü "
    for part in ("documents",):
        c.sql(f"""COPY (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN repeat('{pad}', 250) ELSE repeat('{pad}', 60) END || 'It is unclear, fixes #' || doc_id || '. We have no idea why?' AS text, lang, source, n_chars
            FROM '{sf}/{part}.parquet' ORDER BY doc_id LIMIT 12) TO '{root}/{part}.parquet' (FORMAT parquet)""")
    return str(root)


def test_bodies_are_whole(spark, small):
    for r in fixture.documents(spark, small).collect():
        assert r.body.endswith(" " + r.text) and len(r.text) > 800


@pytest.mark.parametrize("name", NAMES)
def test_equal_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = con.sql(catalogue.oracle_sql()[name])
    df = catalogue.queries()[name](spark, small)
    assert sorted(df.columns) == sorted(got.columns)
    assert same(df.columns, map(tuple, df.collect())) == same(got.columns, got.fetchall())


def test_language_is_told_from_the_whole_body(spark, small):
    """The frequent words of the first 1,000 characters, counted in Python."""
    from quaesitor.plans import steps

    got = {r.doc_id: r.guess for r in catalogue.queries()["p02_language"](spark, small).collect()}
    for r in fixture.documents(spark, small).collect():
        words = r.body[:1000].lower().split()
        hits = {k: sum(w in ws for w in words) for k, ws in steps.STOP.items()}
        best = max(hits.values())
        assert got[r.doc_id] == (next(k for k, v in hits.items() if v == best) if best else None)


def test_long_buckets_are_filled(spark, small):
    assert {"1k-5k", "5k+"} <= {v for r in catalogue.queries()["e08_length_buckets"](spark, small).collect() for v in r if isinstance(v, str)}
