"""The command line over a small bulk file, and report helpers."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quaesitor import cli
from quaesitor.operators import reports


@pytest.fixture(scope="module")
def bulk(tmp_path_factory):
    path = tmp_path_factory.mktemp("bulk") / "a.gz"
    body = "I'm not sure this works.\n\n> quoted\n"
    with gzip.open(path, "wt") as f:
        for k in range(6):
            urn = f"<urn:uuid:{k % 5}>"
            doc = {"headers": {"subject": f"Subject {k}", "from": "a"}, "text_plain": body, "lang": "en" if k else "de", "group": f"g{k % 2}", "segments": [{"begin": 0, "end": 24, "label": "paragraph"}, {"begin": 26, "end": 34, "label": "quotation"}]}
            f.write(json.dumps({"index": {"_id": urn}}) + "\n" + json.dumps(doc) + "\n")
    return str(path)


def call(spark, *argv):
    return cli.run(cli.parser().parse_args(list(argv)), spark)


def test_commands(spark, bulk, tmp_path):
    assert {r.grp: r.messages for r in call(spark, "inventory", bulk).collect()} == {"g0": 3, "g1": 2}
    assert call(spark, "inventory", bulk, "--langs", "de", "--least", "1").count() == 1
    assert {r.kept_span_valid_pct for r in call(spark, "profile", bulk).collect()} == {100.0}
    assert {(r.label, r.segments) for r in call(spark, "diagnose", bulk).collect()} == {("paragraph", 5), ("quotation", 5)}
    units = call(spark, "extract", bulk)
    assert units.filter("role = 'paragraph'").count() == 5 and units.filter("role = 'quotation'").count() == 0
    assert call(spark, "ingest", bulk, "--out", str(tmp_path / "mails"), "--max", "2") is None
    assert spark.read.parquet(str(tmp_path / "mails")).count() == 2
    units.write.parquet(str(tmp_path / "units"))
    signals = call(spark, "annotate", str(tmp_path / "units"), "--out", str(tmp_path / "signals"), "--format", "json")
    assert signals.filter("rule_id = 'lex.not_sure'").count() == 5
    assert spark.read.json(str(tmp_path / "signals")).count() == signals.count()
    assert call(spark, "enrich", str(tmp_path / "units")).count() == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x\n"y"', "Yes "), ("a", "z", "later"), ("b", "w", "no")], "rule string, text string, mark string")
    reports.write_report(df, str(tmp_path / "r"))
    back = reports.read_marks(spark, str(tmp_path / "r"), "rule string, text string, mark string", "mark")
    assert sorted(r.text for r in back.collect()) == ["w", 'x\n"y"']
    assert reports.guard(df, "sandbox", F.lit(False)).count() == 3 and reports.guard(df, "rule", F.col("rule") == "a").count() == 2
    assert reports.per_group_sample(df, ["rule"], "text", 1).count() == 2
    assert reports.silent(["a", "c"], df, "rule") == ["c"]
    with pytest.raises(ValueError):
        reports.write_report(df, str(tmp_path / "q"), "xml")
