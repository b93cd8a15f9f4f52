"""What the larger queries move: cut texts, ids, chosen rows; and cleaning that is left out where it changes nothing."""

import pytest
from pyspark.sql import functions as F

from quaesitor.functions import text as T
from quaesitor.operators import annotate
from quaesitor.plans import catalogue, steps


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_before_they_meet_the_ids(spark, sf):
    p = plan(catalogue.queries()["j14_ids_to_text"](spark, sf))
    assert p.index("Join") < p.index(", 400)")


def test_the_sample_is_chosen_before_its_texts(spark, sf):
    p = plan(catalogue.queries()["q502_marker_only_sample"](spark, sf))
    assert p.count("strategy=broadcast") >= 2


def test_exemplars_are_broadcast_to_the_texts(spark):
    members = spark.createDataFrame([("a", str(k), k) for k in range(40)], "cluster string, text_unit_id string, total long")
    got = steps.exemplars(members, members.select("text_unit_id", F.lit("x" * 500).alias("text")))
    assert "strategy=broadcast" in plan(got)
    assert sorted((r.kind, len(r.text)) for r in got.collect()) == [("random", 400)] * 10 + [("top", 400)] * 5


def test_bigrams_are_rows_without_arrays_of_pairs(spark):
    units = spark.createDataFrame([("1", "Do n't cannot"), ("2", "one"), ("3", ""), ("4", None)], "text_unit_id string, text string")
    got = annotate.bigrams(units)
    assert "zip_with" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [("1", "'", "t"), ("1", "can", "not"), ("1", "do", "n"), ("1", "n", "'"), ("1", "t", "can")]


@pytest.mark.parametrize("text", [None, "", " plain ", "a\n\n\nb", "> q\nx", "`c`d", "![a](b)!", "<!-- n -->z", "@me hi", "a\n\nb"])
def test_a_text_without_marks_is_not_searched(spark, text):
    d = spark.createDataFrame([(text,)], "x string")
    got = d.select(T.strip_text(F.col("x")).alias("a"), T.strip_ends(T.strip_steps(F.col("x"))[-1]).alias("b")).first()
    assert got.a == got.b
    assert "Contains(" in plan(spark.range(1).select(T.strip_text(F.col("id").cast("string")))) or "contains(" in plan(spark.range(1).select(T.strip_text(F.col("id").cast("string")))).lower()
