"""Upserts, statistics, streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaesitor.operators import annotate, graph, stats
from quaesitor.streaming import pipeline


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert(spark):
    t = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "k int, once string, each int")
    b = spark.createDataFrame([(2, "new", 5, 1), (2, "later", 6, 2), (3, "new", 7, 1), (3, "later", None, 2)], "k int, once string, each int, seq int")
    out = graph.upsert(t, b, ["k"], ["once"], ["each"], [F.col("seq")])
    assert rows(out) == [(1, "old", 0), (2, "old", 6), (3, "new", None)]
    assert rows(graph.upsert(out, b, ["k"], ["once"], ["each"], [F.col("seq")])) == rows(out)  # again changes nothing
    assert rows(graph.upsert(t.filter("false"), b.filter("false"), ["k"], ["once"], ["each"], [F.col("seq")])) == []


def test_key_only_upsert_and_snapshots(spark, tmp_path):
    t = spark.createDataFrame([("a",)], "name string")
    out = graph.upsert_named("mailing_list", t, spark.createDataFrame([("a",), ("b",)], "name string"), [])
    assert rows(out) == [("a",), ("b",)]
    path = graph.write_snapshot(out, str(tmp_path), "mailing_list", 1)
    assert spark.read.parquet(path).count() == 2


def test_reference_edges_keep_the_first(spark):
    refs = spark.createDataFrame([("u1", "issue:r:1", "r", 0, 2, "fixes"), ("u2", "issue:r:1", "r", 0, 2, "see"), ("u1", "issue:r:1", "r", 1, 9, "bare")], "text_unit_id string, parent_id string, repo string, place int, number int, mechanism string")
    issues = spark.createDataFrame([("issue:r:2",)], "parent_id string")
    assert rows(graph.reference_edges(refs, issues)) == [("issue:r:1", "issue:r:2", "fixes", "u1")]


@pytest.mark.parametrize("x, dof, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (0.0, 3, 1.0), (16.918977604620448, 9, 0.05), (2.0, 2, math.exp(-1))])
def test_chi_square_p(x, dof, p):
    assert stats.chi_square_p(x, dof) == pytest.approx(p, abs=1e-10)


def test_ward_joins_the_nearest_first():
    merges = stats.ward(np.array([[0.0, 0], [0, 1], [9, 9], [9, 10.5]]))
    assert [m[:2] for m in merges[:2]] == [(0, 1), (2, 3)] and len(merges) == 3 and merges[0][2] == pytest.approx(1.0)


def test_clusters(spark):
    df = spark.createDataFrame([(str(k), k % 3 * 10 + math.sin(k), k % 3 + math.cos(3 * k) / 10) for k in range(60)], "id string, a double, b double")
    out, scores = stats.clusters(df, ["a", "b"], range(2, 5))
    assert out.select("cluster").distinct().count() == 3 and max(scores, key=scores.get) == 3
    assert stats.recall_estimate(8, 4, 0.5) == 0.8 and stats.recall_estimate(0, 0, 1) is None


def test_two_stages_equal_batch_and_replay_adds_nothing(spark, tmp_path):
    texts = {"u1": "I'm not sure it works.", "u2": "Perhaps. Why?", "u3": "All fine."}
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"text_unit_id": k, "text": t}) for k, t in texts.items()]
    (tmp_path / "in" / "1.txt").write_text("\n".join([*lines, "broken", lines[0]]))
    out = str(tmp_path / "out")
    pipeline.two_stages(spark, str(tmp_path / "in"), out)
    want = rows(annotate.signals(spark.createDataFrame(list(texts.items()), "text_unit_id string, text string")).select("signal_id"))
    assert rows(spark.read.parquet(f"{out}/signals").select("signal_id")) == want
    (tmp_path / "in" / "2.txt").write_text("\n".join(lines))
    pipeline.two_stages(spark, str(tmp_path / "in"), out)
    assert rows(spark.read.parquet(f"{out}/signals").select("signal_id")) == want
    assert spark.read.parquet(f"{out}/text_units").count() == 3


def test_events(spark):
    lines = spark.createDataFrame([('{"item_id":"1","mongo_id":"a"}',), ("broken",), ('{"item_id":"2","mongo_id":"z"}',)], "value string")
    docs = spark.createDataFrame([("a", "doc")], "_id string, body string")
    found, missing = pipeline.lookup(pipeline.events(lines), docs)
    assert [r.item_id for r in found.collect()] == ["1"] and [r.item_id for r in missing.collect()] == ["2"]


RECORDS = [
    ("issue", "issue", "r", '{"number":1,"title":"Perhaps","user":{"login":"ann"},"labels":[{"name":"bug"}],"created_at":"1"}'),
    ("issue", "pull_request", "r", '{"number":2,"title":"Fix","body":"new body","user":{"login":""}}'),
    ("issue", "issue", "r", '{"number":2,"title":"Fix","body":"old body","pull_request":{"url":"x"},"user":{"login":"ann"}}'),
    ("issue", "issue", "r", '{"number":3,"title":"Only here","pull_request":{"url":"x"}}'),
    ("commit", None, "r", '{"sha":"a","author":{"login":"ann"},"commit":{"message":"one\\ntwo"}}'),
    ("commit", None, "r", '{"sha":"b","author":{"login":"nobody"},"commit":{"message":""}}'),
    ("email", None, "r", '{"urn":"u","headers":{"from":" bob ","subject":"Hello"},"group":"g"}'),
    ("email", None, "r", '{"headers":{"from":"eve"}}'),
    ("email", None, "r", '{"urn":"w","headers":{"from":" "}}'),
    ("release", None, "other", '{"user":{"login":"ghost"}}'),
    ("issue", "issue", "r", "broken"),
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RECORDS, "item_type string, item_subtype string, repo string, doc string")


def test_dispatch(raw):
    from quaesitor.operators import dispatch

    assert {r.login for r in dispatch.actors(raw).collect()} == {"ann", "bob", "ghost"}
    assert {r.full_name for r in dispatch.repositories(raw).collect()} == {"r", "other"}
    got = {tuple(r) for r in dispatch.edges(raw).collect()}
    assert got >= {("CONTAINS", "repo:r", "issue:r:1"), ("CONTAINS", "repo:r", "pr:r:2"), ("AUTHORED", "ann", "issue:r:1"), ("AUTHORED", "ann", "commit:a"), ("CONTAINS", "repo:r", "commit:b"), ("CONTAINS", "list:g", "email:u"), ("AUTHORED", "bob", "email:u")}
    assert not [e for e in got if e[1] in ("", "nobody", "eve") or e[2] == "email:w"]
    assert [r.message_summary for r in dispatch.nodes(raw, "commit").orderBy("sha").collect()] == ["one", ""]
    assert dispatch.edges(raw.filter("false")).count() == 0 and dispatch.text_units(raw.filter("false")).count() == 0


def test_a_unit_of_two_listings_is_one(raw):
    from quaesitor.operators import dispatch

    got = {r.text_unit_id: r.text for r in dispatch.text_units(raw).collect()}
    assert got["pr:r:2:body"] == "new body" and got["pr:r:3:title"] == "Only here" and got["email:u:subject"] == "Hello"
    assert dispatch.text_units(raw).count() == len(got)


def test_sentinels(spark):
    from quaesitor.operators import dispatch

    s = spark.createDataFrame([("a", {"__verdict__": "true"}), ("b", {"x": "1"}), ("c", None)], "id string, payload map<string,string>")
    plain, verdicts = dispatch.sentinels(s)
    assert rows(plain.select("id")) == [("b",), ("c",)] and rows(verdicts.select("id")) == [("a",)]


def test_utf16_offsets(spark):
    from quaesitor.functions import text as T

    s = "a😀bü😀"
    df = spark.createDataFrame([(s, n) for n in range(len(s.encode("utf-16-le")) // 2 + 1)], "t string, n int")
    for r in df.select("n", T.utf16_to_chars(F.col("t"), F.col("n")).alias("c")).collect():
        assert r.c == len(s.encode("utf-16-le")[: 2 * r.n].decode("utf-16-le", "ignore"))


def test_a_malformed_rule_and_a_failing_layer_are_left_out(spark, monkeypatch):
    from quaesitor.operators import rules, rulesets

    whole, given = len(rules.alternatives("0.2")), rulesets.table
    monkeypatch.setattr(rulesets, "table", lambda kind, version: given(kind, version) + [["broken", None]])
    rules.alternatives.cache_clear(), rules.affixes.cache_clear()
    assert len(rules.alternatives("0.2")) == whole and len(rules.affixes("0.2")) == 9
    rules.alternatives.cache_clear(), rules.affixes.cache_clear()

    def fails(units, version):
        raise RuntimeError("no model")

    units = spark.createDataFrame([("u", "Perhaps it is unclear.")], "text_unit_id string, text string")
    with_it = annotate.signals(units, layers={"bad": fails, **annotate.LAYERS})
    assert rows(with_it) == rows(annotate.signals(units)) and with_it.count() > 0


def test_exemplars_by_brute_force(spark):
    from quaesitor.plans import steps

    members = [(k % 3, f"u{k}", k * 7 % 11) for k in range(70)] + [(9, "only", 1)]
    m = spark.createDataFrame(members, "cluster int, text_unit_id string, total long")
    got = {(r.cluster, r.text_unit_id, r.kind) for r in steps.exemplars(m, m.select("text_unit_id", F.lit("t").alias("text"))).collect()}
    from hashlib import md5

    want = set()
    for c in {x[0] for x in members}:
        own = sorted(((u, t) for k, u, t in members if k == c), key=lambda x: (-x[1], x[0]))
        want |= {(c, u, "top") for u, _ in own[:5]} | {(c, u, "random") for u, _ in sorted(own[5:], key=lambda x: md5(x[0].encode()).hexdigest())[:10]}
    assert got == want


def test_clusters_are_where_lloyd_stops(spark):
    """Each row has the nearest of its clusters' centres, in standard units: what k-means ends in."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in ((0, 0, 0), (4, 0, 2), (0, 5, 5), (6, 6, 0))])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id int, a double, b double, c double")
    out, scores = stats.clusters(df, ["a", "b", "c"])
    label = np.array([r.cluster for r in out.orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    centres = np.array([z[label == c].mean(axis=0) for c in range(label.max() + 1)])
    assert (np.argmin(((z[:, None] - centres) ** 2).sum(axis=2), axis=1) == label).all()
    assert set(scores) == set(range(3, 11)) and max(scores, key=scores.get) == 4 == label.max() + 1


def test_saved_then_published(spark, tmp_path):
    from quaesitor.sources import publish

    raw = spark.createDataFrame([("issue", "r", '{"id":1,"pull_request":null}'), ("issue", "r", '{"id":2}'), ("issue", "r", '{"id":2,"x":1}'), ("commit", "r", '{"sha":"a"}'), ("issue", "r", '{"id":0,"number":7}'), ("email", "r", '{"urn":"u"}'), ("issue", "r", None)], "item_type string, repo string, doc string")
    got = {(r.item_type, r.item_id): r for r in publish.save(publish.keyed(raw).filter("false"), raw).collect()}
    assert set(got) == {("issue", "1"), ("issue", "2"), ("commit", "a"), ("issue", "7")} and got["issue", "1"].item_subtype == "pull_request"
    store = publish.save(publish.keyed(raw).filter("false"), raw)
    assert rows(publish.save(store, raw)) == rows(store)
    publish.publish(raw, str(tmp_path / "raw"))
    assert rows(pipeline.events(spark.read.text(str(tmp_path / "raw"))).select("item_type", "item_id")) == sorted(set(got), key=str)
