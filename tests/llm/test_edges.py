"""Nulls, blank and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from quaesitor.llm import decontaminate, embeddings, html, licences, mixing, sharding, simhash, tokens, toxicity, urls

LONG = "word " * 60_000 + "end"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s1"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "s1"),
    (2, None, None, "s1"),
    (3, "", "en", None),
    (4, " \t\n ", "de", "s2"),
    (None, "no id here at all", "en", "s1"),
    (5, LONG, "en", "s1"),
    (6, "Released under the MIT License.\nstupid idiot words", "en", "s2"),
]
CLASHING = ["weight", "probability", "kept", "id", "fp", "key", "cell", "items", "pos", "raw", "tpl", "a", "b", "u", "v", "n", "score", "tokens", "_tokens", "_kept", "_0", "_f0", "component_id", "least", "h", "words"]


@pytest.fixture(scope="module")
def messy(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"x{k}") for k, c in enumerate(CLASHING)})


@pytest.fixture(scope="module")
def none(messy):
    return messy.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (4, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "x"), (1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string").withColumn("doc_id", F.lit(9))


def test_mixing(messy, none):
    out = mixing.mix(messy, {"source": 0.5, "lang": 0.5, "topic": 0.5}, 0.9).collect()
    assert len(out) == len(ROWS) and len({r.kept for r in out if r.doc_id == 1}) == 1
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (2, 3, 4))
    assert mixing.mix(none, {"source": 0.5}, 0.9).count() == 0
    kept = mixing.sampled(messy, {"source": 0.5, "lang": 0.5}, 0.9)
    assert kept.columns == messy.columns and mixing.sampled(none, {"source": 0.5}, 0.9).count() == 0


def test_tokens(messy, none):
    out = {r.doc_id: r for r in tokens.token_counts(messy, "word_bpe_49k.json").collect()}
    assert out[2].n_tokens == out[3].n_tokens == out[4].n_tokens == 0 and out[4].n_bytes == 4
    assert out[5].n_tokens == 60_001 and out[5].over_limit and not out[1].over_limit
    assert tokens.token_counts(none, "word_bpe_49k.json").count() == 0


def test_urls(spark, labels):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Com/en/1"), (4, "http://A.Com/en/1"), (None, "x://h"), (5, "http://" + "a" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "tokens", "doc_id", "_row")})
    out = urls.judge(pages, labels, [("block", "com/en/")]).collect()
    assert len(out) == 7
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out} >= {(1, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.com", "/en/1", "com/en/", "block"), (None, "h", "", None, "allow")}
    assert urls.judge(pages.filter("false"), labels.filter("false"), []).count() == 0


def test_html(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<article><p>Text &amp; more.</p></article>"), (3, "u", "<div class='"), (4, "u", "<article>" + "<p>Some words here.</p>" * 5_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r for r in html.extract(pages).collect()}
    assert out[1].text == "" and out[2].n_chars == 0 and out[None].text == "Text & more." and out[4].text.count("\n") == 4_999
    assert html.extract(pages).count() == 6 and html.extract(pages.filter("false")).count() == 0


def test_html_after_letters_that_grow_in_lower_case(spark):
    body = "İ" * 12 + "</p><SCRIPT>var a = '<p>no</p>';</ſcript></Script><p>The second paragraph stays whole.</p>"
    pages = spark.createDataFrame([(1, "u", f"<article><p>The first paragraph. {body}</article>")], "page_id long, url string, html string")
    assert html.extract(pages).first().text == "The first paragraph. " + "İ" * 12 + "\nThe second paragraph stays whole."


def test_toxicity(messy, none, labels):
    out = toxicity.scores(messy, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert toxicity.scores(none, labels).count() == 0 and toxicity.scores(messy, labels.filter("false")).count() == len(ROWS)
    named = [df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))) for df in (messy, labels)]
    assert {type(e.doc_id) for r in toxicity.scores(*named).collect() for e in r.evidence} <= {str}
    assert toxicity.accepted(messy, labels).columns == messy.columns and toxicity.accepted(none, labels).count() == 0


def test_simhash(messy, none):
    out = simhash.near_duplicates(messy, words=4).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ROWS) and by[2].fp == by[3].fp == by[4].fp == 0 and by[4].component_id == 2
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicated(messy)
    assert kept.columns == messy.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 5, 6]
    assert simhash.deduplicated(none).count() == 0


def test_sharding(messy, none):
    out = sharding.extendible_shards(messy, 40).collect()
    assert len(out) == len(ROWS)
    assert all(r.shard_bytes <= 40 or sum(x.shard == r.shard for x in out) == 1 for r in out)
    assert sharding.extendible_shards(none, 40).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("v", "cid", "label", "size")})
    out = embeddings.near_duplicates(df).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: r for r in out}
    assert all((by[k].n_links, by[k].component_id, by[k].kept) == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9))
    assert by[1].n_links == 4 and by[2].component_id == 1 and not by[2].kept and by[10].component_id == 1
    assert embeddings.near_duplicates(df.filter("false")).count() == 0


def test_licences(spark, messy, none):
    s = licences.Scanner(spark)
    found = licences.scan(messy, scanner=s).collect()
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in found] == [(6, 0, "mit", True)]
    assert licences.scan(none, scanner=s).count() == 0 and licences.by_document(messy).count() == len(ROWS)


def test_decontamination(messy, none, bench):
    out = decontaminate.flagged(messy, bench).collect()
    assert len(out) == len(ROWS) and {r.doc_id for r in out if r.contaminated} == {1}
    assert decontaminate.flagged(none, bench).count() == 0 and not decontaminate.flagged(messy, bench.filter("false")).filter("contaminated").count()
    kept = decontaminate.cleaned(messy, bench)
    assert kept.columns == messy.columns and 1 not in [r.doc_id for r in kept.collect()] and kept.count() == len(ROWS) - 2


def test_pipeline_stages(spark, messy, none, sf):
    import corpus_pipeline

    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, messy, sf)
        assert out.columns == messy.columns and stage(spark, none, sf).count() == 0
        left[name] = [r.doc_id for r in out.collect()]
        assert len(left[name]) <= len(ROWS)
    assert sorted(i or 0 for i in left["simhash_near_dedup"]) == [0, 1, 1, 2, 5, 6]
    assert len(left["benchmark_decontamination"]) == len(ROWS)  # no item of the benchmark is in them
    assert corpus_pipeline.STAGES[-1][1](spark, messy, sf).count() == len(ROWS)
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf).count() == 0
