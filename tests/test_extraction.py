"""Cleaning, references, offsets, bulk files: the golden cases."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quaesitor.functions import text as T
from quaesitor.operators import units
from quaesitor.sources import landing, rest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Before\n```\ncode\n```\nAfter", "Before\n\nAfter"),
        ("> quoted\nReply here", "Reply here"),
        ("Not sure what's going on here.\n@someone can you look?", "Not sure what's going on here.\n can you look?"),
        ("a `b` c <!-- d\ne --> f ![g](h)", "a  c  f"),
        ("x\n\n\n\n\ny", "x\n\ny"),
        ("@müller hi a@b.c", "hi a.c"),
        (None, ""),
        (" \t\n", ""),
        ("```open", "```open"),
    ],
)
def test_strip(spark, raw, want):
    assert one(spark, T.strip_text, raw) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("fixes #123", [(123, "fixes")]),
        ("closes #42 and refs #7", [(42, "closes"), (7, "refs")]),
        ("See #100 for details", [(100, "see")]),
        ("This addresses #999", [(999, "bare")]),
        ("nothing", []),
        ("resolves #1 and closes #2", [(1, "resolves"), (2, "closes")]),
    ],
)
def test_references(spark, text, want):
    assert [tuple(r) for r in one(spark, T.references, text)] == want


def test_tokens_round_trip(spark):
    for text in ["I don't know — cannot say, müller's 3.5?", "  leading", "", "a b", "can't won't I'm"]:
        r = spark.createDataFrame([(text,)], "x string").select(T.pieces(F.col("x")).alias("p")).first().p
        assert "".join(r) == text.rstrip() and (not r or all(p.strip(" \t\n") for p in r))
    assert one(spark, lambda c: T.bare(T.pieces(c)), "I don't; cannot") == ["I", "do", "n't", ";", "can", "not"]


def emails(spark, text, spans, urn="urn:1", subject="Subject"):
    row = {"urn": urn, "headers": {"subject": subject, "from": " a ", "date": "2024"}, "text_plain": text, "lang": "en", "group": "g", "segments": [{"begin": b, "end": e, "label": x} for b, e, x in spans]}
    return spark.createDataFrame([row], landing.EMAIL)


def texts(spark, text, spans, **k):
    out = units.from_emails(emails(spark, text, spans), **k).collect()
    return [(r.text_unit_id, r.text) for r in sorted(out, key=lambda r: r.position)]


def test_email_segments(spark):
    body = "Hi all,\n\nI am not sure this works as it is described here.\n\n> quoted text of someone else\n\nRegards, X"
    p, q, c = body.index("I am"), body.index(">"), body.index("Regards")
    spans = [(0, 7, "salutation"), (p, q - 2, "paragraph"), (q, c - 2, "quotation"), (c, len(body), "closing"), (9000, 9010, "paragraph")]
    assert texts(spark, body, spans) == [("email:urn:1:subject", "Subject"), ("email:urn:1:paragraph:1", body[p : q - 2])]
    assert len(texts(spark, body, spans, labels=("paragraph", "closing"))) == 3
    assert units.from_emails(emails(spark, body, spans, urn=None)).count() == 0


def test_offsets(spark):
    words = ["alpha", "bravo", "charlie", "delta"]
    text = " — ".join(words) + " end."
    at = [(len(text[: text.index(w)].encode()), len(text[: text.index(w)].encode()) + len(w), "paragraph") for w in words]
    assert [t for _, t in texts(spark, text, at)][1:] == words
    text = "alpha" + " — x" * 20 + " bravo charlie delta end."
    b = len(text[: text.index("delta")].encode())
    assert [t for _, t in texts(spark, text, [(0, 5, "paragraph"), (b, b + 5, "paragraph")])][1:] == ["alpha", "delta"]
    assert [t for _, t in texts(spark, "short", [(0, 3, "paragraph"), (9999, 10005, "paragraph")])][1:] == ["sho"]
    assert [t for _, t in texts(spark, "Whole text.", [(0, 12, "paragraph")])][1:] == ["Whole text."]
    assert [t for _, t in texts(spark, "Short paragraph.", [(0, 66, "paragraph")])][1:] == []
    assert [t for _, t in texts(spark, "Hello world, this is a test.", [(0, 5, "paragraph")])][1:] == ["Hello"]


def test_utf16_is_never_chosen(spark):
    df = emails(spark, "a🙂b é", [(0, 4, "paragraph"), (0, 6, "paragraph"), (0, 9, "paragraph")])
    assert units.with_segments(df).first().convention == "utf8_bytes"


def test_issue_units(spark):
    meta = {"repo_full_name": "o/r"}
    row = {"number": 42, "title": "Title", "body": "Body", "user": {"login": "u"}, "comments_data": [{"body": "one", "user": {"login": "v"}}, {"body": "```x```"}, {"body": "three"}], "_meta": meta}
    out = sorted(units.from_issues(spark.createDataFrame([row], landing.ISSUE)).collect(), key=lambda r: r.position)
    assert [(r.text_unit_id, r.role, r.position) for r in out] == [("issue:o/r:42:title", "title", 0), ("issue:o/r:42:body", "body", 1), ("issue:o/r:42:comment_body:2", "comment_body", 2), ("issue:o/r:42:comment_body:4", "comment_body", 4)]
    row = {"number": 7, "title": "Only", "body": " ", "_meta": meta}
    assert units.from_issues(spark.createDataFrame([row], landing.ISSUE)).count() == 1


def test_bulk_file(spark, tmp_path):
    act = lambda u: json.dumps({"index": {"_id": u}})
    doc = lambda g: json.dumps({"group": g, "lang": "en", "text_plain": "t"})
    lines = [act("<urn:a>"), doc("g1"), "", act("urn:b"), "oops{", act("urn:c"), doc("g2"), doc("orphan"), act("urn:d"), act("urn:e"), doc("g3")]
    path = tmp_path / "bulk.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines))
    pairs = landing.pair_bulk(landing.bulk_lines(spark, str(path)))
    assert [r.urn for r in pairs.orderBy("n").collect()] == ["urn:a", "urn:c", "urn:e"]
    parsed = landing.parse_bulk(pairs)
    assert {(r.urn, r.group) for r in parsed.collect()} == {("urn:a", "g1"), ("urn:c", "g2"), ("urn:e", "g3")}
    assert parsed.filter(landing.in_scope(F.col("group"), F.col("lang"), ["g1"], ["en"])).count() == 1
    assert parsed.filter(landing.in_scope(F.col("group"), F.col("lang"), None, ["de"])).count() == 0


def test_csv_with_newlines_comes_back(spark, tmp_path):
    rows = [("r1", 'a "quoted"\nline', "yes"), ("r2", "b", "maybe")]
    df = spark.createDataFrame(rows, "rule_id string, text string, mark string")
    df.write.csv(str(tmp_path / "out"), header=True, escape='"')
    back = spark.read.schema(df.schema).csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"')
    assert sorted(map(tuple, back.collect())) == rows and back.filter(F.col("mark").isin("yes", "no", "(ambiguous)")).count() == 1


class Answer:
    def __init__(self, body, link=None, status=200, left="99"):
        self.body, self.status = body, status
        self.headers = {"Link": link, "X-RateLimit-Remaining": left, "X-RateLimit-Reset": "0"} if link else {}

    def read(self):
        return json.dumps(self.body).encode()

    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def test_pages_follow_links():
    pages = {"u1": Answer([{"id": 1}], '<u2>; rel="next", <u9>; rel="last"'), "u2": Answer({"items": [{"id": 2}]}, '<u1>; rel="prev"')}
    waits = []
    got = list(rest.pages("u1", opener=pages.__getitem__, sleep=waits.append))
    assert got == [[{"id": 1}], [{"id": 2}]] and waits == [0.0, 0.0]
    assert rest.wait_for({"x-ratelimit-remaining": "3", "x-ratelimit-reset": "110"}, 100) == 11
    assert list(rest.pages("x", opener=lambda u: Answer([], status=204), sleep=waits.append)) == []


def test_rest_source_registers(spark):
    spark.dataSource.register(rest.Listing)
    assert spark.read.format("rest_listing").option("urls", "http://127.0.0.1:9/a").load().columns == ["url", "item"]
