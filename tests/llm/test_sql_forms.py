"""The DuckDB forms against the operators on planted tables."""

import random

import duckdb
import pyarrow as pa

from quaesitor.llm import decontaminate, queries, urls


def rows_of(x):
    return sorted(str([round(v, 9) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v for v in r]) for r in x)


def test_mined_rules(spark):
    rng = random.Random(4)
    pages, labels = [], []
    for k in range(600):
        host = rng.choice(["bad-site.example.net", "www.fine.example.com", "m.other.example.org"])
        part = rng.choice(["en", "de", "shop"])
        pages.append((k, f"https://{host}/{part}/{k}{rng.choice(['', '.html', '/', '?utm=a&q=1', '#top'])}"))
        bad = host.startswith("bad") and part == "shop" and rng.random() < 0.9 or rng.random() < 0.1
        labels.append((k, int(not bad), 0))
    p, q = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge(p, q, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in pages], "url": [r[1] for r in pages]}))
    con.register("labels", pa.table({"doc_id": [r[0] for r in labels], "quality": [r[1] for r in labels], "toxic": [r[2] for r in labels]}))
    want = con.sql("SELECT page_id, host, path, rule, verdict, mined, confidence FROM (" + urls.oracle(queries.URL_RULES) + ")").fetchall()
    found = [tuple(r) for r in got.collect()]
    assert rows_of(found) == rows_of(want)
    assert any(r[5] for r in found) and not all(r[5] for r in found)


def test_leaks(spark):
    rng = random.Random(10)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "Epsilon", "zeta", "12", "7", "km", "3.5", "kg", "über", "New", "theta"]
    item = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14))) + rng.choice([".", "?", ""])
    bench = [(k, item()) for k in range(40)] + [(40, None)]
    docs = []
    for k in range(200):
        text = " ".join(item() for _ in range(4))
        if k % 3 == 0:
            leak = rng.choice(bench)[1] or ""
            text += " " + (leak.replace("12", "15").replace("Gamma", "Kappa") if k % 2 else leak.lower()) + " " + item()
        docs.append((k, text if k % 50 else None))
    got = decontaminate.flagged(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in docs], "text": [r[1] for r in docs]}))
    con.register("benchmark", pa.table({"item_id": [r[0] for r in bench], "text": [r[1] for r in bench]}))
    want = con.sql("SELECT doc_id, contaminated, items, coverage, changed FROM (" + decontaminate.oracle() + ")").fetchall()
    found = [tuple(r) for r in got.select("doc_id", "contaminated", "items", "coverage", "changed").collect()]
    assert rows_of(found) == rows_of(want)
    assert any(r[1] and r[4] for r in found) and any(not r[1] for r in found)
