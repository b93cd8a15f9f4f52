"""Each operator against brute force, an exact round trip or held-out accuracy."""

import itertools
import random
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quaesitor.llm import decontaminate, embeddings, html, licences, mixing, queries, sharding, simhash, tokens, toxicity, urls


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 1 mixing


def test_raked_shares_meet_the_targets():
    rng = np.random.default_rng(1)
    cells = [(f"s{i}", f"l{j}") for i in range(5) for j in range(3)]
    have = rng.integers(10, 1000, len(cells)).astype(float)
    want = {"s0": 0.4, "s1": 0.3, "s2": 0.1, "s3": 0.1, "s4": 0.1}
    w = mixing.rake(cells, have, [want, 0.5])
    total = (w * have).sum()
    for s, share in want.items():
        assert sum(w[k] * have[k] for k, c in enumerate(cells) if c[0] == s) / total == pytest.approx(share, abs=1e-8)
    m = mixing.calibrate(w, have, 0.5)
    assert (have * np.minimum(1, m * w)).sum() == pytest.approx(0.5 * have.sum(), rel=1e-6)


def test_many_cells_take_the_table_and_agree(spark, sf):
    docs = table(spark, sf, "documents")
    near = mixing.mix(docs, {"source": 0.7, "lang": 0.8}, 0.8).toPandas().sort_values("doc_id")
    far = mixing.mix(docs, {"source": 0.7, "lang": 0.8}, 0.8, driver_cells=0).toPandas().sort_values("doc_id")
    assert np.allclose(near.weight, far.weight, rtol=1e-6) and np.allclose(near.probability, far.probability, rtol=1e-4)
    expected = (near.probability * near.n_tokens).sum() / near.n_tokens.sum()
    assert expected == pytest.approx(0.8, abs=1e-6)


# 2 token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    return tokens.counter(path), lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(library, spark, sf):
    ours, theirs = library
    rng = random.Random(2)
    alphabet = "aabceehilnorstuvwxyz'''  !?.,-0189\n\tàéßΣςİǅ中文日本🙂👍́̀‍<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(3000)]
    texts += ["<|startoftext|>a<|endoftext|>", "a<|endoftext|><|endoftext|>b'sx", "x" * 3000, "'re're's'", "the" * 2000, "ΑΣ ΣΑΣ", "don't I'LL he'd''s"]
    texts += [r.text or "" for r in table(spark, sf, "documents").collect()]
    assert ours.count(texts) == theirs(texts)


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_chunk_maps_compose_to_the_same_counts(library, chunk):
    ours, _ = library
    symbols, _ = tokens.stream(["some words that run on andonandonandonandon 12 !!! it's", "", "zz'll"])
    assert (ours.machine.counts(symbols, chunk) == ours.machine.counts(symbols, 1 << 20)).all()


# 3 urls


def plain_host_path(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = next((rest[:k] for k, c in enumerate(rest) if c in "/?#"), rest)
    tail = rest[len(host) :]
    path = next((tail[:k] for k, c in enumerate(tail) if c in "?#"), tail)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fit = [(len(r), a, r) for a, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


def test_urls_equal_plain_rules(spark, sf):
    pages, labels = table(spark, sf, "pages"), table(spark, sf, "labels")
    given = {r.page_id: r.url for r in pages.collect()}
    for r in urls.judge(pages, labels, queries.URL_RULES).collect():
        host, path = plain_host_path(given[r.page_id])
        action, rule = plain_rule(host, path, queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or ("block" if r.mined else "allow"))


def test_deep_urls_are_mined_in_little_time(spark):
    """Twenty segments that bad urls share in part: the rules are those single tokens, not their combinations."""
    rows = [([f"dir:{j}" for j in range(20)] + [f"dir:x{k}"], True) for k in range(60)] + [([f"dir:{j}" for j in range(k % 5)], False) for k in range(40)]
    got = {r.rule_id: r.confidence for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.01, 0.5).collect()}
    held = {j: 60 / (60 + sum(k % 5 > j for k in range(40))) for j in range(4)}
    assert got == pytest.approx({"dir:10": 1.0} | {f"dir:{j}": c for j, c in held.items()})


def test_mined_rules_equal_counting(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        t = sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randint(1, 4)))
        rows.append((t, {"a", "b"} <= set(t) and rng.random() < 0.9 or rng.random() < 0.05))
    got = {r.rule_id: (r.support, r.confidence) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6, least_rows=2).collect()}
    want = {}
    for n in range(1, 5):
        for c in itertools.combinations("abcde", n):
            held = [y for t, y in rows if set(c) <= set(t)]
            if held and sum(held) / len(rows) >= 0.02 and sum(held) / len(held) >= 0.6:
                want[" ".join(c)] = (sum(held) / len(rows), sum(held) / len(held))
    pruned = {k: v for k, v in want.items() if not any(set(p.split()) < set(k.split()) and want[p][1] >= v[1] for p in want)}
    assert got.keys() == pruned.keys() and all(got[k] == pytest.approx(pruned[k]) for k in got)
    pages = spark.createDataFrame([(1, ["a", "b", "z"]), (2, ["a"]), (3, [])], "page_id long, tokens array<string>")
    rules = spark.createDataFrame([("a b", ["a", "b"]), ("a", ["a"])], "rule_id string, antecedent array<string>")
    assert {tuple(r) for r in urls.matches(pages, rules, "page_id").collect()} == {(1, "a b"), (1, "a"), (2, "a")}


# 4 html


class Article(HTMLParser):
    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.now = 0, [], ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.now += data if self.inside else ""

    def flush(self):
        if text := " ".join(self.now.split()):
            self.blocks.append(text)
        self.now = ""


def test_pages_give_their_articles(spark, sf):
    pages = table(spark, sf, "pages")
    want = {}
    for r in pages.collect():
        a = Article()
        a.feed(r.html)
        want[r.page_id] = "\n".join(a.blocks)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_unseen_layouts():
    chain, rng = html.trained(), random.Random(77)
    right = n = 0
    for _ in range(200):
        page, labels = html.labelled_page(rng)
        got = chain.decode(html.leaves(page))
        assert len(got) == len(labels)
        right += sum(a == bool(b) for a, b in zip(got, labels))
        n += len(labels)
    assert right / n > 0.985


# 5 toxicity


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    idf = rng.uniform(1, 5, 80)
    rows = [(k, int(rng.integers(2)), sorted(rng.choice(80, rng.integers(0, 9), replace=False).tolist()), None) for k in range(700)]
    rows = [(k, y, ids, rng.integers(1, 5, len(ids)).tolist()) for k, y, ids, _ in rows]
    index = toxicity.Index.build(rows, idf)
    dense = {k: np.zeros(80) for k, *_ in rows}
    for k, _, ids, n in rows:
        if ids:
            dense[k][ids] = toxicity.weigh(np.array(ids), np.array(n, float), idf)
    for _ in range(60):
        ids = np.sort(rng.choice(80, rng.integers(1, 8), replace=False))
        n = rng.integers(1, 4, len(ids)).astype(float)
        q = np.zeros(80)
        q[ids] = toxicity.weigh(ids, n, idf)
        _, got = index.nearest(ids, n, 15)
        want = np.sort([s for s in (q @ v for v in dense.values()) if s > 0])[::-1][:15]
        assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit / (out.predicted == 1).sum() > 0.85 and hit / (out.toxic == 1).sum() > 0.8


# 6 simhash


def plain_fingerprint(text, words):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + words]).encode(), 42) for k in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    from quaesitor.llm.common import components

    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(7, 7)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(100, 101)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = groups(500, edges)
    assert out == {x: root[x] for e in edges for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_equals_all_pairs(spark, sf):
    docs = sorted(table(spark, sf, "documents").collect(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(r.text, 4) for r in docs]
    root = groups(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    out = {r.doc_id: r for r in queries.op6_simhash(spark, sf).collect()}
    for k, r in enumerate(docs):
        assert out[r.doc_id].fingerprint == f"{fps[k]:016x}" and out[r.doc_id].component_id == docs[root[k]].doc_id


def test_links_of_dense_and_sparse_cells():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [base[:3] ^ (np.uint64(1) << np.uint64(b)) for b in rng.integers(0, 64, 90)]))
    a, b = simhash.cell_links(np.zeros(len(x), np.int64), x, 4)
    at = {int(v): k for k, v in enumerate(x)}
    got = groups(len(x), [(at[int(p)], at[int(q)]) for p, q in zip(a, b)])
    want = groups(len(x), [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 4])
    assert got == want


def near_pair(rng, n, changed, block):
    """Two texts of Zipf-like words: the second has other words, in one block at its end or scattered."""
    vocabulary = [f"w{k}" for k in range(4000)]
    draw = lambda m: [vocabulary[min(3999, int(rng.paretovariate(0.6)))] for _ in range(m)]
    a = draw(n)
    if block:
        return " ".join(a), " ".join(a + draw(changed))
    b = list(a)
    for k in rng.sample(range(n), changed):
        b[k] = f"x{rng.randrange(4000)}"
    return " ".join(a), " ".join(b)


def shingle_set(text):
    w = simhash._words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("block", [True, False])
def test_every_near_pair_is_linked(spark, block):
    """Pairs just over the similarity, by a block of new words and by scattered ones: none is missed."""
    rng = random.Random(60 + block)
    pairs = [near_pair(rng, n := rng.randint(120, 250), round(n * rng.uniform(0.05, 0.22)) if block else max(1, round(n * 0.012)), block) for _ in range(60)]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    near = {2 * k for k, (a, b) in enumerate(pairs) if alike(shingle_set(a), shingle_set(b))}
    rows = [(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)]
    got = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 20 and got == {i for i, _ in rows} - {k + 1 for k in near}


def test_near_copies_leave_one(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    shingles = []
    for _, t in rows:
        w = simhash._words(t)
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    root = groups(len(rows), near)
    want = {rows[k][0] for k in range(len(rows)) if root[k] == k}
    got = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert len(got ^ want) <= 0.02 * len(rows)


def test_partners_among_many_alike_in_words(spark):
    """120 texts of the same distinct words: each is linked to its near copy and to no other."""
    rng = random.Random(63)
    rows = []
    for k in range(60):
        w = [f"w{i}" for i in range(200)]
        rng.shuffle(w)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([w[1], w[0], *w[2:]]))]
    got = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(0, 120, 2))


@pytest.mark.parametrize("block", [True, False])
def test_long_pairs_are_decided_exactly(spark, block):
    """Texts of many shingles with similarities on both sides of the threshold."""
    rng = random.Random(64)
    pairs = [near_pair(rng, 900, rng.randint(190, 250) if block else rng.randint(17, 27), block) for _ in range(60)]
    near = {2 * k for k, (a, b) in enumerate(pairs) if len(shingle_set(a) & shingle_set(b)) >= 0.8 * len(shingle_set(a) | shingle_set(b))}
    rows = [(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)]
    got = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 10 < len(near) < 50 and got == {i for i, _ in rows} - {k + 1 for k in near}


def test_pipeline_near_copies_are_those_of_the_fingerprints(spark, sf):
    """The stage keeps the smallest id of each component of fingerprints within 4 bits, by all pairs; a Jaccard similarity decides nothing."""
    import corpus_pipeline

    rng = random.Random(65)
    pairs = [near_pair(rng, 250, rng.randint(20, 70), True) for _ in range(60)]
    rows = [(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)]
    rows += [(1000 + r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    rows.sort(key=lambda r: r[0])
    fps = [plain_fingerprint(t, 5) for _, t in rows]
    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    want = {i for k, (i, _) in enumerate(rows) if root[k] == k}
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert sorted(got) == sorted(want)
    assert any((2 * k + 1 in want) == alike(shingle_set(a), shingle_set(b)) for k, (a, b) in enumerate(pairs))  # the two measures differ here


def test_each_component_keeps_a_document_when_ids_repeat(spark, sf):
    import corpus_pipeline

    a, b = "one two three four five six seven", "red green blue white black grey brown"
    rows = [(3, a), (5, a), (5, b), (7, b), (None, a)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, a), (3, a), (5, a), (5, b)]


@pytest.fixture()
def steps(tmp_path, monkeypatch):
    """The folder of the intermediate tables of one test."""
    from quaesitor.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path


def test_pipeline_near_dedup_writes_no_shingles(spark, sf, steps):
    """What the stage writes beside its result is a small part of the texts."""
    import corpus_pipeline

    rng = random.Random(66)
    rows = [(2 * k + i, t) for k in range(150) for i, t in enumerate(near_pair(rng, 1500, 8, False))]
    corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).count()
    assert sum(f.stat().st_size for f in steps.rglob("*.parquet")) < 0.2 * sum(len(t) for _, t in rows)


def test_pipeline_near_dedup_makes_no_pairs_of_a_large_group(spark, sf, steps):
    """400 texts of which each pair is just under a Jaccard similarity of 0.8: no table of the stage has more rows than a grid cell for each text and choice of blocks."""
    import corpus_pipeline

    rng = random.Random(67)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(400):
        w = list(base)
        w[rng.randrange(5, 95)] = f"x{k}"
        rows.append((k, " ".join([*w, f"y{k}"])))
    corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).count()
    made = [spark.read.parquet(str(d)).count() for d in steps.iterdir() if any(d.glob("*.parquet"))]
    assert max(made) <= 35 * len(rows)


@pytest.mark.parametrize("stage", ["drop_near_copies", "drop_benchmark_leaks"])
def test_pipeline_moves_no_texts_to_drop_rows(spark, sf, stage):
    """Where Spark itself broadcasts nothing, no exchange of the stage's result holds the texts."""
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = getattr(corpus_pipeline, stage)(spark, docs, sf)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert 0 < out.count() < docs.count() and out.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_are_dropped_alike_by_both_joins(spark, monkeypatch, kind):
    from quaesitor.llm import common

    rows = [(None if k % 50 == 0 else k // 2, f"text {k}") for k in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, g string").withColumn("doc_id", F.col("doc_id").cast(kind))
    for drop in (lambda i: False, lambda i: i % 3 == 0, lambda i: True):
        gone = spark.createDataFrame([(i,) for i in range(1_000) if drop(i)], "g long").select(F.col("g").cast(kind))
        want = sorted(t for i, t in rows if i is None or not drop(i))
        for most in (common.BROADCAST_BYTES, 0):
            with monkeypatch.context() as m:
                m.setattr(common, "BROADCAST_BYTES", most)
                out = common.without_ids(docs, "doc_id", gone)
            assert out.columns == docs.columns and sorted(r[1] for r in out.collect()) == want


# 7 sharding


def test_shards_equal_sql(spark, sf):
    limit = 20_000
    got = sorted(map(tuple, sharding.extendible_shards(table(spark, sf, "documents"), limit).select("doc_id", "n_bytes", "depth", "prefix", "shard", "shard_bytes").collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(sharding.oracle(limit)).fetchall())
    assert got == want and len({r[4] for r in got}) > 10


def test_rows_of_one_id_are_all_placed(spark):
    """More rows of one id than the row bits tell apart, each as large as the limit or a few bytes."""
    for size, limit in ((10, 10), (3, 5)):
        out = sharding.extendible_shards(spark.createDataFrame([(7, "x" * size)] * 5000, "doc_id long, text string"), limit).collect()
        held = {}
        for r in out:
            held.setdefault((r.shard, r.shard_bytes), []).append(r.n_bytes)
        assert len(out) == 5000 and all(sum(v) == b <= limit for (_, b), v in held.items()) and len(held) == len({s for s, _ in held})


# 8 embeddings


def test_pairs_found(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 32))
    x[:60] = x[60:120] + 0.28 * rng.standard_normal((60, 32)) * np.linalg.norm(x[60:120], axis=1, keepdims=True) / np.sqrt(32)
    x[120:124] = x[124] * np.array([[1], [2], [0.5], [1]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    out = embeddings.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    assert (out.n_links.values <= near.sum(axis=1)).all() and out.n_links.sum() >= 0.9 * near.sum()
    assert near.sum() > 40


def test_calibrated_recall():
    rotations, window, count = embeddings.calibrate(24, 2, 0.95)
    rng = np.random.default_rng(80)
    a = rng.standard_normal((2000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 24))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(2000)
    for k in range(1, rotations + 1):
        (ka, pa), (kb, pb) = embeddings.lines(a, k, 2), embeddings.lines(b, k, 2)
        met += (ka == kb) & (np.abs(pa - pb) <= window)
    assert (met >= count).mean() > 0.97


# 9 licences


def test_licences(spark):
    s = licences.Scanner(spark)
    assert s.held_accuracy > 0.85, s.held_accuracy  # wordings not seen in training
    lines = {
        "Licensed under CC BY-NC 3.0.": "cc-by-nc", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 2.": "gpl",
        "Licensed under the Apache License, Version 1.0.": "apache", "My driving license was lost near the apache village.": None, "Ordinary words only.": None,
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r.doc_id: r.family for r in licences.scan(df, scanner=s).filter("confirmed").collect()}
    assert found == {k: f for k, f in enumerate(lines.values()) if f}


def test_licences_wrapped_over_lines_and_in_long_texts(spark):
    s = licences.Scanner(spark)
    wrapped = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\n  documentation files (the \"Software\"), to deal in the Software without\nrestriction"
    texts = {1: f"A title.\n\n{wrapped}\n\nThe end.", 2: "words of no account. " * 40_000 + "\nReleased under the ISC License.\n" + "more words\n" * 10_000, 3: "A line without an end\nLicensed under CC BY 4.0.\nand more of it", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.family, r.line) for r in licences.scan(df, scanner=s).filter("confirmed").collect()}
    assert {(d, f) for d, f, _ in got} == {(1, "mit"), (2, "isc"), (3, "cc-by")} and (3, "cc-by", 1) in got
    assert {r.doc_id: r.families for r in licences.by_document(df).collect()} == {1: ["mit"], 2: ["isc"], 3: ["cc-by"], 4: []}


def test_licence_scores_equal_dense_brute_force(spark):
    s = licences.Scanner(spark)
    texts = [t for t, _, _ in licences.training_paragraphs(seed=33)][::7]
    got = {r.doc_id: (r.family, r.probability) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scanner=s, least=0.0).filter("line = 0").collect()}
    import regex

    number = {g: k for k, g in enumerate(s.features)}
    for k, text in enumerate(texts):
        words = ["#" if regex.fullmatch(r"v?[0-9][0-9.]*", w) else w for w in regex.findall(r"[\p{L}\p{N}]+(?:[.'’+-][\p{L}\p{N}]+)*", text.lower())]
        x = np.zeros(len(number))
        x[[number[g] for n in (1, 2, 3) for i in range(len(words) - n + 1) if (g := " ".join(words[i : i + n])) in number]] = 1.0
        z = (s.weight @ x + s.bias) / s.temperature
        family = s.families[int(z.argmax())]
        assert (k in got) == (family != licences.UNKNOWN)
        if k in got:
            assert got[k] == (family, pytest.approx(float(np.exp(z - z.max()).max() / np.exp(z - z.max()).sum())))


def test_paragraphs_without_trigger_words_are_unknown(spark):
    s = licences.Scanner(spark)
    import re

    pattern = re.compile(s.trigger_pattern().replace(r"\p{L}\p{N}", r"\w"))
    for text, family, _ in licences.training_paragraphs():
        if not pattern.search(text):
            assert family == licences.UNKNOWN


# 10 decontamination


def test_templates(spark):
    item = "Tom buys 12 apples and 7 pears for 3 dollars each while Ann sells 12 plums to Tom before the market closes today"
    texts = {
        1: f"Some words come first. {item} And then more words follow.",
        2: item.replace("Tom", "Bob").replace("12", "15").replace("Ann", "Eve").replace("3 dollars", "9 euros"),
        3: item.replace("Tom", "Bob", 1).replace("12", "15", 1).replace("7", "15").replace("Tom", "Zed", 1),
        4: "Nothing of this kind is said here at all, only words.",
        5: item.replace("market", "shop"),
        6: item.lower(),
    }
    bench = spark.createDataFrame([(100, item)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.flagged(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()}
    assert [out[k].contaminated for k in (1, 2, 4, 5)] == [True, True, False, True]
    assert out[1].changed == 0 and out[2].changed > 0 and not out[3].contaminated


def test_leaks_equal_plain_windows(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    import re

    words = lambda t: re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d]+", (t or "").lower())
    want = set()
    for d in docs.collect():
        w = words(d.text)
        seen = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for b in bench.collect():
            v = words(b.text)
            covered = {k + i for k in range(len(v) - 4) if tuple(v[k : k + 5]) in seen for i in range(5)}
            if len(covered) >= 0.8 * len(v):
                want.add(d.doc_id)
    got = {r.doc_id for r in decontaminate.flagged(docs, bench).filter(F.col("contaminated")).collect()}
    assert got == want and want


def test_parity_maps_never_part_near_sets():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 500, 6000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.02, 0.1, 0.3, 1.0):
            new = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            a, b = np.unique(base), np.unique(np.concatenate((base[len(new) :], new)))
            apart = int(np.bitwise_count((simhash.parity(a) ^ simhash.parity(b)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b))
    assert not simhash.parity(np.empty(0, np.uint64)).any()
