"""Toxicity (5): votes of the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches, uniform, written

#: Labelled rows that the examples are drawn from: about so many, by a hash of the id, or all if there are fewer.
EXAMPLES = 8192
#: Terms kept: all with this chi-square against the label and in so many examples at least. Over the whole
#: vocabulary the nearest examples are those of the same subject, not of the same tone (figures in the README).
CHI_SQUARE, LEAST_ROWS = 25.0, 4
NEIGHBOURS, BLOCK, NEAR = 15, 64, 0.05
#: Weight against in each vote: far neighbours alone decide nothing.
REST = 5.0
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are terms beside the words.
STEMS = (4, 5)


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


def counts_of(text: str | None, known: dict[str, int], cache: dict[str, tuple[int, ...]]) -> Counter:
    """How often each known term occurs in the whole text."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        ids = cache.get(word)
        if ids is None:
            if len(cache) > 200_000:
                cache.clear()
            ids = cache[word] = tuple(known[t] for t in terms_of(word) if t in known)
        for i in ids:
            found[i] += n
    return found


def choose_terms(examples: DataFrame) -> list[str]:
    """Terms whose presence goes with the label, from (text, toxic): ranked by chi-square, then by the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bad = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = {t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)}
                rows.update(seen)
                if y:
                    bad.update(seen)
            keys = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([rows[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], names=["term", "n", "b"])

    total, bad = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == total:
        return []
    by = examples.select("text", "toxic").mapInArrow(run, "term string, n long, b long").groupBy("term").agg(F.sum("n").cast("double").alias("n"), F.sum("b").cast("double").alias("b"))
    n, b, all_n, all_b = F.col("n"), F.col("b"), F.lit(float(total)), F.lit(float(bad))
    gap = b * (all_n - all_b - (n - b)) - (n - b) * (all_b - b)
    by = by.filter((n >= LEAST_ROWS) & (n < all_n)).withColumn("x", all_n * gap * gap / (n * (all_n - n) * all_b * (all_n - all_b)))
    return [r.term for r in by.filter(F.col("x") >= CHI_SQUARE).orderBy(F.desc("x"), "term").collect()]  # at most the vocabulary of the examples


def term_counts(docs: DataFrame, terms: list[str], keep: list[str]) -> DataFrame:
    """`docs` (columns `keep` and text) with the sparse term counts of the text: ids and n, by rising id."""
    small_batches(docs.sparkSession)
    known = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [sorted(counts_of(t, known, cache).items()) for t in batch.column(len(keep)).to_pylist()]
            ids = pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int32()))
            n = pa.array([[c for _, c in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids, n], names=[*keep, "ids", "n"])

    types = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, "text").mapInArrow(run, f"{types}, ids array<int>, n array<int>")


def frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many rows each of `size` terms occurs: counted in each task, summed over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64())], names=["t", "n"])

    out = np.zeros(size)
    for r in counted.select("ids").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r.t] = r.n
    return out


def weigh(ids: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf[ids]
    return w / np.linalg.norm(w) if len(w) else w


@dataclass
class Index:
    """Labelled examples in blocks; for each term the blocks that hold it, with its greatest weight in each."""

    idf: np.ndarray
    toxic: np.ndarray
    names: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # term, row in the block, weight
    of_term: dict[int, tuple[np.ndarray, np.ndarray]]  # blocks, greatest weights

    @staticmethod
    def build(rows: list[tuple], idf: np.ndarray) -> Index:
        """rows: (name, toxic, ids, n); those without a known term are left out. Rows with the same strongest terms share blocks."""
        kept = []
        for name, y, ids, n in rows:
            if len(ids):
                ids = np.asarray(ids, np.int64)
                kept.append((name, int(y), ids, weigh(ids, np.asarray(n, float), idf)))
        kept.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), r[1], (r[0] is None, r[0] or 0)))
        blocks, peaks = [], {}
        for k in range(0, len(kept), BLOCK):
            part = kept[k : k + BLOCK]
            term = np.concatenate([r[2] for r in part])
            row = np.concatenate([np.full(len(r[2]), i) for i, r in enumerate(part)])
            weight = np.concatenate([r[3] for r in part])
            blocks.append((term, row, weight))
            order = np.lexsort((weight, term))
            last = np.append(np.flatnonzero(np.diff(term[order])), len(order) - 1)
            for t, w in zip(term[order][last].tolist(), weight[order][last].tolist()):
                peaks.setdefault(t, ([], []))
                peaks[t][0].append(k // BLOCK)
                peaks[t][1].append(w)
        return Index(idf, np.array([r[1] for r in kept], int), np.array([r[0] for r in kept], object), blocks, {t: (np.array(b), np.array(w)) for t, (b, w) in peaks.items()})

    def nearest(self, ids: np.ndarray, n: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0 (ties: lesser place), exactly: blocks by falling bound until none can enter."""
        q = weigh(ids, n, self.idf)
        bound = np.zeros(len(self.blocks))
        for t, w in zip(ids.tolist(), q.tolist()):
            if t in self.of_term:
                at, peak = self.of_term[t]
                bound[at] += w * peak
        dense = np.zeros(len(self.idf))
        dense[ids] = q
        place, score = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(score) == k and bound[b] < score[-1] - 1e-9):
                break
            term, row, weight = self.blocks[b]
            s = np.bincount(row, dense[term] * weight)
            hit = np.flatnonzero(s > 0)
            at = hit + b * BLOCK
            hit, at = hit[at != without], at[at != without]
            place, score = np.concatenate((place, at)), np.concatenate((score, s[hit]))
            best = np.lexsort((place, -np.round(score, 12)))[:k]
            place, score = place[best], score[best]
        return place, score

    def vote(self, place: np.ndarray, score: np.ndarray) -> float:
        """The toxic share of the neighbours, each weighted by cosine over distance, beside a fixed weight against; -1 without neighbours."""
        if not len(place):
            return -1.0
        w = score / (NEAR + 1 - np.minimum(score, 1))
        return float((w * self.toxic[place]).sum() / (w.sum() + REST))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing steps through (x, y): places and values to interpolate between."""
    at, inverse = np.unique(x, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / n
    runs: list[list[float]] = []
    for k in range(len(at)):
        runs.append([mean[k], n[k], k, k])
        while len(runs) > 1 and runs[-2][0] >= runs[-1][0]:
            m, c, _, e = runs.pop()
            runs[-1] = [(runs[-1][0] * runs[-1][1] + m * c) / (runs[-1][1] + c), runs[-1][1] + c, runs[-1][2], e]
    out = np.empty(len(at))
    for m, c, s, e in runs:
        out[int(s) : int(e) + 1] = (m * c + 0.5) / (c + 1)  # a half row each way: never quite 0 or 1
    return at, np.maximum.accumulate(out)


@dataclass
class Model:
    terms: list[str]
    index: Index
    steps: tuple[np.ndarray, np.ndarray]
    unseen: float

    def score(self, ids: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        place, cosine = self.index.nearest(ids, n, NEIGHBOURS) if len(ids) else (np.empty(0, np.int64), np.empty(0))
        vote = self.index.vote(place, cosine)
        return (self.unseen if vote < 0 else float(np.interp(vote, *self.steps))), place, cosine


def fit_and_count(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[Model, DataFrame]:
    """The model, and the term counts of every document: (doc_id, held_out, ids, n).

    Labels are read only for ids whose crc32 is not 2 modulo 4. The examples are
    about `examples` of those rows. Document frequencies come from all documents.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    given = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = given.count()
    drawn = written(given.filter(uniform(F.col("doc_id"), 5) < examples / max(n, 1)))
    base = docs.select("doc_id", "text", held.alias("held_out"))
    rows = written(base.join(drawn, "doc_id").select("doc_id", "text", "toxic"))
    terms = choose_terms(rows)
    counted = written(term_counts(base, terms, ["doc_id", "held_out"]))
    total = counted.count()
    df = frequencies(counted, len(terms))
    idf = np.log((1 + total) / (1 + df)) + 1
    known = [(r.doc_id, r.toxic, r.ids, r.n) for r in term_counts(rows, terms, ["doc_id", "toxic"]).collect()]
    index = Index.build(known, idf)
    # the index keeps no counts: each example is asked for again by its own, itself left out
    own = {}
    for name, _, ids, c in known:
        if ids:
            own.setdefault(name, []).append((np.asarray(ids, np.int64), np.asarray(c, float)))
    votes, ys = [], index.toxic.astype(float)
    for k, name in enumerate(index.names):
        votes.append(index.vote(*index.nearest(*own[name].pop(), NEIGHBOURS, without=k)))
    votes = np.array(votes, float)
    seen = votes >= 0
    empty = [y for _, y, ids, _ in known if not len(ids)] + ys[~seen].astype(int).tolist()
    unseen = (sum(empty) + 0.05) / (len(empty) + 1)
    steps = isotonic(votes[seen], ys[seen]) if seen.any() else (np.array([0.0, 1.0]), np.array([unseen, unseen]))
    return Model(terms, index, steps, float(unseen)), counted


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, examples: int = EXAMPLES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted, evidence.

    score estimates the probability of label 1 from the votes of the nearest
    examples, calibrated on the examples each left out in turn; evidence lists
    the three nearest: (doc_id, cosine, toxic). Texts without a term that goes
    with the label, empty and null ones too, get the rate of such examples.
    Repeated rows stay repeated; a null id is not held out; of several labels of
    an id the greatest counts; a null label is no label. Without labels of both kinds all scores are the
    base rate. Other columns, whatever their names, are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    model, counted = fit_and_count(docs.select("doc_id", "text"), labels, examples)
    shared = spark.sparkContext.broadcast(model)  # at most EXAMPLES sparse rows over the terms of those rows
    name_type = to_arrow_schema(labels.select("doc_id").schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache: dict[tuple, tuple] = {}
        for batch in batches:
            ids, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            score, evidence = [], []
            for i, c in zip(ids, n):
                key = (tuple(i), tuple(c))
                if key not in cache:
                    if len(cache) > 50_000:
                        cache.clear()
                    s, place, cosine = m.score(np.asarray(i, np.int64), np.asarray(c, float))
                    cache[key] = s, [{"doc_id": m.index.names[p], "cosine": float(x), "toxic": int(m.index.toxic[p])} for p, x in zip(place[:3], cosine[:3])]
                s, e = cache[key]
                score.append(s)
                evidence.append(e)
            kind = pa.list_(pa.struct([("doc_id", name_type), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "held_out", "score", "evidence"])

    kind, name = dict(counted.dtypes)["doc_id"], dict(labels.dtypes)["doc_id"]
    out = counted.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, evidence array<struct<doc_id:{name},cosine:double,toxic:int>>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose score is under `threshold`, with their columns; texts are read again and never shuffled.

    Null and empty texts, ties, repeated rows and labels are treated as by
    `scores`; rows with a null id are judged like others. Columns of any name
    pass through; an empty table gives an empty table.
    """
    model, _ = fit_and_count(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, examples)
    shared = docs.sparkSession.sparkContext.broadcast((model, {t: k for k, t in enumerate(model.terms)}))  # bounded like the examples

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        m, known = shared.value
        cache: dict[str, tuple[int, ...]] = {}
        out = []
        for t in texts:
            found = sorted(counts_of(t, known, cache).items())
            out.append(m.score(np.array([k for k, _ in found], np.int64), np.array([c for _, c in found], float))[0])
        return pd.Series(out, dtype="float64")

    return docs.filter(score(F.col(text_col)) < threshold)
