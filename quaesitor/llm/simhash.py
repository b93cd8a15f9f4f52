"""SimHash near-duplicates (6): a Manhattan grid over segment bit counts, then an exact check.

A fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two
bits. Moving one bit changes one count by one, so the Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints. The grid
range-join uses that bound: with the segments dealt to B blocks, two vectors
within distance r agree on at least B - r whole blocks, so each vector is put
in one grid cell per choice of B - r blocks and meets there every vector that
can be in range. Pairs in a cell are then held against the Manhattan distance itself,
and those that it does not rule out are compared bit by bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, without_ids, written

SEED = 42
EVEN = 0x5555555555555555
SMALL_CELL = 48


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(parts: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of the whole sequence if it is shorter."""
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit SimHash over `words`-word shingles of the ASCII-lower-cased text; 0 without words."""
    parts = _words(text)
    return _majority(_shingles(parts, words)) if parts else 0


def with_fingerprint(docs: DataFrame, text: str, out: str, words: int) -> DataFrame:
    """`docs` with the fingerprint of column `text` as long `out`; the text itself is not carried past this step."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts):
        return texts.map(lambda t: fingerprint(t, words)).astype("int64")

    return docs.withColumn(out, fp(F.col(text)))


def block_masks(blocks: int, agree: int) -> list[int]:
    """For each choice of `agree` of `blocks` blocks of two-bit segments, the mask of their bits."""
    of = [sum(3 << (2 * s) for s in range(32) if s * blocks // 32 == b) for b in range(blocks)]
    return [sum(of[b] for b in chosen) for chosen in combinations(range(blocks), agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedded(fp: Column) -> Column:
    """The bit counts of all 32 segments in one long, each as two marks: one bit or more, two bits. The marks that two differ in are their Manhattan distance."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def marks(x: np.ndarray) -> np.ndarray:
    """embedded() of fingerprints given as unsigned numbers."""
    one, even = np.uint64(1), np.uint64(EVEN)
    low, high = x & even, (x >> one) & even
    return low | high | ((low & high) << one)


def within(x: np.ndarray, m: np.ndarray, at: np.ndarray, to: np.ndarray | int, reach: int) -> np.ndarray:
    """Which of the places `at` have fingerprints within `reach` bits of those at `to`: the Manhattan distance of the marks m first, a lower bound, then the bits."""
    to = np.broadcast_to(to, at.shape)
    ok = np.bitwise_count(m[at] ^ m[to]) <= reach
    left = np.flatnonzero(ok)
    ok[left] = np.bitwise_count(x[at[left]] ^ x[to[left]]) <= reach
    return ok


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) thinned to edges from each value to the least value of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _large_cell(x: np.ndarray, reach: int, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links inside a large cell as a search forest over `ids`: each value found leaves the set that is still compared."""
    a, b, left = [], [], np.ones(len(x), bool)
    rest, m = np.arange(len(x)), marks(x)
    stack: list[int] = []
    at = 0
    while len(rest):
        if not stack:
            while at < len(x) and not left[at]:
                at += 1
            if at == len(x):
                break
            left[at] = False
            stack.append(at)
            rest = rest[left[rest]]
        k = stack.pop()
        near = rest[within(x, m, rest, k, reach)]
        if len(near):
            left[near] = False
            rest = rest[left[rest]]
            a.append(np.full(len(near), ids[k]))
            b.append(ids[near])
            stack.extend(near.tolist())
    return a, b


def cell_links(cell: np.ndarray, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within `reach` bits inside equal runs of `cell` (sorted)."""
    first = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(axis=1) if cell.ndim > 1 else cell[1:] != cell[:-1])))
    end = np.append(first[1:], len(x))
    size = end - first
    a, b = [], []
    for s, e in zip(first[size > SMALL_CELL], end[size > SMALL_CELL]):
        p, q = _large_cell(x[s:e], reach, x[s:e])
        a += p
        b += q
    stop = np.repeat(np.where(size > SMALL_CELL, first, end), size)
    at, d, m = np.arange(len(x)), 1, marks(x)
    while len(at := at[at + d < stop[at]]):
        near = at[within(x, m, at, at + d, reach)]
        a.append(x[near])
        b.append(x[near + d])
        d += 1
    a, b = (np.concatenate(v) if v else np.empty(0, np.uint64) for v in (a, b))
    return _forest(a, b) if len(a) else (a, b)


def fingerprint_links(prints: DataFrame, reach: int = 4, blocks: int = 7) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` of `prints` linked at `reach` bits or fewer.

    Not all pairs: within a cell a spanning forest, so that a group of copies
    costs rows in proportion to its size and loses no connection.
    """
    masks = block_masks(blocks, blocks - reach)
    keyed = prints.select("fp", embedded(F.col("fp")).alias("c")).select("fp", F.posexplode(F.array(*[F.col("c").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("grid", "cell"))
    keyed = keyed.repartition("grid", "cell").sortWithinPartitions("grid", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts):
            x, g, c = (np.concatenate(v) for v in zip(*parts))
            a, b = cell_links(np.stack((g.astype(np.int64), c), axis=1), x, reach)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        rows = 0
        for batch in batches:
            x, g, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = x.view(np.uint64)
            if not len(x):
                continue
            held.append((x, g, c))
            rows += len(x)
            if rows >= 1 << 17:
                x, g, c = (np.concatenate(v) for v in zip(*held))
                last = np.flatnonzero((g != g[-1]) | (c != c[-1]))
                cut = last[-1] + 1 if len(last) else 0  # the last cell may go on in the next batch
                if cut:
                    yield flush([(x[:cut], g[:cut], c[:cut])])
                held, rows = [(x[cut:], g[cut:], c[cut:])], 0
        if held:
            yield flush(held)

    return keyed.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, reach: int = 4, blocks: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, fp long, component_id).

    Texts link when their fingerprints differ in `reach` bits or fewer;
    component_id is the smallest id reachable. Null and blank texts have
    fingerprint 0 and link like any other; shorter texts than a shingle hash
    whole. Rows with a null id are kept and take part, without giving their id to a component.
    Repeated rows stay repeated. Other columns play no part, whatever their names.
    An empty table gives an empty result.
    """
    prints = written(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text", "fp", words).select("doc_id", "fp"))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(written(fingerprint_links(classes, reach, blocks)))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def without_near_copies(docs: DataFrame, words: int = 5, reach: int = 4, blocks: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component of near_duplicates(): that of the smallest id.

    Links are those of the fingerprints, all of them; no other measure adds or
    removes one. Null and blank texts are one group. Repeated rows of an id stay
    together; an id with different texts stays where it is the smallest of one of
    their components, so that no component is left without a document. Rows with
    a null id always stay and link nothing. Columns of any name pass through; an
    empty table gives an empty table.
    """
    groups = near_duplicates(docs.filter(F.col(id_col).isNotNull()), words, reach, blocks, id_col, text_col)
    stays = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = written(stays.filter(~F.col("stays")).select(F.col("doc_id").alias("__near_copy")))
    return without_ids(docs, id_col, gone)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets given as arrays of distinct values; 1 for two empty ones."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


#: The order of shingles puts those that a sample of so many texts holds HOT_DF times or more last, up to HOT of them. Any order finds the same pairs.
SAMPLE, HOT_DF, HOT = 30_000, 4, 200_000


def frequent_shingles(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Hashes of frequent shingles of a sample of the texts, the rarest first."""

    @F.pandas_udf("array<long>")
    def shingles(texts):
        return texts.map(lambda t: np.unique(_shingles(_words(t), words)).view(np.int64))

    every = max(1, round(docs.count() / SAMPLE))
    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    found = some.select(F.explode(shingles(F.col(text))).alias("h")).groupBy("h").count().filter(F.col("count") >= HOT_DF)
    found = found.orderBy(F.desc("count"), "h").limit(HOT).toPandas()
    return found["h"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def prefix(shingles: np.ndarray, similarity: float, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles (sorted, distinct) that come first in one order of all: two sets of the similarity share one of these.

    A partner shares at least similarity x n of n shingles, so all but
    similarity x n of them, and one more, cannot all be missing from it. Frequent
    shingles (`known`, sorted, with their `rank`) come last in the order.
    """
    n = len(shingles)
    size = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not len(known):
        return shingles[:size]
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    hot = known[at] == shingles
    late = shingles[hot][np.argsort(rank[at[hot]])]
    return np.concatenate((shingles[~hot], late))[:size]


def _runs(keyed: DataFrame, schema: str, work) -> DataFrame:
    """work(columns) on stretches of `keyed` that hold the groups of its first column (sorted) whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)])
                rows += batch.num_rows
            if rows >= 1 << 17:
                every = [np.concatenate(v) for v in zip(*held)]
                other = np.flatnonzero(every[0] != every[0][-1])
                cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
                if cut:
                    yield work([v[:cut] for v in every])
                held = [[v[cut:] for v in every]]
                rows = 0
        if held:
            every = [np.concatenate(v) for v in zip(*held)]
            if len(every[0]):
                yield work(every)

    return keyed.mapInArrow(run, schema)


def _bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return first, np.append(first[1:], len(h))


#: Longs of a text's parity map: a bit for each of 64 x WORDS classes of shingles, set if the text holds an odd number of the class.
MAP_WORDS = 8


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity map of a set of shingle hashes. Each shingle that only one of two sets holds flips one bit, so two maps never differ in more bits than the sets in shingles."""
    odd = np.bincount((shingles % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _possible(n: np.ndarray, pos: np.ndarray, maps: list[np.ndarray], at: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets of n values, sharing the ones at pos first, can have the similarity: by what may follow there, and by their parity maps."""
    both = n[at].astype(np.int64) + n[to]
    near = np.minimum(n[at] - pos[at], n[to] - pos[to]) >= similarity / (1 + similarity) * both - 1e-6
    if maps and near.any():
        left = np.flatnonzero(near)
        apart = sum(np.bitwise_count(m[at[left]] ^ m[to[left]]).astype(np.int64) for m in maps)
        near[left] = apart <= (1 - similarity) / (1 + similarity) * both[left] + 1e-6
    return near


MAPS = [f"m{k}" for k in range(MAP_WORDS)]


def meetings(prefixes: DataFrame, similarity: float) -> DataFrame:
    """The rows of `prefixes` (h, n, iid, pos, and m0, m1, ... where it has them) that share the shingle h with a text that can be near."""
    names = ["h", "n", "iid", "pos", *[m for m in MAPS if m in prefixes.columns]]

    def work(columns):
        h, n, _, pos, *maps = columns
        maps = [m.view(np.uint64) for m in maps]
        first, end = _bounds(h)
        stop = np.repeat(end, end - first)
        shared = np.zeros(len(h), bool)
        at, d = np.arange(len(h)), 1
        while len(at := at[at + d < stop[at]]):
            at = at[n[at] >= similarity * n[at + d] - 1e-6]
            near = _possible(n, pos, maps, at, at + d, similarity)
            shared[at[near]] = shared[at[near] + d] = True
            d += 1
        return pa.RecordBatch.from_arrays([pa.array(v[shared]) for v in columns], names=names)

    schema = "h long, n int, iid long, pos int" + "".join(f", {m} long" for m in names[4:])
    return _runs(prefixes.select(*names).repartition("h").sortWithinPartitions("h", "n", "iid"), schema, work)


def met_pairs(met: DataFrame, similarity: float, adjacent: bool) -> DataFrame:
    """(a, b) with a < b: texts that share a shingle of `met` and can have the similarity by their sizes, the shingle's places and their parity maps.

    With adjacent only neighbours by size in each group; else all pairs of
    different `root`. No pair of the similarity is passed over: at the first
    shingle in order that both have, all shared ones come at or after it.
    """

    def work(columns):
        h, n, ids, pos, root, *maps = columns
        maps = [m.view(np.uint64) for m in maps]
        first, end = _bounds(h)
        stop = np.repeat(end, end - first)
        a, b = [], []
        at, d = np.arange(len(h)), 1
        while len(at := at[at + d < stop[at]]):
            at = at[n[at] >= similarity * n[at + d] - 1e-6]  # sorted by size: farther ones are larger still
            some = at[root[at] != root[at + d]]
            some = some[_possible(n, pos, maps, some, some + d, similarity)]
            a.append(ids[some])
            b.append(ids[some + d])
            d += 1
            if adjacent:
                break
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    keyed = met.select("h", "n", "iid", "pos", "root", *MAPS).repartition("h").sortWithinPartitions("h", "n", "iid")
    return _runs(keyed, "a long, b long", work).distinct()


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group of near copies: that of the smallest id.

    Texts link when they are the same words, or when their sets of `words`-word
    shingles have a Jaccard similarity of `similarity` or more. Every such pair
    shares one of the first shingles of both in a common order; what meets there and
    can be near by its parity map is decided on the whole sets. Neighbours by size come first, then all pairs that these
    have not put in one group. A group is what links reach. Null and blank texts
    are one group. Repeated rows of an id are one document and stay together;
    rows with a null id always stay. Columns of any name pass through; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    hot = frequent_shingles(texts, "_text", words)
    order = np.argsort(hot)
    known = hot[order]
    digest = lambda parts: xxhash.xxh3_128_hexdigest(b" ".join(parts))
    every = lambda parts: np.unique(_shingles(parts, words)) if parts else np.empty(0, np.uint64)

    @F.pandas_udf("key string, n int, first array<long>, map array<long>")
    def measure(texts):
        import pandas as pd

        out = []
        for t in texts:
            parts = _words(t)
            s = every(parts)
            out.append((digest(parts), len(s), prefix(s, similarity, known, order).view(np.int64), parity(s)))
        return pd.DataFrame(out, columns=["key", "n", "first", "map"])

    @F.pandas_udf("array<long>")
    def whole(texts, keys):
        import pandas as pd

        return pd.Series([every(p).view(np.int64) if digest(p) == k else None for p, k in zip(map(_words, texts), keys)], dtype=object)

    @F.pandas_udf("boolean")
    def alike(a, b):
        import pandas as pd

        return pd.Series([jaccard(x, y) >= similarity for x, y in zip(a, b)], dtype=bool)

    rows = written(texts.select("id", measure(F.col("_text")).alias("m")).select("id", "m.*"))
    items = rows.groupBy("key").agg(F.min("id").alias("least_id"))
    items = written(items.orderBy("least_id", "key").withColumn("iid", F.monotonically_increasing_id()))  # ids in this order, so that runs agree
    one = items.join(rows.withColumnRenamed("id", "least_id"), ["least_id", "key"]).dropDuplicates(["iid"])
    met = meetings(one.select(F.posexplode("first").alias("pos", "h"), "n", "iid").select("h", "n", "iid", "pos"), similarity)
    maps = one.select("iid", *[F.col("map")[k].alias(m) for k, m in enumerate(MAPS)])
    met = written(meetings(written(met).join(maps, "iid"), similarity))  # the maps of those that met at all
    ids = met.select("iid").distinct().join(items, "iid").select(F.col("least_id").alias("id"), F.col("key").alias("_key"), "iid")
    sets = texts.join(ids, "id").select("iid", whole(F.col("_text"), F.col("_key")).alias("held")).filter("held IS NOT NULL")
    sets = written(sets.dropDuplicates(["iid"]))
    side = lambda c: sets.select(F.col("iid").alias(c), F.col("held").alias(f"s{c}"))
    linked = lambda pairs: written(pairs.join(side("a"), "a").join(side("b"), "b").filter(alike("sa", "sb")).select("a", "b"))

    near = linked(written(met_pairs(met.withColumn("root", F.col("iid")), similarity, adjacent=True)))
    roots = written(components(near)).withColumnRenamed("node", "iid")
    apart = met.join(roots, "iid", "left").withColumn("root", F.coalesce("root", "iid"))
    far = linked(written(met_pairs(apart, similarity, adjacent=False)))
    placed = items.join(components(near.union(far)).withColumnRenamed("node", "iid"), "iid", "left").withColumn("root", F.coalesce("root", "iid"))
    stay = placed.groupBy("root").agg(F.min("least_id").alias("keep"))
    gone = rows.join(placed.join(stay, "root").select("key", "keep"), "key").filter("id <> keep").select(F.col("id").alias("__near_copy")).distinct()
    return docs.join(written(gone), F.col(id_col) == F.col("__near_copy"), "left_anti")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
