"""Embedding near-duplicates (8): collision counting over sorted one-dimensional projections.

A line is a direction: the signed sum of `axes` axes of one of several random
rotations. In each rotation a vector is put on the line on which it projects
the farthest, which its largest coordinates name without trying all lines. Each
line is sorted by projection, and two vectors collide where one lies in the
window around the other. Pairs that collide in at least the calibrated number of
rotations are verified in double precision. Rotations are drawn from the Haar
measure, so the count of a pair depends in distribution on its cosine alone,
whatever the data; the calibration simulates pairs at the threshold itself.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: Vectors a line should hold on average, at most: sets the axes of a line from the number of vectors.
PER_LINE = 4
#: Share of pairs at the threshold that the window may miss in one projection, and that the count may lose.
WINDOW_LOSS, COUNT_LOSS = 0.02, 0.01
SEED = 8


def rotation(dim: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, number)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lines(unit: np.ndarray, number: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """The line of each row of `unit` in one rotation (an integer key) and the projection on it."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, number)
    axes = min(axes, dim)
    top = np.sort(np.argpartition(-np.abs(turned), axes - 1, axis=1)[:, :axes], axis=1)
    value = np.take_along_axis(turned, top, axis=1)
    key = np.full(len(unit), number, np.int64)
    for k in range(axes):
        key = key * (2 * dim) + 2 * top[:, k] + (value[:, k] > 0)
    return key, np.abs(value).sum(axis=1) / math.sqrt(axes)


def n_lines(dim: int, axes: int) -> int:
    return math.comb(dim, min(axes, dim)) << min(axes, dim)


def axes_for(n: int, dim: int) -> int:
    """Fewest axes for which the lines hold PER_LINE vectors on average or fewer; three at most."""
    return next((k for k in (1, 2) if n <= PER_LINE * n_lines(dim, k)), 3)


def calibrate(dim: int, axes: int, cosine: float, least: int = 2, pairs: int = 4000) -> tuple[int, float, int]:
    """(rotations, window, count): the window that keeps all but WINDOW_LOSS of the projections of pairs at `cosine`,
    and as many rotations as make all but COUNT_LOSS of such pairs collide `count` >= `least` times."""
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((pairs, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * np.divide(b, norm, out=np.zeros_like(b), where=norm > 0)
    key_a, at_a = lines(a, 0, axes)
    key_b, at_b = lines(b, 0, axes)
    met = key_a == key_b
    window = float(np.quantile(np.abs(at_a - at_b)[met], 1 - WINDOW_LOSS)) if met.any() else 1.0
    count = np.zeros(pairs, int)
    for number in range(1, 513):
        key_a, at_a = lines(a, number, axes)
        key_b, at_b = lines(b, number, axes)
        count += (key_a == key_b) & (np.abs(at_a - at_b) <= window)
        if number % 4 == 0 and (count < least).mean() <= COUNT_LOSS / 2:
            return number, window, int(np.quantile(count, COUNT_LOSS / 2, method="lower"))
    met = float((count > 0).mean())
    logging.getLogger(__name__).warning("no count of %d rotations keeps %.1f %% of pairs at cosine %g in %d dimensions; with one collision %.1f %% are kept", 512, 100 * (1 - COUNT_LOSS), cosine, dim, 100 * met)
    return 512, window, 1


def window_pairs(key: np.ndarray, at: np.ndarray, ids: np.ndarray, window: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Colliding pairs of rows sorted by (key, at), a distance in the order at a time."""
    left, d = np.arange(len(key)), 1
    while len(left := left[left + d < len(key)]):
        left = left[(key[left] == key[left + d]) & (at[left + d] - at[left] <= window)]
        if len(left):
            yield ids[left], ids[left + d]
        d += 1


def _projected(classes: DataFrame, rotations: int, axes: int) -> DataFrame:
    """(line long, at double, cid long) for each class and rotation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() :]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for dim in np.unique(lengths):
                of = np.flatnonzero(lengths == dim)
                x = flat[starts[of][:, None] + np.arange(dim)].astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for number in range(1, rotations + 1):
                    key, at = lines(x, number, axes)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.array(ids[of])], names=["line", "at", "cid"])

    return classes.select("cid", "v").mapInArrow(run, "line long, at double, cid long")


def _collisions(projected: DataFrame, window: float) -> DataFrame:
    """(a, b) for every collision; lines are dealt out by hash and read in order, a run of lines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts):
            for a, b in window_pairs(*parts, window):
                for k in range(0, len(a), 1 << 16):
                    p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            if sum(len(h[0]) for h in held) >= 1 << 16:
                key, at, ids = (np.concatenate(v) for v in zip(*held))
                other = np.flatnonzero(key != key[-1])
                cut = int(other[-1]) + 1 if len(other) else 0  # the last line may go on
                if cut:
                    yield from flush((key[:cut], at[:cut], ids[:cut]))
                held = [(key[cut:], at[cut:], ids[cut:])]
        if held:
            yield from flush(tuple(np.concatenate(v) for v in zip(*held)))

    return projected.repartition("line").sortWithinPartitions("line", "at").mapInArrow(run, "a long, b long")


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of `vectors` (vec_id, v array<double>): equal usable vectors are one class.

    rows: vec_id, v, h, a hash of v that stands first in sorts (both null if the
    vector is null, zero or holds null or non-finite components). classes: cid,
    h, v, size, least (smallest vec_id).
    """
    usable = F.expr("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    rows = vectors.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))))
    rows = written(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))))
    classes = rows.filter("v IS NOT NULL").groupBy("h", "v").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    return rows, classes


def linked_pairs(classes: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(a, b) with a < b: classes found by collision counting whose cosine, in double precision, is `cosine` or more."""
    spark = classes.sparkSession
    shapes = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()
    out = spark.createDataFrame([], "a long, b long")
    scaled = classes.withColumn("m", F.expr("array_max(transform(v, x -> abs(x)))")).withColumn("w", F.expr("transform(v, x -> x / m)"))
    unit = written(scaled.withColumn("l", F.expr(f"sqrt({dot('w', 'w')})")).select("cid", F.size("v").alias("dim"), "w", "l"))
    for dim, n in shapes:
        own = classes.filter(F.size("v") == dim)
        axes = axes_for(n, dim)
        rotations, window, count = calibrate(dim, axes, cosine)
        met = _collisions(_projected(own, rotations, axes), window).groupBy("a", "b").agg(F.count("*").alias("k")).filter(F.col("k") >= count)
        side = lambda x: unit.select(F.col("cid").alias(x), F.col("w").alias(f"w{x}"), F.col("l").alias(f"l{x}"))
        near = met.join(side("a"), "a").join(side("b"), "b").filter(F.expr(f"{dot('wa', 'wb')} / (la * lb) >= {cosine!r}D"))
        out = out.union(near.select("a", "b"))
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    n_links counts the other rows whose vectors link directly, equal ones
    included; component_id is the smallest id reachable, itself included; kept
    says that the row has that id. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, as do vectors of different
    lengths. Rows with a null id count as links and lend no id; their own
    component_id is that of their links, or null. Repeated rows stay repeated.
    Equal vectors are one class, so copies are never expanded into pairs.
    An empty table gives no rows; other columns are not read.
    """
    rows, classes = vector_classes(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")))
    links = written(linked_pairs(classes, cosine))
    sizes = classes.select("cid", "size")
    both = links.select("a", "b").union(links.select("b", "a"))
    direct = both.join(sizes.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("size").alias("others"))
    placed = classes.select("cid", "h", "v", "size", "least").join(components(links).withColumnRenamed("node", "cid"), "cid", "left").join(direct, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = written(placed)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(least, "root").select(F.col("h").alias("_h"), F.col("v").alias("_v"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(of, (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("_v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
