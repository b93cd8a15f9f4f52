"""Mixing sources to target weights (1): iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

import logging
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import uniform, written

#: Up to this many cells (tens of megabytes) are raked on the driver; more are raked as a table.
DRIVER_CELLS = 200_000
ROUNDS, TOLERANCE = 200, 1e-10

#: A target is shares by value, or a power: shares in proportion to the observed share to that power.
Target = Mapping[str | None, float] | float


def n_tokens(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A coarse topic told from the form of the text."""
    noisy = F.lit(False)
    for mark in ("***", "###", "$$$", "%%%", "&&&"):
        noisy = noisy | text.contains(mark)
    return (
        F.when(text.isNull() | (tokens < 50), "short")
        .when(text.contains(" | "), "tabular")
        .when(noisy, "symbolic")
        .when(F.lower(text).contains("licen"), "legal")
        .otherwise("prose")
    )


def _shares(sums: np.ndarray, values: list, target: Target) -> np.ndarray:
    if isinstance(target, Mapping):
        want = np.array([float(target.get(v, 0.0)) for v in values])
    else:
        want = np.where(sums > 0, np.maximum(sums, 1e-300) ** float(target), 0.0)
    total = want.sum()
    return want / total if total else want


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[Target]) -> np.ndarray:
    """Weights of `cells` (a tuple of values each): raked so that weight x tokens has the target shares in each dimension."""
    weight = np.ones(len(cells))
    codes, wants, total = [], [], tokens.sum()
    for k, target in enumerate(targets):
        values = list(dict.fromkeys(c[k] for c in cells))
        at = {v: i for i, v in enumerate(values)}
        code = np.array([at[c[k]] for c in cells], int)
        codes.append(code)
        wants.append(_shares(np.bincount(code, tokens, len(values)), values, target) * total)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, want in zip(codes, wants):
            have = np.bincount(code, weight * tokens, len(want))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, np.abs(factor[want > 0] - 1).max(initial=0.0))
            weight = weight * factor[code]
        if worst < TOLERANCE:
            return weight
    unsettled(worst)
    return weight


def unsettled(worst: float) -> None:
    """Says that the targets can't all be met, or not in ROUNDS rounds: the weights then meet the last dimension's."""
    logging.getLogger(__name__).warning("raking did not settle in %d rounds: the last one still changed a weight by a factor off 1 by %.3g", ROUNDS, worst)


def calibrate(weight: np.ndarray, tokens: np.ndarray, keep: float) -> float:
    """The multiplier m for which the tokens expected under min(1, m x weight) are `keep` of all, or all that can be had."""
    if not len(weight) or not (weight * tokens).sum():
        return 0.0
    low, high, want = 0.0, 1.0, keep * tokens.sum()
    while (tokens * np.minimum(1, high * weight)).sum() < want and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * weight)).sum() < want else (low, mid)
    return high


def _rake_table(cells: DataFrame, dims: list[str], targets: list[Target]) -> DataFrame:
    """`cells` with column weight, raked by joins: for more cells than the driver takes."""
    cells = cells.withColumn("tokens", F.col("tokens").cast("double"))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wants = []
    for d, target in zip(dims, targets):
        seen = cells.groupBy(d).agg(F.sum("tokens").alias("s"))
        if isinstance(target, Mapping):
            entries = [(k, float(v)) for k, v in target.items()]
            want = seen.join(cells.sparkSession.createDataFrame(entries, "_v string, want double"), F.col(d).eqNullSafe(F.col("_v")), "left").select(d, F.coalesce("want", F.lit(0.0)).alias("want"))
        else:
            want = seen.select(d, F.when(F.col("s") > 0, F.pow("s", F.lit(float(target)))).otherwise(0.0).alias("want"))
        scale = float(want.agg(F.sum("want")).first()[0] or 1.0)
        wants.append(written(want.withColumn("want", F.col("want") * (total / scale))))
    now = cells.withColumn("weight", F.lit(1.0))
    for _ in range(ROUNDS):
        worst = 0.0
        for d, want in zip(dims, wants):
            have = now.groupBy(d).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have"))
            f = written(have.join(want.withColumnRenamed(d, "_v"), F.col(d).eqNullSafe(F.col("_v"))).select(F.col("_v"), F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("f")))
            worst = max(worst, float(f.agg(F.max(F.when(F.col("f") > 0, F.abs(F.col("f") - 1)))).first()[0] or 0.0))
            before, now = now, written(now.join(f, F.col(d).eqNullSafe(F.col("_v"))).withColumn("weight", F.col("weight") * F.col("f")).drop("_v", "f"))
        if worst < TOLERANCE:
            return now
    unsettled(worst)
    return now


def _calibrate_table(cells: DataFrame, keep: float) -> float:
    """calibrate() by sums over the table of cells: 60 halvings of the multiplier's logarithm, 16 probes a job."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    low, high = -40.0, 40.0
    for _ in range(8):
        probes = np.linspace(low, high, 16)
        sums = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(np.exp2(p))) * F.col("weight"))) for p in probes]).first()
        over = [p for p, s in zip(probes, sums) if (s or 0) >= keep * total]
        if not over:
            return float(np.exp2(high))
        high, low = over[0], max([p for p in probes if p < over[0]], default=low)
    return float(np.exp2(high))


def _measured(docs: DataFrame, dims: list[str], id_col: str, text_col: str) -> DataFrame:
    """`docs` with _tokens and each dimension as a string in _0, _1, ..."""
    rows = docs.withColumn("__mix_tokens", n_tokens(F.col(text_col)))
    told = {d: topic(F.col(text_col), F.col("__mix_tokens")) if d == "topic" and "topic" not in docs.columns else F.col(d).cast("string") for d in dims}
    return rows.withColumns({f"__mix_{k}": told[d] for k, d in enumerate(dims)})


def _factors(measured: DataFrame, targets: Mapping[str, Target], keep: float, driver_cells: int) -> DataFrame:
    """(_f0, _f1, ..., weight, probability) for each cell of the measured rows; marked for broadcast only if counted and few enough for the driver."""
    keys = [f"__mix_{k}" for k in range(len(targets))]
    goals = list(targets.values())
    cells = written(measured.groupBy(*keys).agg(F.sum("__mix_tokens").alias("tokens")))
    if cells.count() <= driver_cells:
        got = [tuple(r) for r in cells.collect()]
        tokens = np.array([r[-1] for r in got], float)
        weight = rake([r[:-1] for r in got], tokens, goals)
        m = calibrate(weight, tokens, keep)
        schema = ", ".join(f"__mix_f{k} string" for k in range(len(goals))) + ", __mix_weight double, __mix_probability double"
        return F.broadcast(cells.sparkSession.createDataFrame([(*r[:-1], float(w), float(min(1.0, m * w))) for r, w in zip(got, weight)], schema))
    raked = _rake_table(cells, keys, goals)
    m = _calibrate_table(raked, keep)
    return raked.select(*[F.col(k).alias(f"__mix_f{k.rpartition('_')[2]}") for k in keys], F.col("weight").alias("__mix_weight"), F.least(F.lit(1.0), F.lit(m) * F.col("weight")).alias("__mix_probability"))


def _drawn(measured: DataFrame, factors: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """`measured` with weight, probability and _kept."""
    same = F.lit(True)
    for k in range(n):
        same = same & F.col(f"__mix_{k}").eqNullSafe(F.col(f"__mix_f{k}"))
    return measured.join(factors, same).withColumn("__mix_kept", uniform(F.col(id_col), seed) < F.col("__mix_probability"))


def mix(docs: DataFrame, targets: Mapping[str, Target], keep: float, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """One row per row of `docs`: doc_id, the dimensions of `targets`, n_tokens, weight, probability, kept.

    `targets` names a target for each dimension (columns of `docs`; `topic` is
    told from the text unless `docs` has it). weight is the cell's raked token
    weight; probability is min(1, m x weight), with m set so that the expected
    tokens are `keep` of all; kept compares it with a hash of the id, so repeated
    ids share their fate and a null id counts as an empty text. A null value of a
    dimension is a value of its own. A value that a target does not name gets
    nothing. Cells without tokens have the weight their values give. An empty
    table gives no rows; other columns are not read.
    """
    own = [c for c in {id_col, text_col, *targets} if c in docs.columns]
    rows = _measured(docs.select(*own), list(targets), id_col, text_col)
    rows = written(rows.select(F.col(id_col).alias("doc_id"), "__mix_tokens", *[f"__mix_{k}" for k in range(len(targets))]))
    out = _drawn(rows, _factors(rows, targets, keep, driver_cells), len(targets), seed, "doc_id")
    return out.select("doc_id", *[F.col(f"__mix_{k}").alias(d) for k, d in enumerate(targets)], F.col("__mix_tokens").alias("n_tokens"), F.col("__mix_weight").alias("weight"), F.col("__mix_probability").alias("probability"), F.col("__mix_kept").alias("kept"))


def sampled(docs: DataFrame, targets: Mapping[str, Target], keep: float, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The rows of `docs` that mix() keeps, with their columns; texts are read twice, and not shuffled unless there are more than `driver_cells` cells."""
    own = [c for c in {id_col, text_col, *targets} if c in docs.columns]
    factors = _factors(_measured(docs.select(*own), list(targets), id_col, text_col), targets, keep, driver_cells)
    return _drawn(_measured(docs, list(targets), id_col, text_col), factors, len(targets), seed, id_col).filter("__mix_kept").select(*[docs[c] for c in docs.columns])
