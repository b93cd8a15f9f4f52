"""Statistics over the signals: contingency tests, clusters, hierarchies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, row: str, column: str, values: list[str], measure: str = "n") -> DataFrame:
    """Rows by columns with zeros where a cell is empty; the column values are given, so no job looks for them."""
    return df.groupBy(row).pivot(column, values).agg(F.sum(measure)).na.fill(0)


def chi_square_p(statistic: float, dof: int) -> float:
    """P(chi-square with `dof` degrees of freedom >= statistic): the regularised upper gamma function of dof/2 at statistic/2."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300  # continued fraction of the upper one
    d = h = 1 / b
    for n in range(1, 10_000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


def clusters(features: DataFrame, columns: list[str], ks: range = range(3, 11), seed: int = 42) -> tuple[DataFrame, dict[int, float]]:
    """Standardised k-means; the k of the best silhouette, with the silhouette of each."""
    v = VectorAssembler(inputCols=columns, outputCol="_raw").transform(features)
    v = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(v).transform(v).persist()
    scores, best = {}, None
    for k in ks:
        out = KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v)
        scores[k] = ClusteringEvaluator().evaluate(out)
        if best is None or scores[k] > best[0]:
            best = (scores[k], out)
    v.unpersist()
    return best[1].drop("_raw", "features").withColumnRenamed("prediction", "cluster"), scores


def ward(matrix: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward's merges over the rows of a small matrix (sources by features): (a, b, height), clusters numbered on from the rows."""
    sizes = {k: 1 for k in range(len(matrix))}
    centres = {k: np.asarray(row, float) for k, row in enumerate(matrix)}
    out, new = [], len(matrix)
    while len(centres) > 1:
        keys = sorted(centres)
        gap = lambda a, b: float(np.sqrt(2 * sizes[a] * sizes[b] / (sizes[a] + sizes[b])) * np.linalg.norm(centres[a] - centres[b]))
        height, a, b = min((gap(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        centres[new] = (sizes[a] * centres.pop(a) + sizes[b] * centres.pop(b)) / (sizes[a] + sizes[b])
        sizes[new] = sizes.pop(a) + sizes.pop(b)
        out.append((a, b, height))
        new += 1
    return out


def recall_estimate(both: float, only: float, miss: float) -> float | None:
    """both / (both + only x miss), or none without a denominator."""
    total = both + only * miss
    return both / total if total else None
