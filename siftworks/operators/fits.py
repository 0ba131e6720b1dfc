"""Fits: sums are taken by Spark, the small systems that remain are solved on the driver."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siftworks.operators.resample import bootstrap_rounds, interval


def _normal_sums(df: DataFrame, basis: list[Column], target: Column, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    n = len(basis)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*(F.sum(weight * basis[i] * basis[j]).alias(f"m{i}_{j}") for i, j in upper), *(F.sum(weight * basis[i] * target).alias(f"v{i}") for i in range(n))).first()
    m = np.zeros((n, n))
    for i, j in upper:
        m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
    return m, np.array([row[f"v{i}"] or 0.0 for i in range(n)])


def robust_fit(df: DataFrame, basis: list[Column], target: Column, passes: int = 3, huber: float = 1.0, ridge: float = 1e-6, bound: float | None = None) -> np.ndarray:
    """Iteratively reweighted least squares with Huber weights, a ridge scaled by the trace, and coefficients held to +-bound.

    The residual's scale is the last pass's mean absolute residual.  A singular system raises.
    """
    weight: Column = F.lit(1.0)
    out = np.zeros(len(basis))
    for _ in range(passes):
        m, v = _normal_sums(df, basis, target, weight)
        out = np.linalg.solve(m + np.eye(len(v)) * ridge * np.trace(m) / len(v), v)
        if bound is not None:
            out = np.clip(out, -bound, bound)
        guess = sum((float(c) * b for c, b in zip(out, basis, strict=True)), F.lit(0.0))
        gap = F.abs(target - guess)
        scale = max(1e-12, df.agg(F.avg(gap)).first()[0] or 0.0)
        weight = F.least(F.lit(1.0), F.lit(huber * scale) / F.greatest(gap, F.lit(1e-12)))
    return out


def ridge_bias(df: DataFrame, keys: list[str], residual: str, ridge: float) -> DataFrame:
    """sum(residual) / (n + ridge) of each key."""
    return df.groupBy(*keys).agg((F.sum(residual) / (F.count(residual) + ridge)).alias("bias"))


def best_on_grid(df: DataFrame, keys: list[str], value: str, other: str, target: str, steps: int = 41) -> DataFrame:
    """The weight of value against other, of steps from 0 to 1, with the least mean |error|; the smallest of equals."""
    grid = [i / (steps - 1) for i in range(steps)]
    errors = df.groupBy(*keys).agg(*(F.avg(F.abs(w * F.col(value) + (1 - w) * F.col(other) - F.col(target))).alias(f"e{i}") for i, w in enumerate(grid)))
    pairs = F.array(*(F.struct(F.col(f"e{i}").alias("error"), F.lit(w).alias("weight")) for i, w in enumerate(grid)))
    return errors.select(*keys, F.array_min(pairs).alias("_best")).select(*keys, F.col("_best.weight").alias("weight"), F.col("_best.error").alias("error"))


def isotonic(df: DataFrame, keys: list[str], at: str, value: str, weight: str) -> DataFrame:
    """Weighted isotonic regression (pool adjacent violators) of each key's points: keys, at, fitted.

    A key's points are bins, so their number is bounded by the binning, not by the data.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        pools: list[list[float]] = []  # mean, weight, points
        for v, w in zip(pdf[value].tolist(), pdf[weight].tolist(), strict=True):
            pools.append([v, w, 1])
            while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
                v1, w1, n1 = pools.pop()
                v0, w0, n0 = pools.pop()
                pools.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
        fitted = [v for v, _, n in pools for _ in range(int(n))]
        return pdf[[*keys, at]].assign(fitted=np.maximum.accumulate(np.asarray(fitted, dtype=float)))

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, at)) + ", fitted double"
    return df.select(*keys, at, F.col(value).cast("double").alias(value), F.col(weight).cast("double").alias(weight)).groupBy(*keys).applyInPandas(run, schema)


def cluster_bootstrap(df: DataFrame, cluster: str, before: str, after: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """Clusters resampled with replacement: 2.5 %, 50 % and 97.5 % of mean(before - after), and how often it is positive.

    Every round draws exactly as many clusters as there are; see resample.
    """
    gaps = df.select(F.col(cluster).alias("_c"), (F.col(before) - F.col(after)).alias("_gap"))
    return interval(bootstrap_rounds(gaps, "_c", "_gap", rounds, seed))
