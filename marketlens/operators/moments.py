"""Moment conditions of an uncertainty index over a grid of weights, with a bootstrap weighting matrix and the J statistic.

The index is a weighted sum of three proxies brought to 0..1 by its least and greatest value.  For linear sums all moments follow from
sums, products and sums by regime of the proxies, which one grouped aggregate gives; only the least and greatest value need every weight,
and these travel as one array a task and group.  No row is copied per weight or replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import resample as R

# What the moments should be (mean, spread, gap of extreme greed and of extreme fear over neutral days).
TARGETS = (0.5, 0.2, 0.10, 0.05)
SIDES = {"greed": "extreme_greed", "fear": "extreme_fear", "calm": "neutral"}


def simplex(steps: int = 20) -> list[tuple[float, float, float]]:
    """Weights of three proxies that add up to one, ``steps`` a side."""
    return [(i / steps, j / steps, (steps - i - j) / steps) for i in range(steps + 1) for j in range(steps + 1 - i)]


def _ranges(df: DataFrame, by: str, proxies: list[str], weights: list[tuple]) -> DataFrame:
    """by, lo, hi: least and greatest weighted sum for each weight."""
    w = np.array(weights).T
    kind = f"`{by}` {df.schema[by].dataType.simpleString()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, own in pdf.groupby(by, dropna=False):
                raw = own[proxies].to_numpy(np.float64) @ w
                lo, hi = held.get(key, (np.inf, -np.inf))
                held[key] = np.minimum(lo, raw.min(axis=0)), np.maximum(hi, raw.max(axis=0))
        yield pd.DataFrame({by: list(held), "lo": [v[0] for v in held.values()], "hi": [v[1] for v in held.values()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[by]].iloc[:1].assign(lo=[np.min(np.stack(pdf["lo"].to_list()), axis=0)], hi=[np.max(np.stack(pdf["hi"].to_list()), axis=0)])

    schema = f"{kind}, lo array<double>, hi array<double>"
    return df.select(by, *proxies).mapInPandas(run, schema).groupBy(by).applyInPandas(merge, schema)


def moment_grid(df: DataFrame, proxies: list[str], by: str = "symbol", weights: list[tuple] | None = None) -> DataFrame:
    """by, w (array), lo, hi and g (array of four): the distance of each moment from its target under every weight.

    ``df`` has the proxies without nulls and ``regime``.  Where a regime does not occur its mean is the mean of all."""
    weights = weights or simplex()
    p = [F.col(c) for c in proxies]
    k = len(p)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(p)] + [F.sum(p[i] * p[j]).alias(f"q{i}{j}") for i in range(k) for j in range(i, k)]
    for name, regime in SIDES.items():
        test = F.col("regime") == regime
        sums += [F.count(F.when(test, 1)).alias(f"{name}_n"), *[F.sum(F.when(test, c)).alias(f"{name}{i}") for i, c in enumerate(p)]]
    stats = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *sums)
    places = F.array(*[F.array(*map(F.lit, w)) for w in weights])
    rows = stats.join(_ranges(df, by, proxies, weights), by).select("*", F.posexplode(places).alias("_i", "w"))
    w = [F.get("w", i) for i in range(k)]
    lo, hi = F.get("lo", F.col("_i")), F.get("hi", F.col("_i"))
    dot = lambda prefix: sum((w[i] * F.col(f"{prefix}{i}") for i in range(k)), F.lit(0.0))
    n, scale = F.col("n"), hi - lo
    mean = dot("s") / n
    square = sum((w[i] * w[j] * F.col(f"q{min(i, j)}{max(i, j)}") for i in range(k) for j in range(k)), F.lit(0.0))
    std = F.sqrt(F.greatest(square - n * mean * mean, F.lit(0.0)) / (n - 1))
    of = {name: F.coalesce(F.try_divide(dot(name), f"{name}_n"), mean) for name in SIDES}
    moments = [(mean - lo) / scale, std / scale, (of["greed"] - of["calm"]) / scale, (of["fear"] - of["calm"]) / scale]
    return rows.where(hi > lo).select(by, "n", "w", lo.alias("lo"), hi.alias("hi"), F.array(*[m - t for m, t in zip(moments, TARGETS)]).alias("g"))


def quadratic(g: str | Column, weighting: Column | None = None) -> Column:
    """g' W g; without W the sum of squares.  W is an array, row by row."""
    k = len(TARGETS)
    at = lambda i: F.get(g, i)
    if weighting is None:
        return sum((at(i) * at(i) for i in range(k)), F.lit(0.0))
    return sum((at(i) * at(j) * F.get(weighting, i * k + j) for i in range(k) for j in range(k)), F.lit(0.0))


def best_weights(grid: DataFrame, objective: Column, by: str = "symbol") -> DataFrame:
    """The weights of the least objective, the first in order among equal ones."""
    picked = F.min_by(F.struct("w", "lo", "hi", "g"), F.struct(F.round("_j", 9), "w"))
    return grid.withColumn("_j", objective).groupBy(by).agg(picked.alias("b"), F.min("_j").alias("objective")).select(by, "b.*", "objective")


def bootstrap_weighting(df: DataFrame, row: str, proxies: list[str], at: DataFrame, n: int = 500, by: str = "symbol") -> DataFrame:
    """by and ``weighting``: the inverse of the moments' covariance over ``n`` bootstrap replicates of the index under the weights ``at``.

    ``at`` has by, w, lo, hi; the index keeps the least and greatest value of the whole sample.  No row where the covariance has no inverse."""
    joined = df.join(at.select(by, "w", "lo", "hi"), by)
    raw = sum((F.get("w", i) * F.col(c) for i, c in enumerate(proxies)), F.lit(0.0))
    joined = joined.withColumn("u", (raw - F.col("lo")) / (F.col("hi") - F.col("lo")))
    u = F.col("u")
    sums = {"all_n": F.lit(1.0), "all_u": u, "all_uu": u * u}
    for name, regime in SIDES.items():
        test = F.col("regime") == regime
        sums |= {f"{name}_n": F.when(test, 1.0), f"{name}_u": F.when(test, u)}
    mean = F.try_divide("all_u", "all_n")
    of = {name: F.coalesce(F.try_divide(f"{name}_u", f"{name}_n"), mean) for name in SIDES}
    std = F.sqrt(F.greatest(F.col("all_uu") - F.col("all_n") * mean * mean, F.lit(0.0)) / (F.col("all_n") - 1))
    moments = [mean, std, of["greed"] - of["calm"], of["fear"] - of["calm"]]
    draws = R.resampled(joined, row, sums, {f"m{i}": m - t for i, (m, t) in enumerate(zip(moments, TARGETS))}, n, [by])

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = np.cov(pdf[[f"m{i}" for i in range(len(TARGETS))]].dropna().to_numpy().T)
        if not np.isfinite(cov).all() or np.linalg.matrix_rank(cov) < len(TARGETS):
            return pd.DataFrame({by: [], "weighting": []}, dtype=object)
        return pdf[[by]].iloc[:1].assign(weighting=[np.linalg.inv(cov).ravel()])

    return draws.groupBy(by).applyInPandas(invert, f"`{by}` {df.schema[by].dataType.simpleString()}, weighting array<double>")
