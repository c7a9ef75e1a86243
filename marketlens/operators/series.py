"""Time-series tests and models over lagged columns.

Each is one or two grouped aggregates of product sums on Spark (``stats.normal_equations``); what is solved afterwards is one small
matrix a series.  ``order`` must order a series' rows without ties; rows with a null in a used column are left out first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators import scans, stats

# fixed values: MacKinnon's response surfaces of the Dickey-Fuller test with a constant, KPSS levels, Johansen's 95 % values
ADF_LEVELS = {"crit_1": (-3.43035, -6.5393, -16.786, -79.433), "crit_5": (-2.86154, -2.8903, -4.234, -40.040), "crit_10": (-2.56677, -1.5384, -2.809, 0.0)}
ADF_LOW, ADF_HIGH, ADF_BEND = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61
KPSS_LEVELS, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)
TRACE_95, MAX_EIGEN_95 = 15.4943, 14.2639


def lagged(df: DataFrame, cols: list[str], lags: Iterable[int], by: str = "symbol", order: str = "date") -> DataFrame:
    """``by``, ``order``, the columns without nulls, ``pos`` from 1 and ``<col>_<k>``, the value k rows before."""
    series = Window.partitionBy(by).orderBy(order)
    rows = df.where(" and ".join(f"{c} is not null" for c in cols)).select(by, order, *[F.col(c).cast("double").alias(c) for c in cols])
    return rows.select("*", F.row_number().over(series).alias("pos"), *[F.lag(c, k).over(series).alias(f"{c}_{k}") for c in cols for k in lags])


def solved(sums: DataFrame, k: int, keys: list[str], finish: Callable[[dict, np.ndarray], Iterable[dict]], result: str) -> DataFrame:
    """``finish(row, matrix)`` on each group's symmetric matrix of product sums, k regressors and the outcome."""
    names = keys + [f.split()[0] for f in result.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], np.float64)
                out += [{**{c: row[c] for c in keys}, **found} for found in finish(row, g)]
            yield pd.DataFrame(out, columns=names)

    schema = ", ".join([*[f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys], result])
    return sums.mapInPandas(run, schema)


def fit(g: np.ndarray, use: list[int]) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Coefficients, residual sum of squares and inverse of the outcome (last) on the named regressors; None if they are collinear."""
    a, b = g[np.ix_(use, use)], g[use, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    unit = a / np.outer(scale, scale)
    if np.linalg.matrix_rank(unit, tol=1e-10) < len(use):
        return None
    inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    coef = inverse @ b
    return coef, max(float(g[-1, -1] - coef @ b), 0.0), inverse


def granger(df: DataFrame, y: str, x: str, lags: list[int], by: str = "symbol", order: str = "date") -> DataFrame:
    """F and p of the joint hypothesis that ``x``'s past does not help to predict ``y``, for each number of lags.

    Every number of lags uses all rows that have so many before them.
    """
    most = max(lags)
    rows = lagged(df, [y, x], range(1, most + 1), by, order).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).where("pos > lag")
    past = [f"{c}_{k}" for c in (y, x) for k in range(1, most + 1)]
    rows = rows.withColumns({f"{c}_{k}": F.when(F.col("lag") >= k, F.col(f"{c}_{k}")).otherwise(0.0) for c in (y, x) for k in range(1, most + 1)})

    def finish(row, g):
        p, n = int(row["lag"]), int(row["n"])
        own, other = list(range(p + 1)), list(range(1 + most, 1 + most + p))
        small, full = fit(g, own), fit(g, own + other)
        if small and full and n > 2 * p + 1 and full[1] > 0:
            f = (small[1] - full[1]) / p / (full[1] / (n - 2 * p - 1))
            yield {"n": n, "f": f, "p": stats.f_sf(f, p, n - 2 * p - 1)}

    return solved(stats.normal_equations(rows, y, past, [by, "lag"]), 2 * most + 1, [by, "lag"], finish, "n long, f double, p double")


def dickey_fuller_p(tau: float) -> float:
    terms = ADF_LOW if tau <= ADF_BEND else ADF_HIGH
    return 0.0 if tau < -18.83 else 1.0 if tau > 2.74 else 0.5 * math.erfc(-sum(c * tau**i for i, c in enumerate(terms)) / math.sqrt(2))


def dickey_fuller(df: DataFrame, col: str, most: int = 12, by: str = "symbol", order: str = "date") -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: the number of lagged changes, up to ``most``, has the least AIC on common rows,
    then the test uses all rows that have so many before them."""
    base = lagged(df, [col], [1], by, order).where("pos > 1").withColumn("_d", F.col(col) - F.col(f"{col}_1"))
    series = Window.partitionBy(by).orderBy(order)
    rows = base.select(by, "pos", F.col(f"{col}_1").alias("_level"), "_d", *[F.lag("_d", k).over(series).alias(f"_d{k}") for k in range(1, most + 1)])
    xs = ["_level", *[f"_d{k}" for k in range(1, most + 1)]]

    def choose(row, g):
        n, scores = int(row["n"]), []
        for p in range(most + 1):
            found = fit(g, list(range(p + 2)))
            if found and found[1] > 0 and n > p + 2:
                scores.append((n * math.log(found[1] / n) + 2 * (p + 2), p))
        if scores:
            yield {"_p": min(scores)[1]}

    chosen = solved(stats.normal_equations(rows, "_d", xs, [by]), most + 2, [by], choose, "_p int")
    again = rows.join(chosen, by).where(F.col("pos") > F.col("_p") + 1)
    again = again.withColumns({f"_d{k}": F.when(F.col("_p") >= k, F.col(f"_d{k}")).otherwise(0.0) for k in range(1, most + 1)})

    def finish(row, g):
        p, n = int(row["_p"]), int(row["n"])
        coef, rss, inverse = fit(g, list(range(p + 2))) or (None, 0.0, None)
        if coef is not None and rss > 0 and n > p + 2:
            tau = coef[1] / math.sqrt(inverse[1, 1] * rss / (n - p - 2))
            yield {"n": n, "lags": p, "tau": tau, "p": dickey_fuller_p(tau), **{k: sum(c / n**i for i, c in enumerate(v)) for k, v in ADF_LEVELS.items()}}

    result = "n long, lags int, tau double, p double, crit_1 double, crit_5 double, crit_10 double"
    return solved(stats.normal_equations(again, "_d", xs, [by, "_p"]), most + 2, [by, "_p"], finish, result).drop("_p")


def kpss(df: DataFrame, col: str, lags: int | None = None, by: str = "symbol", order: str = "date") -> DataFrame:
    """KPSS test of a level: partial sums against the Bartlett-weighted variance; without ``lags`` each series takes Hobijn's choice.

    p is interpolated between the published levels and stays within 0.01 to 0.10.
    """
    series = Window.partitionBy(by).orderBy(order)
    rows = df.where(F.col(col).isNotNull()).select(by, order, (F.col(col) - F.avg(col).over(Window.partitionBy(by))).alias("_e"))

    def products(most: int) -> DataFrame:
        wide = rows.select(by, "_e", F.sum("_e").over(series).alias("_s"), *[F.lag("_e", k).over(series).alias(f"_{k}") for k in range(1, most + 1)])
        cross = [F.coalesce(F.sum(F.col("_e") * F.col(f"_{k}")), F.lit(0.0)) for k in range(1, most + 1)]
        return wide.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("ss"), F.array(F.sum(F.col("_e") * F.col("_e")), *cross).alias("c"))

    def weighted(c: Column, m: Column, f) -> Column:
        return F.aggregate(F.transform(F.slice(c, F.lit(2), m), f), F.lit(0.0), lambda a, v: a + v)

    if lags is None:
        longest = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 1
        p = products(int(longest ** (2 / 9)) + 1).withColumn("_m", F.floor(F.pow("n", F.lit(2 / 9))).cast("int"))
        s0 = F.get("c", 0) / F.col("n") + weighted(F.col("c"), F.col("_m"), lambda v: v / (F.col("n") / 2))
        s1 = weighted(F.col("c"), F.col("_m"), lambda v, i: (i + 1) * v / (F.col("n") / 2))
        auto = F.floor(1.1447 * F.pow(F.pow(F.try_divide(s1, s0), F.lit(2)), F.lit(1 / 3)) * F.pow("n", F.lit(1 / 3)))
        choice = p.select(by, F.least(F.coalesce(auto, F.lit(0)), F.col("n") - 1).cast("int").alias("lags"))
        # one number: how many lagged columns the second aggregate needs
        most = choice.agg(F.max("lags")).first()[0] or 0
        p = products(most).join(choice, by)
    else:
        p = products(lags).withColumn("lags", F.lit(lags))
    s2 = (F.get("c", 0) + 2 * weighted(F.col("c"), F.col("lags"), lambda v, i: v * (1 - (i + 1) / (F.col("lags") + 1)))) / F.col("n")
    p = p.select(by, "n", "lags", F.try_divide(F.col("ss") / (F.col("n") * F.col("n")), s2).alias("eta"))
    value = F.when(F.col("eta") <= KPSS_LEVELS[0], KPSS_P[0])
    for (a, pa), (b, pb) in zip(zip(KPSS_LEVELS, KPSS_P), zip(KPSS_LEVELS[1:], KPSS_P[1:])):
        value = value.when(F.col("eta") <= b, pa + (F.col("eta") - a) / (b - a) * (pb - pa))
    return p.withColumn("p", F.when(F.col("eta").isNotNull(), value.otherwise(KPSS_P[-1])))


def _var_sums(df: DataFrame, a: str, b: str, lags: int, by: str, order: str) -> tuple[DataFrame, int]:
    """Product sums of constant, a_1, b_1, .. a_lags, b_lags, a, b over the rows with so many before them."""
    rows = lagged(df, [a, b], range(1, lags + 1), by, order).where(F.col("pos") > lags)
    past = [f"{c}_{k}" for k in range(1, lags + 1) for c in (a, b)]
    return stats.normal_equations(rows, b, [*past, a], [by]), 2 * lags + 2


def var_orders(df: DataFrame, a: str, b: str, most: int = 12, by: str = "symbol", order: str = "date") -> DataFrame:
    """AIC, BIC, HQIC and FPE of vector autoregressions of 0 to ``most`` lags on common rows."""
    sums, k = _var_sums(df, a, b, most, by, order)

    def finish(row, g):
        n, last = int(row["n"]), [k - 1, k]
        for p in range(most + 1):
            use = list(range(2 * p + 1))
            found = fit(g, use)
            if not found or n <= 2 * p + 1:
                continue
            cross = g[np.ix_(use, last)]
            cov = (g[np.ix_(last, last)] - cross.T @ found[2] @ cross) / n
            det, free = float(np.linalg.det(cov)), 4 * p + 2
            if det > 0 and n > 3:
                ld = math.log(det)
                yield {"lag": p, "aic": ld + 2 * free / n, "bic": ld + math.log(n) * free / n, "hqic": ld + 2 * math.log(math.log(n)) * free / n, "fpe": ((n + 2 * p + 1) / (n - 2 * p - 1)) ** 2 * det}

    return solved(sums, k, [by], finish, "lag int, aic double, bic double, hqic double, fpe double")


def var_stability(df: DataFrame, a: str, b: str, lags: int = 3, by: str = "symbol", order: str = "date") -> DataFrame:
    """Moduli of the companion matrix's eigenvalues, largest first; scaling the two series does not change them."""
    sums, k = _var_sums(df, a, b, lags, by, order)

    def finish(row, g):
        use = list(range(2 * lags + 1))
        found = fit(g, use)
        if found and row["n"] > len(use):
            coef = (found[2] @ g[np.ix_(use, [k - 1, k])])[1:].T
            companion = np.eye(2 * lags, k=-2)
            companion[:2] = coef
            moduli = sorted(np.abs(np.linalg.eigvals(companion)).tolist(), reverse=True)
            yield {"n": int(row["n"]), "moduli": moduli, "stable": moduli[0] < 1}

    return solved(sums, k, [by], finish, "n long, moduli array<double>, stable boolean")


def johansen(df: DataFrame, a: str, b: str, changes: int = 2, by: str = "symbol", order: str = "date") -> DataFrame:
    """Trace and largest-eigenvalue statistics for no and at most one cointegrating relation of two series, with a constant."""
    first = changes + 1
    wide = lagged(df, [a, b], range(1, first + 1), by, order).where(F.col("pos") > first)
    before = lambda c, k: F.col(f"{c}_{k}") if k else F.col(c)
    change = lambda c, k: (before(c, k) - before(c, k + 1)).alias(f"d{c}_{k}")
    rows = wide.select(by, *[change(c, k) for k in range(changes + 1) for c in (a, b)], *[F.col(f"{c}_{changes}").alias(f"l{c}") for c in (a, b)])
    xs = [f"d{c}_{k}" for k in range(1, changes + 1) for c in (a, b)]
    k = len(xs) + 4
    sums = stats.normal_equations(rows, f"l{b}", [*xs, f"d{a}_0", f"d{b}_0", f"l{a}"], [by])

    def finish(row, g):
        n, use, rest = int(row["n"]), list(range(k - 3)), list(range(k - 3, k + 1))
        found = fit(g, use)
        if not found or n <= k:
            return
        cross = g[np.ix_(use, rest)]
        s = (g[np.ix_(rest, rest)] - cross.T @ found[2] @ cross) / n
        if min(np.linalg.matrix_rank(s[:2, :2]), np.linalg.matrix_rank(s[2:, 2:])) == 2:
            roots = np.linalg.eigvals(np.linalg.solve(s[2:, 2:], s[2:, :2] @ np.linalg.solve(s[:2, :2], s[:2, 2:])))
            gain = -n * np.log1p(-np.clip(np.sort(roots.real)[::-1], 0, 1 - 1e-15))
            yield {"n": n, "trace_0": float(gain.sum()), "trace_1": float(gain[1]), "max_0": float(gain[0]), "cointegrated": bool(gain.sum() > TRACE_95)}

    return solved(sums, k, [by], finish, "n long, trace_0 double, trace_1 double, max_0 double, cointegrated boolean")


def two_stage(df: DataFrame, y: str, x: str, instruments: list[str], controls: list[str] = (), by: str = "symbol") -> DataFrame:
    """Two-stage least squares of ``y`` on ``x``: first-stage F of the instruments, the coefficient with its robust error, and plain OLS.

    The second aggregate sums squared residuals times the fitted regressors' products.
    """
    zs = [*controls, *instruments]
    rows = df.where(" and ".join(f"{c} is not null" for c in [y, x, *zs]))
    k, m = len(zs) + 1, len(controls) + 1

    def finish(row, g):
        # order: constant, controls, instruments, x, y
        n, first, plain = int(row["n"]), fit(g[:-1, :-1], list(range(k))), fit(g, [*range(m), k])
        small = fit(g[:-1, :-1], list(range(m)))
        if not first or not plain or first[1] <= 0 or n <= k:
            return
        use = [*range(m), k]
        cross = g[np.ix_(range(k), use)]
        bread = cross.T @ first[2] @ cross
        if np.linalg.matrix_rank(bread) == len(use):
            inverse = np.linalg.inv(bread)
            coef = inverse @ cross.T @ first[2] @ g[:k, -1]
            f = (small[1] - first[1]) / len(instruments) / (first[1] / (n - k))
            yield {"n": n, "f": f, "coef_ols": float(plain[0][-1]), "_b": coef.tolist(), "_a": inverse.ravel().tolist(), "_p": (first[2] @ cross).ravel().tolist()}

    first = solved(stats.normal_equations(rows, y, [*zs, x], [by]), k + 1, [by], finish, "n long, f double, coef_ols double, _b array<double>, _a array<double>, _p array<double>")
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in zs]]
    joined = rows.join(first, by)
    size = m + 1
    own = [*z[:m], F.col(x).cast("double")]
    e = F.col(y) - sum((F.get("_b", i) * own[i] for i in range(size)), F.lit(0.0))
    fitted = [sum((z[j] * F.get("_p", j * size + i) for j in range(k)), F.lit(0.0)) for i in range(size)]
    # the score of x: its row of the inverse on the fitted regressors, times the residual
    score = sum((F.get("_a", m * size + i) * fitted[i] for i in range(size)), F.lit(0.0)) * e
    out = joined.groupBy(by).agg(F.first("n").alias("n"), F.first("f").alias("f"), F.first("coef_ols").alias("coef_ols"), F.first(F.get("_b", m)).alias("coef"), F.sqrt(F.sum(score * score)).alias("se"))
    return out.withColumn("strong", F.col("f") > 10)


def natural_spline(df: DataFrame, x: str, size: int, by: str = "symbol") -> tuple[DataFrame, list[str]]:
    """A natural cubic spline basis of ``size`` - 1 columns beside the constant; inner knots at even quantiles of the distinct values."""
    inner = [i / (size - 1) for i in range(1, size - 1)]
    values = df.where(F.col(x).isNotNull()).select(by, x).distinct()
    knots = values.groupBy(by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.percentile(x, F.array(*map(F.lit, inner))).alias("_q"))
    unit = lambda v: F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    at = [F.lit(0.0), *[unit(F.get("_q", i)) for i in range(len(inner))], F.lit(1.0)]
    s = unit(F.col(x))
    cube = lambda v: F.pow(F.greatest(v, F.lit(0.0)), F.lit(3))
    d = [F.try_divide(cube(s - t) - cube(s - 1), 1 - t) for t in at[:-1]]
    names = [f"{x}_spline_{i}" for i in range(size - 1)]
    columns = [s, *[d[i] - d[-1] for i in range(size - 2)]]
    return df.join(knots, by).withColumns(dict(zip(names, columns))).drop("_lo", "_hi", "_q"), names


def _spells(df: DataFrame, value: str, label: str, by: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(numbered rows with running sum and count of the value, blocks of one label with first and last row)."""
    series = Window.partitionBy(by).orderBy(order)
    before = F.lag(label).over(series)
    rows = df.select(by, order, F.col(value).cast("double").alias("v"), F.col(label).alias("label"), F.row_number().over(series).alias("pos"), F.when(before.eqNullSafe(F.col(label)) & before.isNotNull(), 0).otherwise(1).alias("_c"))
    rows = rows.withColumn("block", F.sum("_c").over(series)).withColumns({"run": F.coalesce(F.sum("v").over(series), F.lit(0.0)), "seen": F.count("v").over(series)})
    return rows, rows.groupBy(by, "block").agg(F.count(F.lit(1)).alias("rows"), F.first("label").alias("label"), F.sum("v").alias("s"), F.count("v").alias("c"))


def block_shuffled_gap(df: DataFrame, value: str, n: int, in_place: bool, draw, label: str = "regime", by: str = "symbol", order: str = "date") -> DataFrame:
    """Extreme over neutral means in each of ``n`` shuffles of whole regime spells.

    ``in_place`` gives each spell the label of another and leaves its days; otherwise spells are laid end to end in a new order with
    their own lengths.  ``draw(block, rep)`` orders the spells.  Rows are not copied per replicate: a spell brings its sums, or
    takes them from running sums at its new ends.
    """
    rows, blocks = _spells(df, value, label, by, order)
    many = blocks.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("h", draw(F.col("block"), F.col("rep")))
    deck = Window.partitionBy(by, "rep").orderBy("h", "block")
    if in_place:
        dealt = many.select(by, "rep", F.row_number().over(deck).cast("long").alias("block"), F.col("label").alias("given"))
        parts = many.select(by, "rep", "block", "s", "c").join(dealt, [by, "rep", "block"]).select(by, "rep", "given", "s", "c")
    else:
        end = F.sum("rows").over(deck.rowsBetween(Window.unboundedPreceding, 0))
        laid = many.select(by, "rep", F.col("label").alias("given"), end.alias("end"), (end - F.col("rows")).alias("start"))
        sums = rows.select(by, F.col("pos").cast("long").alias("pos"), "run", "seen")
        laid = laid.join(sums.select(by, F.col("pos").alias("end"), F.col("run").alias("s1"), F.col("seen").alias("c1")), [by, "end"])
        laid = laid.join(sums.select(by, F.col("pos").alias("start"), F.col("run").alias("s0"), F.col("seen").alias("c0")), [by, "start"], "left")
        parts = laid.select(by, "rep", "given", (F.col("s1") - F.coalesce("s0", F.lit(0.0))).alias("s"), (F.col("c1") - F.coalesce("c0", F.lit(0))).alias("c"))
    mean = lambda test: F.try_divide(F.sum(F.when(test, F.col("s"))), F.sum(F.when(test, F.col("c"))))
    extreme = F.col("given").isin("extreme_fear", "extreme_greed")
    return parts.groupBy(by, "rep").agg((mean(extreme) - mean(F.col("given") == "neutral")).alias("gap"))


class _Noise(scans.Scan):
    """x = a + b x + s noise, for many replicates at once: an affine map with one added part a replicate."""

    def __init__(self, by: str, index: str, value: str, order: str, n: int, bundle: int, seed: int, classify: Callable[[np.ndarray], np.ndarray]):
        self.by, self.index, self.value, self.order, self.n, self.bundle, self.seed, self.classify = by, index, value, order, n, bundle, seed, classify

    def _reps(self, rows: pd.DataFrame) -> np.ndarray:
        part = int(rows["_bundle"].iloc[0])
        return np.arange(part * self.bundle, min(self.n, (part + 1) * self.bundle))

    def _made(self, rows: pd.DataFrame, state: list[float] | None) -> np.ndarray:
        """The made-up values of each row and replicate; without a state the first row has its own index."""
        a, b, s = (float(rows[c].iloc[0]) for c in ("_a", "_b", "_s"))
        names = np.array([str(rows[self.by].iloc[0]), str(rows[self.order].iloc[0])], object)
        rng = np.random.default_rng([self.seed, *(int(h) for h in pd.util.hash_array(names)), int(rows["_bundle"].iloc[0])])
        noise = a + s * rng.standard_normal((len(rows), len(self._reps(rows))))
        made = np.empty_like(noise)
        made[0] = float(rows[self.index].iloc[0]) if state is None else b * np.array(state) + noise[0]
        for t in range(1, len(rows)):
            made[t] = b * made[t - 1] + noise[t]
        return made

    def fold(self, rows):
        zero = [0.0] * len(self._reps(rows))
        return [float(rows["_b"].iloc[0]) ** len(rows), self._made(rows, zero)[-1].tolist(), self._made(rows, None)[-1].tolist()]

    def carry(self, state, folded):
        decay, added, alone = folded
        return alone if state is None else [decay * x + y for x, y in zip(state, added)]

    def run(self, rows, state, last):
        kind = self.classify(np.clip(self._made(rows, state), 0, 100))
        v = rows[self.value].to_numpy(np.float64)[:, None]
        there = ~np.isnan(v)
        out = {self.by: rows[self.by].iloc[0], "rep": self._reps(rows)}
        for k, name in ((1, "extreme"), (0, "neutral")):
            own = there & (kind == k)
            out |= {f"{name}_sum": np.where(own, v, 0).sum(axis=0), f"{name}_n": own.sum(axis=0)}
        return pd.DataFrame(out)


def autoregressive_gap(df: DataFrame, index: str, value: str, n: int, classify: Callable[[np.ndarray], np.ndarray], by: str = "symbol", order: str = "date", seed: int = 11, bundle: int = 50, width: scans.Width = None) -> DataFrame:
    """Extreme over neutral means under ``n`` made-up index series a key, AR(1) with the fitted coefficients, clipped to 0..100.

    ``classify`` gives 1 for extreme, 0 for neutral and -1 for other values.  Replicates go out in bundles, a series once a bundle, cut
    into segments; noise depends on the seed, the key, the segment's first day and the bundle alone, so a task that runs again draws the same.
    """
    series = Window.partitionBy(by).orderBy(order)
    pairs = df.where(F.col(index).isNotNull()).select(by, F.col(index).alias("_y"), F.lag(index).over(series).alias("_x")).where("_x is not null")
    line = pairs.groupBy(by).agg(F.regr_intercept("_y", "_x").alias("_a"), F.regr_slope("_y", "_x").alias("_b"), F.sqrt(F.var_pop("_y") - F.regr_r2("_y", "_x") * F.var_pop("_y")).alias("_s"))
    bundles = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // bundle))).alias("_bundle")
    rows = df.where(F.col(index).isNotNull()).select(by, order, index, value, bundles).join(line, by)
    schema = f"{by} {df.schema[by].dataType.simpleString()}, rep long, extreme_sum double, extreme_n long, neutral_sum double, neutral_n long"
    parts = scans.segmented(rows, _Noise(by, index, value, order, n, bundle, seed, classify), [by, "_bundle"], order, schema, width)
    mean = lambda k: F.try_divide(F.sum(f"{k}_sum"), F.sum(f"{k}_n"))
    return parts.groupBy(by, "rep").agg((mean("extreme") - mean("neutral")).alias("gap"))
