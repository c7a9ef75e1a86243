"""Sweeps of regression specifications: one Gram matrix over the union of all columns serves every specification.

The first pass adds up, per group, the products of all columns as one array a task (NumPy products, merged by group); each
specification is a submatrix of the sum.  A second pass, for robust errors, adds up the products of every specification's scores, for
HAC with those of the rows before, whose last ones each block of rows brings along.  What is shuffled besides the rows of the second
pass is one array a task, group and pass; what is solved is one small matrix a group and specification.

Rows with a null in any column of any specification are left out of all, so that all have the same rows.  Where columns depend on
each other the solution of least norm is taken and degrees of freedom go by the rank.  Groups with fewer rows than rank + 1 give no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators import windows as W
from marketlens.operators.stats import f_sf

CONST = "const"
RANK_FLOOR = 1e-10


def _complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in cols))


def _add(parts: DataFrame, by: str, width: int) -> DataFrame:
    """Sums of the arrays of a group: every task sends one a group."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[by]].iloc[:1].assign(total=[np.sum(np.stack(pdf["part"].to_list()), axis=0)])

    return parts.groupBy(by).applyInPandas(add, f"`{by}` {parts.schema[by].dataType.simpleString()}, total array<double>")


def _matrix(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(np.float64) for c in cols]])


def gram(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """``by`` and ``total``: the products of the constant and all columns with one another, row by row of the matrix."""
    rows = _complete(df, cols).select(by, *[F.col(c).cast("double").alias(c) for c in cols])
    k = len(cols) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, own in pdf.groupby(by, dropna=False):
                x = _matrix(own, cols)
                held[key] = held.get(key, np.zeros((k, k))) + x.T @ x
        if held:  # of a task without rows pandas would make a column of numbers, not of arrays
            yield pd.DataFrame({by: list(held), "part": [g.ravel() for g in held.values()]})

    return _add(rows.mapInPandas(run, f"`{by}` {df.schema[by].dataType.simpleString()}, part array<double>"), by, k * k)


def _solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(coefficients of least norm, pseudo-inverse, rank) of normal equations, columns brought to one scale first."""
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
    kept = values > RANK_FLOOR * max(values.max(), 1e-300)
    inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T / np.outer(scale, scale)
    return inverse @ b, inverse, int(kept.sum())


def _fits(total: np.ndarray, union: list[str], y: str, specs: dict[str, list[str]]) -> dict[str, dict]:
    cols = [CONST, *union]
    k = len(cols)
    g = np.asarray(total).reshape(k, k)
    n, at_y, out = g[0, 0], cols.index(y), {}
    tss = g[at_y, at_y] - g[0, at_y] ** 2 / n
    for name, xs in specs.items():
        at = [0, *[cols.index(x) for x in xs]]
        coef, inverse, rank = _solve(g[np.ix_(at, at)], g[at, at_y])
        if n > rank:
            rss = max(0.0, g[at_y, at_y] - coef @ g[at, at_y])
            out[name] = {"coef": coef, "inverse": inverse, "rank": rank, "n": int(n), "rss": rss, "tss": tss}
    return out


def union_of(y: str, specs: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys([*[x for xs in specs.values() for x in xs], y]))


def specifications(df: DataFrame, y: str, specs: dict[str, list[str]], by: str = "symbol", nested: dict[str, str] | None = None) -> DataFrame:
    """by, spec, n, rank, r2, adj_r2, f, p, delta_r2 and coefs (a map by column) of each specification.

    ``nested`` names for a specification the one its R2 is compared with; F and p are those of all slopes together."""
    union, nested = union_of(y, specs), nested or {}
    kind = f"`{by}` {df.schema[by].dataType.simpleString()}"

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, total in zip(pdf[by], pdf["total"]):
                fits = _fits(total, union, y, specs)
                r2 = {s: 1 - f["rss"] / f["tss"] if f["tss"] > 0 else math.nan for s, f in fits.items()}
                for s, f in fits.items():
                    q, dof = f["rank"] - 1, f["n"] - f["rank"]
                    stat = (f["tss"] - f["rss"]) / q / (f["rss"] / dof) if q and f["rss"] > 0 else math.nan
                    before = nested.get(s)
                    out.append({by: key, "spec": s, "n": f["n"], "rank": f["rank"], "r2": r2[s], "adj_r2": 1 - (1 - r2[s]) * (f["n"] - 1) / dof, "f": stat, "p": f_sf(stat, q, dof) if stat == stat else math.nan,
                                "delta_r2": r2[s] - r2[before] if before in r2 else math.nan, "coefs": dict(zip([CONST, *specs[s]], f["coef"].tolist()))})
            yield pd.DataFrame(out, columns=[by, "spec", "n", "rank", "r2", "adj_r2", "f", "p", "delta_r2", "coefs"])

    found = gram(df, union, by).mapInPandas(close, f"{kind}, spec string, n long, rank int, r2 double, adj_r2 double, f double, p double, delta_r2 double, coefs map<string,double>")
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("r2", "adj_r2", "f", "p", "delta_r2")})


def block_f(df: DataFrame, y: str, small: list[str], large: list[str], by: str = "symbol") -> DataFrame:
    """The classical joint F of the columns that ``large`` has beside ``small``: by, q, dof, f, p, from the same Gram matrix."""
    specs = {"small": small, "large": large}
    union = union_of(y, specs)

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, total in zip(pdf[by], pdf["total"]):
                fits = _fits(total, union, y, specs)
                if len(fits) == 2:
                    a, b = fits["small"], fits["large"]
                    q, dof = b["rank"] - a["rank"], b["n"] - b["rank"]
                    if q > 0 and b["rss"] > 0:
                        stat = (a["rss"] - b["rss"]) / q / (b["rss"] / dof)
                        out.append((key, q, dof, stat, f_sf(stat, q, dof)))
            yield pd.DataFrame(out, columns=[by, "q", "dof", "f", "p"])

    return gram(df, union, by).mapInPandas(close, f"`{by}` {df.schema[by].dataType.simpleString()}, q int, dof long, f double, p double")


def robust_tests(df: DataFrame, y: str, specs: dict[str, list[str]], blocks: dict[str, list[str]], kind: str = "HAC", lags: int = 10, by: str = "symbol", order: str = "date", block: int = 4096, part: str = "year") -> tuple[DataFrame, DataFrame]:
    """(terms: by, spec, term, coef, se, z, p; joint tests: by, spec, q, wald, f, p) with errors of HC1 or of HAC with Bartlett weights.

    ``blocks`` names the coefficients of a specification whose joint Wald test R b = 0 is made from the sandwich; F is Wald over q.
    """
    union = union_of(y, specs)
    xs = [c for c in union if c != y]
    lags = lags if kind == "HAC" else 0
    sizes = {s: len(cols) + 1 for s, cols in specs.items()}
    at = {s: [0, *[1 + xs.index(c) for c in cols]] for s, cols in specs.items()}
    kind_of = f"`{by}` {df.schema[by].dataType.simpleString()}"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, total in zip(pdf[by], pdf["total"]):
                fits = _fits(total, union, y, specs)
                if len(fits) == len(specs):
                    out.append((key, int(np.asarray(total)[0]), *[np.concatenate([fits[s][c].ravel() for s in specs]) for c in ("coef", "inverse")], [fits[s]["rank"] for s in specs]))
            yield pd.DataFrame(out, columns=[by, "n", "coef", "inverse", "rank"])

    fits = gram(df, union, by).mapInPandas(solve, f"{kind_of}, n long, coef array<double>, inverse array<double>, rank array<int>")
    rows = _complete(df, union).select(by, order, *[F.col(c).cast("double").alias(c) for c in union])
    rows = W.with_halo(W.numbered(rows, by, [order], part), "rn", lags, block)
    homes = rows.where("_own").select(by, "_block").distinct().join(fits.select(by, "coef"), by)
    homes = homes.select(F.col(by).alias("_group"), F.col("_block").alias("_part"), "coef")

    def meat(own: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(fit):
            return pd.DataFrame({by: [], "part": []}, dtype=object)
        own = own.sort_values("rn")
        x, home, parts, i = _matrix(own, xs), own["_own"].to_numpy(bool), [], 0
        target, coefs = own[y].to_numpy(np.float64), np.asarray(fit["coef"].iloc[0])
        for s, k in sizes.items():
            scores = x[:, at[s]] * (target - x[:, at[s]] @ coefs[i : i + k])[:, None]
            i += k
            total = scores[home].T @ scores[home]
            for m in range(1, lags + 1):
                # pairs of a row at home and the one m rows before it, at home or brought along
                now = np.flatnonzero(home[m:]) + m
                cross = scores[now].T @ scores[now - m]
                total = total + (1 - m / (lags + 1)) * (cross + cross.T)
            parts.append(total.ravel())
        return pd.DataFrame({by: [own[by].iloc[0]], "part": [np.concatenate(parts)]})

    meats = rows.groupBy(by, "_block").cogroup(homes.groupBy("_group", "_part")).applyInPandas(meat, f"{kind_of}, part array<double>")
    both = _add(meats, by, sum(k * k for k in sizes.values())).join(fits, by)

    def close(joint: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    i = j = 0
                    for (s, k), rank in zip(sizes.items(), row["rank"]):
                        coef, inverse, m = np.asarray(row["coef"][i : i + k]), np.asarray(row["inverse"][j : j + k * k]).reshape(k, k), np.asarray(row["total"][j : j + k * k]).reshape(k, k)
                        i, j = i + k, j + k * k
                        cov = inverse @ m @ inverse * (row["n"] / (row["n"] - rank) if kind == "HC1" else 1.0)
                        names = [CONST, *specs[s]]
                        if joint and s in blocks:
                            own = [names.index(c) for c in blocks[s]]
                            small, q = cov[np.ix_(own, own)], len(own)
                            if np.linalg.matrix_rank(small) == q:
                                wald = float(coef[own] @ np.linalg.solve(small, coef[own]))
                                out.append((row[by], s, q, wald, wald / q, f_sf(wald / q, q, row["n"] - rank)))
                        if not joint:
                            for t, c, v in zip(names, coef, np.diag(cov)):
                                se = math.sqrt(max(v, 0.0))
                                out.append((row[by], s, t, c, se, c / se if se else None, math.erfc(abs(c / se) / math.sqrt(2)) if se else None))
                yield pd.DataFrame(out, columns=[by, "spec", "q", "wald", "f", "p"] if joint else [by, "spec", "term", "coef", "se", "z", "p"])

        return run

    terms = both.mapInPandas(close(False), f"{kind_of}, spec string, term string, coef double, se double, z double, p double")
    return terms, both.mapInPandas(close(True), f"{kind_of}, spec string, q int, wald double, f double, p double")
