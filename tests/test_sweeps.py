"""Specification sweeps, robust joint tests, replicate vectors, permutations by sampled sizes and tapes in blocks, beside NumPy or plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.operators import resample, specs
from marketlens.operators import windows as W
from marketlens.plans import sweeps

START = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    parts = []
    for symbol, n in ((1, 240), (2, 90)):
        x = rng.normal(size=(n, 3))
        regime = rng.integers(0, 3, n)
        y = 1 + x @ [2, -1, 0.5] + regime + rng.normal(size=n) * (1 + np.abs(x[:, 0]))
        parts.append(pd.DataFrame({"symbol": symbol, "date": [START + dt.timedelta(days=5 * i) for i in range(n)], "y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d1": (regime == 1).astype(float), "d2": (regime == 2).astype(float), "twin": 2 * x[:, 0] + 1}))
    out = pd.concat(parts, ignore_index=True)
    out.loc[3, "b"] = np.nan
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data).repartition(5)


SPECS = {"one": ["d1", "d2"], "two": ["d1", "d2", "a"], "all": ["d1", "d2", "a", "b", "c"], "twins": ["a", "twin", "b"]}


def fitted(own, xs):
    x = np.column_stack([np.ones(len(own)), own[xs]])
    y = own["y"].to_numpy()
    b = np.linalg.pinv(x) @ y
    return x, y, b, y - x @ b, np.linalg.matrix_rank(x)


def test_every_specification_against_numpy(frame, data):
    got = {(r.symbol, r.spec): r for r in specs.specifications(frame, "y", SPECS, nested={"two": "one"}).collect()}
    assert len(got) == 8
    for symbol, own in data.dropna().groupby("symbol"):
        r2s = {}
        for s, xs in SPECS.items():
            x, y, b, e, rank = fitted(own, xs)
            row = got[symbol, s]
            r2s[s] = 1 - e @ e / ((y - y.mean()) ** 2).sum()
            f = (r2s[s] / (rank - 1)) / ((1 - r2s[s]) / (len(y) - rank))
            assert (row.n, row.rank) == (len(y), rank)
            assert [row.r2, row.f, row.adj_r2] == pytest.approx([r2s[s], f, 1 - (1 - r2s[s]) * (len(y) - 1) / (len(y) - rank)], rel=1e-8)
            if s != "twins":
                assert [row.coefs[t] for t in ["const", *xs]] == pytest.approx(b.tolist(), rel=1e-7)
        assert got[symbol, "two"].delta_r2 == pytest.approx(r2s["two"] - r2s["one"]) and got[symbol, "all"].delta_r2 is None


@pytest.mark.parametrize("kind,block", [("HAC", 16), ("HAC", 4096), ("HC1", 16)])
def test_robust_joint_tests_against_numpy(frame, data, kind, block):
    lags = 4
    some = {k: SPECS[k] for k in ("one", "all")}
    terms, joint = specs.robust_tests(frame, "y", some, {"all": ["d1", "d2"], "one": ["d2"]}, kind, lags, block=block)
    se = {(r.symbol, r.spec, r.term): (r.coef, r.se) for r in terms.collect()}
    wald = {(r.symbol, r.spec): r for r in joint.collect()}
    for symbol, own in data.dropna().groupby("symbol"):
        for s, xs in some.items():
            x, y, b, e, rank = fitted(own, xs)
            u = x * e[:, None]
            m = u.T @ u
            if kind == "HAC":
                m = m + sum((1 - k / (lags + 1)) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, lags + 1))
            inv = np.linalg.inv(x.T @ x)
            cov = inv @ m @ inv * (len(y) / (len(y) - rank) if kind == "HC1" else 1)
            assert [v for t in ["const", *xs] for v in se[symbol, s, t]] == pytest.approx([v for pair in zip(b, np.sqrt(np.diag(cov))) for v in pair], rel=1e-7)
            at = [1 + xs.index(c) for c in (["d1", "d2"] if s == "all" else ["d2"])]
            want = b[at] @ np.linalg.solve(cov[np.ix_(at, at)], b[at])
            assert (wald[symbol, s].q, wald[symbol, s].wald) == (len(at), pytest.approx(want, rel=1e-7))
    assert len(wald) == 4


def test_joint_f_of_a_block(frame, data):
    for r in specs.block_f(frame, "y", ["a"], ["a", "d1", "d2"]).collect():
        own = data[data["symbol"] == r.symbol]
        e0, e1 = fitted(own, ["a"])[3], fitted(own, ["a", "d1", "d2"])[3]
        assert r.f == pytest.approx((e0 @ e0 - e1 @ e1) / 2 / (e1 @ e1 / (len(own) - 4))) and (r.q, r.dof) == (2, len(own) - 4)


def test_the_seven_specifications_on_the_given_table(spark, sf):
    df = sweeps.prepared(spark, sf)
    own = df.select("symbol", "cs", *specs.union_of("cs", sweeps.SPECS)[:-1]).toPandas().dropna()
    got = {(r.symbol, r.spec): r for r in sweeps.reg04_specifications(spark, sf).collect()}
    for symbol, x in own.rename(columns={"cs": "y"}).groupby("symbol"):
        for s, xs in sweeps.SPECS.items():
            _, y, _, e, rank = fitted(x, xs)
            assert ((symbol, s) in got) == (len(y) > rank)
            if (symbol, s) in got:
                r = got[symbol, s]
                assert (r.n, r["rank"]) == (len(y), rank) and r.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum(), abs=2e-6)
    assert {"M1", "M4", "M7"} <= {s for _, s in got}


def test_replicates_equal_exploded_rows(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(i % 3) if i % 17 else None, i, None if i % 11 == 0 else float(rng.normal())) for i in range(1, 700)], "k long, n long, v double").repartition(6)
    got = {(r.k, r.rep): (r.s, r.c) for r in resample.replicate_sums(df, "n", {"s": F.col("v"), "c": F.lit(1.0)}, 1500, ["k"]).collect()}
    long = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(1499)))).withColumn("w", resample.poisson_weight(resample.hashed(F.col("n"), F.col("rep").cast("long"))))
    want = {(r.k, r.rep): (r.s, r.c) for r in long.groupBy("k", "rep").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("s"), F.sum("w").alias("c")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert resample.replicate_sums(df.limit(0), "n", {"s": F.col("v")}, 10, ["k"]).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_permutation_is_a_uniform_choice(spark, block):
    rng = np.random.default_rng(5)
    v, chosen = rng.normal(size=150), rng.random(150) < 0.3
    rows = [(1, i, float(x), bool(c)) for i, (x, c) in enumerate(zip(v, chosen), 1)] + [(1, 200, None, True), (2, 1, 1.0, True)]
    df = spark.createDataFrame(rows, "symbol long, n long, v double, c boolean").repartition(4)
    gaps = resample.permuted_gaps(df, "n", "v", F.col("c"), 4000, block=block)
    got = {r.rep: r.gap for r in gaps.where("symbol = 1").collect()}
    again = {r.rep: r.gap for r in resample.permuted_gaps(df.repartition(7), "n", "v", F.col("c"), 4000, block=block).where("symbol = 1").collect()}
    assert sorted(got) == list(range(4000)) and got == pytest.approx(again)
    m, n = int(chosen.sum()), len(v)
    # the law of the mean of m out of n, and what it makes of the gap
    deviation = v.std(ddof=1) * math.sqrt((1 - m / n) / m) * n / (n - m)
    x = np.array(list(got.values()))
    assert abs(x.mean()) < 4 * deviation / math.sqrt(4000) and x.std() == pytest.approx(deviation, rel=0.06)
    assert gaps.where("symbol = 2").first().gap is None


def test_tape_in_blocks_equals_one_window(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), START + dt.timedelta(days=int(d)), i, float(rng.uniform(1, 2)), bool(rng.random() < 0.5), int(rng.integers(1, 9))) for i, (k, d) in enumerate(zip(rng.integers(0, 2, 900), rng.integers(0, 40, 900)))]
    df = spark.createDataFrame(rows, "symbol long, ts date, seq long, p double, buy boolean, size long")
    key = lambda d: {r.seq: (r.mid, r.vwap, r.eff, r.signed) for r in d.collect()}
    want = {}
    for k in (0, 1):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for i in range(len(own)):
            part = own[max(0, i - 49) : i + 1]
            mid = float(np.median([r[3] for r in part])) if len(part) >= 25 else None
            over = None if mid is None else (own[i][3] - mid) / mid * 10_000
            want[own[i][2]] = (mid, sum(r[3] * r[5] for r in part) / sum(r[5] for r in part), None if over is None else 2 * abs(over), None if over is None else (2 if own[i][4] else -2) * over)
    for block in (49, 64, 4096):
        got = key(W.effective_spread(df, "p", "buy", "size", ["ts", "seq"], 50, 25, block=block))
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    plan = W.effective_spread(df, "p", "buy", "size", ["ts", "seq"], 50, 25)._jdf.queryExecution().toString()
    assert "windowspecdefinition(symbol#" in plan and "_block#" in plan
    after = {r.seq: r.last_p for r in W.before_in_order(df, ["p"], ["ts", "seq"]).collect()}
    for k in (0, 1):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        assert [after[r[2]] for r in own] == [None, *[r[3] for r in own[:-1]]]
