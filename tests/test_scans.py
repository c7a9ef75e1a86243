"""Segmented scans beside one plain loop over the whole series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from marketlens.operators import scans, series

START = dt.date(1994, 1, 1)


def days(n, seed=1):
    """Two series: one over 24 months and one short, with gaps of whole months and nulls."""
    rng, rows = np.random.default_rng(seed), []
    for symbol, count in ((1, n), (2, 5)):
        at = START
        for _ in range(count):
            at += dt.timedelta(days=int(rng.choice([1, 1, 1, 2, 45], p=[0.4, 0.3, 0.2, 0.08, 0.02])))
            x = None if rng.random() < 0.1 else float(rng.normal())
            rows.append((symbol, at, x, float(rng.uniform(50, 150)), str(rng.choice(["extreme_fear", "fear", "neutral", "greed"], p=[0.3, 0.4, 0.2, 0.1])), str(rng.choice(["neutral", "bullish", "bearish", "crisis"], p=[0.3, 0.35, 0.3, 0.05]))))
    return rows


SCHEMA = "symbol long, date date, x double, close double, regime string, candidate string"


@pytest.fixture(scope="module")
def rows():
    return days(500)


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert df.where("symbol = 1").selectExpr("count(distinct date_trunc('month', date)) n").first().n >= 20
    return df


@pytest.mark.parametrize("first", [None, 0.0])
def test_smoothing(frame, rows, first):
    want, state, last = [], None, None
    for s, d, x, *_ in rows:
        state = first if s != last else state
        last = s
        state = state if x is None else x if state is None else 0.25 * x + 0.75 * state
        want.append((s, d, state))
    for width in ("month", "year"):
        got = {(r.symbol, r.date): r.ewma for r in scans.ewma(frame, "x", 0.25, first=first, width=width).collect()}
        assert len(got) == len(want)
        for s, d, v in want:
            assert got[s, d] == (None if v is None else pytest.approx(v, rel=1e-12, abs=1e-12))


@pytest.mark.parametrize("hold", [1, 3, 40])
def test_hysteresis(frame, rows, hold):
    want, state, steps, last = set(), "neutral", 0, None
    for s, d, _, _, _, c in rows:
        state, steps = (state, steps) if s == last else ("neutral", 0)
        last = s
        taken = c if c == "crisis" or steps >= hold else state
        state, steps = taken, steps + 1 if taken == state else 1
        want.add((s, d, state, steps))
    got = scans.hysteresis(frame, "candidate", hold, steps="steps", width="month").select("symbol", "date", "state", "steps").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("gap,width", [(5, 7), (1, 3), (24, 10), (5, 100_000)])
def test_spacing(spark, gap, width):
    rng = np.random.default_rng(gap)
    rows = [(k, int(n)) for k in (1, 2) for n in sorted(rng.choice(400, 150, replace=False))]
    want, last = set(), {}
    for k, n in rows:
        if k not in last or n - last[k] >= gap:
            want.add((k, n))
            last[k] = n
    got = scans.spaced_events(spark.createDataFrame(rows, "symbol long, n long"), gap, width=width).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def plain_trades(rows, hold, cost):
    out = []
    for symbol in sorted({r[0] for r in rows}):
        own, entry = [r for r in rows if r[0] == symbol], None
        for i, (_, d, _, c, regime, _) in enumerate(own):
            if entry is None and regime == "extreme_fear":
                entry = (i, d, c)
            elif entry is not None and (regime not in ("extreme_fear", "fear") or i - entry[0] >= hold or i == len(own) - 1):
                out.append((symbol, entry[1], d, i - entry[0], round(c / entry[2] - 1 - cost, 9)))
                entry = None
    return sorted(out)


@pytest.mark.parametrize("hold", [3, 10, 60])
def test_contrarian_trades(frame, rows, hold):
    got = scans.contrarian_trades(frame, hold, width="month").collect()
    assert sorted((r.symbol, r.entered, r.exited, r.held, round(r.net, 9)) for r in got) == plain_trades(rows, hold, 0.002)


def test_autoregressive_noise_runs_through_segments(spark):
    """Segments chained by their maps give the values of one loop over the same noise."""
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"symbol": 3, "date": [START + dt.timedelta(days=3 * i) for i in range(300)], "x": rng.uniform(0, 100, 300), "v": rng.normal(size=300)})
    kind = lambda v: np.where((v <= 25) | (v > 75), 1, np.where((v > 45) & (v <= 55), 0, -1))
    df = spark.createDataFrame(rows, "symbol long, date date, x double, v double")
    got = {r.rep: r.gap for r in series.autoregressive_gap(df, "x", "v", 7, kind, bundle=4, width="month").collect()}
    y, x = rows["x"].to_numpy()[1:], rows["x"].to_numpy()[:-1]
    b = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
    a = y.mean() - b * x.mean()
    s = np.sqrt(np.mean((y - a - b * x) ** 2))
    for part, reps in ((0, range(4)), (1, range(4, 7))):
        scan, state, made = series._Noise("symbol", "x", "v", "date", 7, 4, 11, kind), None, []
        for _, own in rows.assign(_a=a, _b=b, _s=s, _bundle=part).groupby(rows["date"].map(lambda d: (d.year, d.month))):
            noise = scan._made(own, None if state is None else [0.0] * len(reps))
            for t in range(len(own)):
                eps = noise[t] - (b * noise[t - 1] if t else 0)
                state = eps if state is None else b * np.array(state) + eps
                made.append(state)
        k = kind(np.clip(np.array(made), 0, 100))
        for j, rep in enumerate(reps):
            want = rows["v"].to_numpy()[k[:, j] == 1].mean() - rows["v"].to_numpy()[k[:, j] == 0].mean()
            assert got[rep] == pytest.approx(want, rel=1e-6)


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scans.ewma(df, "x", 0.5).count() == scans.hysteresis(df, "candidate").count() == scans.contrarian_trades(df).count() == 0
    df = spark.createDataFrame([(None, START, 1.0, 1.0, "fear", "bullish"), (None, None, 3.0, 1.0, "fear", "bullish")], SCHEMA)
    assert sorted(r.ewma for r in scans.ewma(df, "x", 0.5).collect()) == [1.0, 2.0]
