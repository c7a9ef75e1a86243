"""Full forms: readers, chi-square tail, inverse normal, moment conditions, breakdown without macro data, posts."""

import gzip
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.functions import expressions as E
from marketlens.operators import moments, stats
from marketlens.operators import windows as W
from marketlens.plans import forms
from marketlens.sources import views


def test_chi_square_tail_and_inverse_normal(spark):
    assert [round(stats.chi2_sf(x, k), 4) for x, k in ((3.841, 1), (18.307, 10), (2.0, 2), (0, 3), (150, 100))] == [0.05, 0.05, round(math.exp(-1), 4), 1.0, 0.0009]
    p = [1e-6, 0.001, 0.02425, 0.3, 0.5, 0.7, 0.975, 0.999999]
    z = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(E.normal_quantile(F.col("p")).alias("z")).collect()]
    assert [0.5 * math.erfc(-x / math.sqrt(2)) for x in z] == pytest.approx(p, rel=1e-7)


def test_price_history_snapshots_and_implied_volatility(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([[1700000000000, 1, 3, 0.5, 2], [1700000000000, 1, 3, 0.5, 2], [1700000060000, 2, None, 1, 2]]))
    rows = views.read_ohlc(spark, str(tmp_path / "o.json")).orderBy("ts").collect()
    assert [(r.ts.timestamp(), r.open, r.high, r.close) for r in rows] == [(1700000000, 1, 3, 2), (1700000060, 2, None, 2)]
    (tmp_path / "s1.json").write_text(json.dumps({"id": "x", "market_data": {"current_price": {"usd": 5.5, "eur": 5}, "total_volume": {"usd": 70}}, "community_data": {"reddit_subscribers": 3}}))
    (tmp_path / "s2.json").write_text("{}")
    got = {r.file: r for r in views.read_snapshots(spark, str(tmp_path / "s*.json")).collect()}
    assert (got["s1.json"].price, got["s1.json"].volume_24h, got["s1.json"].readers, got["s1.json"].up_pct) == (5.5, 70, 3, None) and got["s2.json"].price is None
    (tmp_path / "v.json").write_text(json.dumps({"data": [[1700000000000, 50, 60, 40, 90], [1700086400000, 1, 1, 1, 500]]}))
    (tmp_path / "w.json").write_text(json.dumps({"result": {"data": [[1700172800000, 50, 60, 40, 10]]}}))
    rows = views.read_implied_volatility(spark, str(tmp_path / "[vw].json")).orderBy("ts").collect()
    assert [(r.dvol, r.dvol_normalized) for r in rows] == [(90, 0.5), (500, 1), (10, 0)]


def test_market_prices_by_name_side_outcome_and_book(spark, tmp_path):
    lines = [
        {"market_slug": "a", "current_price": "x", "prob": "0.3", "volume_24h": 0, "volume_1_day": 5}, {"market_slug": "b", "side_a": {"trade_price": 0.7}, "side_b": {}}, {"market_slug": "c", "side_a": {"price": 0.7}},
        {"markets": [{"slug": "d", "outcomes": [{"yes_price": -2}], "question": "Why?"}, {"slug": "e", "bids": [[0.4, 1]], "asks": [{"price": "0.6"}]}]}, {"market_slug": "f", "bids": [[0.4, 1]], "asks": []},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.market: (r.price, r.volume, r.question) for r in views.read_markets(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"a": (0.3, 5, "a"), "b": (0.7, 0, "b"), "c": (None, 0, "c"), "d": (0.0, 0, "Why?"), "e": (0.5, 0, "e"), "f": (None, 0, "f")}


def test_files_are_read_by_their_names(spark, tmp_path):
    (tmp_path / "btc").mkdir()
    with gzip.open(tmp_path / "btc" / "OrderBook-1.csv.gz", "wt") as f:
        f.write("timestamp,bid,ask\n1700000000,99,101\n")
    (tmp_path / "btc" / "trades-1.csv").write_text(" Timestamp ,Price,size,SIDE\n1700000001,100,2,Buy\n1700000002123,101,1,SELL\n")
    (tmp_path / "btc" / "notes.txt").write_text("no data")
    rows = views.read_by_name(spark, str(tmp_path), ["BTC", "ETH"]).orderBy("ts").collect()
    assert [(r.symbol, r.kind, r.bid, r.price, r.side) for r in rows] == [("BTC", "book", 99, None, None), ("BTC", "trade", None, 100, "buy"), ("BTC", "trade", None, 101, "sell")]
    assert rows[2].ts.timestamp() == 1700000002.123
    assert views.read_by_name(spark, str(tmp_path), ["ETH"]).count() == 0
    with pytest.raises(ValueError):
        views.read_trades_csv(spark, str(tmp_path / "btc" / "OrderBook-1.csv.gz"))


def test_recent_posts_by_source(spark):
    rows = [(i, "a" if i % 2 else "b", i * 7 % 13, 1700000000 + 3600 * i) for i in range(40)] + [(40, "a", None, 1700000000 + 3600 * 39)]
    df = spark.createDataFrame(rows, "id long, source string, score long, at long").withColumn("created", F.timestamp_seconds("at"))
    for sort, key in (("new", lambda r: (-r[3], r[0])), ("top", lambda r: (r[2] is None, -(r[2] or 0), r[0]))):
        got = {(r.source, r["rank"]): r.id for r in views.recent_posts(df, "id", 5, 24, sort).collect()}
        for s in "ab":
            own = sorted((r for r in rows if r[1] == s and r[3] >= rows[39][3] - 24 * 3600), key=key)[:5]
            assert [got[s, k] for k in range(1, len(own) + 1)] == [r[0] for r in own]
    assert views.recent_posts(df, "id", 5).where("rank > 5").count() == 0
    text = spark.createDataFrame([("t", None), ("t", ""), ("t", "b" * 600)], "t string, b string").select(views.post_text(F.col("t"), F.col("b")).alias("x")).collect()
    assert [r.x for r in text] == ["t", "t", "t " + "b" * 500]


def test_ranks_over_slots(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, None if i % 50 == 0 else float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 2, 400), rng.integers(0, 40, 400)))]
    got = {r.i: (r["rank"], r.of) for r in W.ranked(spark.createDataFrame(rows, "k long, i long, v double"), "k", "v", "i", 8).collect()}
    for k in (0, 1):
        own = sorted((r for r in rows if r[0] == k and r[2] is not None), key=lambda r: (r[2], r[1]))
        assert [got[r[1]] for r in own] == [(n, len(own)) for n in range(1, len(own) + 1)]
    assert len(got) == sum(r[2] is not None for r in rows)


def test_terms_without_macro_data(spark):
    df = spark.createDataFrame([(False, "neutral", 80.0, 1.0, 40.0), (True, "regulatory", None, 0.5, None), (True, "crisis", 80.0, 1.0, 90.0)], "macro boolean, state string, news double, complete double, dvol double")
    u = E.uncertainty_breakdown(F.col("macro"), F.col("state"), news=F.col("news"), completeness=F.col("complete"), implied=F.col("dvol"), samples=F.lit(0.15), entropy=F.lit(1.1))
    rows = df.select(*[c.alias(n) for n, c in u.items()]).collect()
    assert [rows[0][f"{n}_term"] for n in E.WITHOUT_MACRO] == list(E.WITHOUT_MACRO.values()) and rows[0].source == "unavailable"
    assert rows[0].epistemic == pytest.approx(0.35 * 0.5 + 0.25 + 0.4 * 0.5) and rows[0].aleatoric == pytest.approx(0.35 * 0.25 + 0.15 * 0.25 + 0.25 * 0.1 + 0.25)
    assert rows[1].epistemic == pytest.approx(0.35 * 0.3 + 0.25 * 0.5 + 0.2 + 0.15) and rows[1].implied_term == 0.25
    assert rows[2].source == "implied" and rows[2].epistemic == pytest.approx(0.35 + 0.2 + 0.2) and rows[2].aleatoric == pytest.approx(0.35 * 0.5 + 0.15 * 0.2 + 0.25 * 0.1 + 0.25 + 0.3)


def test_moment_conditions_against_numpy(spark, sf):
    d = forms.proxies(spark, sf)
    names = ["a", "b", "c"]
    grid = moments.moment_grid(d, names)
    first = moments.best_weights(grid, moments.quadratic("g"))
    weighting = {r.symbol: np.array(r.weighting).reshape(4, 4) for r in moments.bootstrap_weighting(d, "n", names, first, 60).collect()}
    best = {r.symbol: r for r in first.collect()}
    second = {r.symbol: r for r in moments.best_weights(grid.join(moments.bootstrap_weighting(d, "n", names, first, 60), "symbol"), moments.quadratic("g", F.col("weighting"))).collect()}
    for symbol, own in d.toPandas().groupby("symbol"):
        x, regime = own[names].to_numpy(), own["regime"].to_numpy()

        def g(w, weights=None, scale=None):
            raw = x @ np.array(w)
            lo, hi = scale or (raw.min(), raw.max())
            u, k = (raw - lo) / (hi - lo), np.ones(len(x)) if weights is None else weights
            mean = (k * u).sum() / k.sum()
            of = {n: (k[regime == n] * u[regime == n]).sum() / k[regime == n].sum() if k[regime == n].sum() else mean for n in ("extreme_greed", "extreme_fear", "neutral")}
            std = math.sqrt(max((k * u * u).sum() - k.sum() * mean**2, 0) / (k.sum() - 1))
            return np.array([mean - 0.5, std - 0.2, of["extreme_greed"] - of["neutral"] - 0.1, of["extreme_fear"] - of["neutral"] - 0.05]), (lo, hi)

        at = {w: g(w)[0] for w in moments.simplex()}
        w = min(at, key=lambda w: (round(at[w] @ at[w], 9), w))
        assert tuple(best[symbol].w) == w and best[symbol].g == pytest.approx(at[w].tolist(), abs=1e-9)
        n, scale = own["n"].to_numpy(), g(w)[1]
        h = lambda rep: ((((n * 7919 + rep * 104729 + 12345) % 2147483647) * 48271 % 2147483647) * 48271) % 2147483647 % 10000
        draws = np.array([g(w, np.searchsorted([3679, 7358, 9197, 9810, 9963, 9994], h(rep), side="right").astype(float), scale)[0] for rep in range(60)])
        if symbol in weighting:
            want = np.linalg.inv(np.cov(draws.T))
            assert weighting[symbol] == pytest.approx(want, rel=1e-5)
            assert second[symbol].objective == pytest.approx(min(v @ want @ v for v in at.values()), rel=1e-5)
    assert len(pd.Series(best)) == 4 and weighting


def test_p_values_of_studies(spark):
    """Recomputed from the other columns of each result."""
    sf = "/root/testdata/sf0.01"
    rows = forms.evt01_p_values(spark, sf).collect()
    assert len(rows) > 20 and all(r.p == pytest.approx(2 * stats.t_sf(abs(r.mean / r.se), r.events - 1), abs=2e-3) for r in rows)
    rows = forms.tst15_quintiles_holm(spark, sf).collect()
    for symbol in {r.symbol for r in rows}:
        own = sorted((r for r in rows if r.symbol == symbol), key=lambda r: r.p)
        holm = np.maximum.accumulate([min(1.0, (len(own) - i) * r.p) for i, r in enumerate(own)])
        assert [r.holm for r in own] == pytest.approx(holm.tolist(), abs=1e-5) and all(r.significant == (r.holm < 0.05) for r in own)
    for r in forms.exp27_significance(spark, sf).collect():
        assert r.stars == ("***" if r.p < 0.001 else "**" if r.p < 0.01 else "*" if r.p < 0.05 else "†" if r.p < 0.1 else "")
        # many days, so the t is nearly normal
        assert r.p == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), abs=0.01)
