import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.functions import expressions as E
from marketlens.operators import stats
from marketlens.sources import views
from marketlens.streaming import streams


def test_book_and_trade_files(spark, tmp_path):
    with gzip.open(tmp_path / "BTC_2024-03-05.csv.gz", "wt") as f:
        f.write(" Timestamp ,BID,Ask,bid_volume\n1700000000,99,101,3\n1700000000123,100,,\n1700000000123456,100,102,\n")
    rows = views.read_books_csv(spark, str(tmp_path / "BTC_2024-03-05.csv.gz")).orderBy("ts").collect()
    assert [r.ts.timestamp() for r in rows] == [1700000000, 1700000000.123, 1700000000.123456]
    assert rows[0].spread == 2 and rows[0].spread_bps == 200 and rows[0].imbalance == 0.5 and rows[1].spread is None and str(rows[0].file_day) == "2024-03-05"
    with pytest.raises(ValueError):
        views.read_sentiment_csv(spark, str(tmp_path / "BTC_2024-03-05.csv.gz"))
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "1,10.5,2,21,1700000000123456,True\n2,10.6,1,10.6,1700000000123457,false\nbad,line\n3,-1,1,1,1700000000123457,false\n")
    got = [tuple(r) for r in views.read_trade_zips(spark, str(tmp_path / "t.zip")).orderBy("trade_id").select("trade_id", "price", "side").collect()]
    assert got == [(1, 10.5, "sell"), (2, 10.6, "buy")]
    (tmp_path / "s.csv").write_text("timestamp,sentiment\n1700000000,0.5\n1700000001,-0.1\n")
    assert [(r.regime, r.epistemic) for r in views.read_sentiment_csv(spark, str(tmp_path / "s.csv")).orderBy("ts").collect()] == [("bullish", 0.1), ("neutral", 0.1)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps([[1700000000000, "1", "3", "0.5", "2", "10", 1, "5", 7, "1", "1", "0"], [1700000000000, "1", "3", "0.5", "2", "10", 1, "5", 7, "1", "1", "0"]]))
    bar = views.read_candles(spark, str(tmp_path / "k.json"), "BTC").collect()
    assert len(bar) == 1 and (bar[0].high, bar[0].trades) == (3.0, 7)
    (tmp_path / "i.json").write_text(json.dumps({"data": [{"value": "20", "value_classification": "Extreme Fear", "timestamp": "1700006400"}]}))
    assert views.read_index(spark, str(tmp_path / "i.json")).first().fear_greed_value == 20
    good = {"e": "d", "s": "BTC", "E": 1700000000000, "U": 1, "u": 2, "b": [["1.5", "2"]], "a": [["1.6", "0"]]}
    bad = [dict(good, b=[["1.5"]]), dict(good, a=[["-1", "2"]]), {"s": "BTC"}]
    df = spark.createDataFrame([(json.dumps(m),) for m in [good, *bad]] + [("not json",), (None,)], "value string")
    books, rejected = views.parse_depth(df)
    assert [r.bids for r in books.collect()] == [[[1.5, 2.0]]] and rejected.count() == 5
    (tmp_path / "m.json").write_text('{"slug": "a", "last_price": 1.4, "volume_1_week": 70}\n{"slug": "b", "outcomes": [{"price": "0.25"}]}\n{"slug": "c"}\n')
    assert [tuple(r) for r in views.read_markets(spark, str(tmp_path / "m.json")).select("market", "price", "volume").orderBy("market").collect()] == [("a", 1.0, 10.0), ("b", 0.25, 0.0), ("c", None, 0.0)]
    series = spark.createDataFrame([("vix", 1, 20.0), ("vix", 3, None), ("vix", 2, 25.0)], "name string, ts long, value double")
    assert views.macro_snapshot(series, {"vix": 15.0, "rate": 4.5}).first().asDict() == {"vix": 25.0, "rate": 4.5, "completeness": 0.5}
    views.save_csv(series, str(tmp_path / "c"))
    views.save_json(series, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 3
    files = spark.createDataFrame([(f"f{i}",) for i in range(7)], "path string")
    assert [r.path for r in views.every_kth_file(files, 3).orderBy("path").collect()] == ["f0", "f3", "f6"]


def test_composed_stream_keeps_state_across_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, 1_700_000_000 + i, i, float(rng.uniform(-1, 1)), bool(rng.random() < 0.05)) for i in range(60) for s in (1, 2)]
    for part in range(3):
        some = [r for r in rows if r[2] // 20 == part]
        df = spark.createDataFrame(some, "symbol long, at long, seq long, blend double, crisis boolean").select("symbol", F.timestamp_seconds("at").alias("ts"), "seq", "blend", "crisis")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), df.schema)
    got = {(r.symbol, r.seq): (r.smoothed, r.state, r.steps, r.ewma) for r in streams.run_to_table(streams.composed_signals(stream), str(tmp_path / "out"), str(tmp_path / "ck")).collect()}
    for s in (1, 2):
        recent, now, steps, mean = [], "neutral", 0, None
        for _, _, seq, blend, crisis in [r for r in rows if r[0] == s]:
            recent = [*recent, blend][-5:]
            m = sum(recent) / len(recent)
            want = "crisis" if crisis else "bullish" if m > 0.25 else "bearish" if m < -0.25 else "neutral"
            new = want if want == "crisis" or steps >= 3 else now
            steps = steps + 1 if new == now else 1
            now, mean = new, blend if mean is None else 0.1 * blend + 0.9 * mean
            assert got[s, seq] == (pytest.approx(m), now, steps, pytest.approx(mean))


def test_minute_rollup_stream_equals_batch(spark, sf, tmp_path):
    ticks = views.ticks(spark, sf)
    ticks.write.parquet(str(tmp_path / "in"))
    stream = streams.minute_rollup(streams.file_stream(spark, str(tmp_path / "in"), ticks.schema))
    stream.writeStream.outputMode("complete").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    row = lambda r: (r.symbol, r.start, round(r.avg_price, 9), r.n)
    assert sorted(map(row, spark.table("rolled").collect())) == sorted(map(row, streams.minute_rollup(ticks).collect()))


def test_quotes_counters_and_scorer(spark):
    books = spark.createDataFrame([(1, 99.0, 101.0, 2.0, 0.5), (2, 100.0, 100.01, 0.0, 0.0)], "id long, bid double, ask double, inventory double, sentiment double")
    assert [(r.bid_price, r.ask_price, r.inv_skew) for r in streams.quotes(books).orderBy("id").collect()] == [(99.3, 101.3, -0.2), (99.95, 100.06, 0.0)]
    df, seen = streams.counted(books, "books", F.col("sentiment") == 0)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"messages": 2, "errors": 1}
    sizes = streams.scored(spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(70)], "id long, text string"), lambda texts: [(len(t), len(texts), 0) for t in texts], 8)
    rows = sizes.collect()
    assert all(r.sentiment == (0 if r.id == 3 else r.id) and r.epistemic <= 8 for r in rows) and len(rows) == 70


def test_regime_groups_leave_unknown_out(spark):
    left = spark.createDataFrame([(1, "greed"), (2, "unknown"), (3, None), (4, "neutral")], "id long, regime string")
    rows = {r.id: (r.s, r.d) for r in left.select("id", E.strength(F.col("regime")).alias("s"), E.direction(F.col("regime")).alias("d")).collect()}
    assert rows == {1: ("moderate", "bullish"), 2: (None, None), 3: (None, None), 4: ("neutral", "neutral")}


def test_tails_against_tables(spark):
    assert [round(2 * stats.t_sf(t, n), 4) for t, n in ((2.228, 10), (1.96, 1e6), (12.706, 1), (0, 5))] == [0.05, 0.05, 0.05, 1.0]
    assert round(stats.f_sf(4.10, 2, 10), 3) == 0.05 and round(stats.f_sf(2.71, 5, 20), 3) == 0.05
    assert round(stats.power_of_t(0.5, 64, 64), 2) == 0.80
    z = spark.createDataFrame([(1.959964,), (-2.575829,), (0.0,)], "z double").select(stats.normal_p(F.col("z")).alias("p")).collect()
    assert [round(r.p, 5) for r in z] == [0.05, 0.01, 1.0]


def test_robust_errors_against_numpy(spark):
    rng = np.random.default_rng(1)
    n, lags = 80, 3
    x = rng.standard_normal((n, 2))
    y = 1 + x @ [2, -1] + rng.standard_normal(n) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame([(1, i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "symbol long, date long, y double, a double, b double")
    X = np.hstack([np.ones((n, 1)), x])
    inv = np.linalg.inv(X.T @ X)
    e = y - X @ (inv @ X.T @ y)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    s = X * e[:, None]
    hac = s.T @ s + sum((1 - m / (lags + 1)) * (s[m:].T @ s[:-m] + s[:-m].T @ s[m:]) for m in range(1, lags + 1))
    want = {"HC1": inv @ (s.T @ s) @ inv * n / (n - 3), "HC3": inv @ ((s / (1 - h)[:, None]).T @ (s / (1 - h)[:, None])) @ inv, "HAC": inv @ hac @ inv}
    for kind, cov in want.items():
        got = {r.term: r.se for r in stats.robust(df, "y", ["a", "b"], "symbol", kind, lags if kind == "HAC" else 0).collect()}
        assert [got[t] for t in ("const", "a", "b")] == pytest.approx(np.sqrt(np.diag(cov)).tolist())
