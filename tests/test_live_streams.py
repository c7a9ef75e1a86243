"""Streams in event order, history and counters, each beside its batch twin or a plain loop."""

import datetime as dt
import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import joins
from marketlens.streaming import history, ordered, scoring, streams

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "symbol long, ts timestamp, seq long, kind string, mid_price double, best_bid double, best_ask double, spread_bps double, imbalance double, sentiment double, epistemic double, aleatoric double, regime string, bid double, ask double, score double, delta double"


def updates(n=160, seed=4):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        symbol, at = int(rng.integers(1, 4)), START + dt.timedelta(seconds=int(rng.integers(0, 4000)))
        kind = str(rng.choice(["book", "sentiment", "fill"], p=[0.6, 0.3, 0.1]))
        s = float(rng.uniform(-1, 1))
        mid = 0.0 if rng.random() < 0.1 else float(rng.uniform(90, 110))
        book = (mid, mid - 0.1, mid + 0.1, 1.0, 0.0) if kind == "book" else (None,) * 5
        view = (s, None if rng.random() < 0.2 else 0.3, 0.4, "bullish" if s > 0 else "bearish") if kind == "sentiment" else (None,) * 4
        quote = (mid - 0.1 if mid else 0.0, mid + 0.1 if mid else 0.0, None, None) if kind == "book" else (None, None, s, None) if kind == "sentiment" else (None, None, None, float(rng.integers(-2, 3)))
        rows.append((symbol, at, i, kind, *book, *view, *quote))
    return rows


def landed(spark, rows, path, seed=1, parts=4):
    """Rows dealt at random over files, one file a batch, and at last rows of another key that push the watermark past all."""
    deal = np.random.default_rng(seed).integers(0, parts, len(rows))
    files = [[r for r, d in zip(rows, deal) if d == p] for p in range(parts)]
    late = START + dt.timedelta(days=2)
    for i, some in enumerate([*files, [(99, late, 10_000, "book", *rows[0][4:])], [(99, late + dt.timedelta(hours=9), 10_001, "book", *rows[0][4:])]]):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken in the order of their times
    return streams.file_stream(spark, path, spark.read.parquet(path).schema)


def rounded(df, cols, key="symbol"):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.where(F.col(key) != 99).select(*cols).collect())


def test_aligned_stream_equals_as_of_join(spark, tmp_path):
    rows = updates()
    stream = landed(spark, rows, str(tmp_path / "in"))
    got = streams.run_to_table(ordered.aligned(stream, late="2 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    df = spark.createDataFrame(rows, SCHEMA)
    views = df.where("kind = 'sentiment'").select("symbol", "ts", "seq", F.unix_micros("ts").alias("at"), *ordered.NO_SENTIMENT)
    books = df.where("kind = 'book'").select("symbol", "ts", "seq", *ordered.BOOK)
    # equal times go by seq in the stream; in the join the view comes first, so times are told apart
    want = ordered.decayed(joins.asof_join(books, views, "symbol", "ts", ["at", *ordered.NO_SENTIMENT], "seq", "s_"))
    cols = ["symbol", "seq", "mid_price", "sentiment", "epistemic", "aleatoric", "regime", "sentiment_age_ms", "stale"]
    assert rounded(got, cols) == rounded(want, cols) and got.where("symbol <> 99").count() == books.count()
    assert any(r[6] == "neutral" and r[3] for r in rounded(got, cols)) and any(not r[-1] for r in rounded(got, cols))


def test_quote_stream_equals_a_loop(spark, tmp_path):
    rows = updates(200, 9)
    stream = landed(spark, rows, str(tmp_path / "in"), 2)
    got = streams.run_to_table(ordered.quote_stream(stream, late="2 hours").select(*ordered.columns_of_quotes()), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = []
    for symbol in (1, 2, 3):
        bid = ask = 0.0
        score, inventory = 0.0, 0.0
        for r in sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[1], r[2])):
            due = False
            if r[3] == "book":
                bid, ask, due = r[13], r[14], True
            elif r[3] == "sentiment":
                due, score = abs(r[15] - score) > 0.1, r[15]
            else:
                inventory += r[16]
            mid = (bid + ask) / 2
            if due and mid:
                centre, half = mid - 0.1 * inventory + score, max((ask - bid) / 2, mid * 5 / 10_000)
                want.append((symbol, r[2], centre - half, centre + half, centre))
    found = sorted((r.symbol, r.seq, r.bid_price, r.ask_price, r.ref_price) for r in got.where("symbol <> 99").collect())
    assert [f[:2] for f in found] == [w[:2] for w in sorted(want)]
    assert np.allclose([f[2:] for f in found], [w[2:] for w in sorted(want)], atol=0.0051)
    # the batch form
    df = spark.createDataFrame(rows, SCHEMA)
    held = joins.replay(df, "symbol", "ts", "seq", {"book": (F.col("kind") == "book", ["bid", "ask"]), "sentiment": (F.col("kind") == "sentiment", ["score"])}, {"delta": F.col("delta")}, "hour")
    batch = ordered.requoted(held.withColumn("inventory", F.col("delta_total")))
    assert rounded(batch, ordered.columns_of_quotes()) == rounded(got, ordered.columns_of_quotes())


def test_idle_keys_are_forgotten(spark, tmp_path):
    rows = [(1, START, 0, "sentiment", *[None] * 5, 0.9, 0.1, 0.1, "bullish", None, None, 0.9, None), (1, START + dt.timedelta(hours=40), 1, "book", 100.0, 99.0, 101.0, 1.0, 0.0, *[None] * 4, 99.0, 101.0, None, None)]
    for i, (at, some) in enumerate([(0, rows[:1]), (20, []), (30, []), (40, rows[1:]), (60, []), (80, [])]):
        tick = (99, START + dt.timedelta(hours=at), 100 + i, "book", *rows[1][4:])
        spark.createDataFrame([*some, tick], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    got = streams.run_to_table(ordered.aligned(stream, late="1 hour", idle_s=3600), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [tuple(r) for r in got.where("symbol = 1").select("seq", "sentiment", "stale").collect()] == [(1, 0.0, True)]


def test_scored_stream_equals_batch(spark, tmp_path):
    def Model():
        """Stands for a network: draws of class probabilities from a hash of the text alone."""

        def score(texts):
            draws = [np.array(list(hashlib.sha256(t.encode()).digest()[:12]), float).reshape(4, 3) + 1 for t in texts]
            return [(d / d.sum(axis=1, keepdims=True)).tolist() for d in draws]

        return score

    rows = [(i % 3, START + dt.timedelta(minutes=int(np.random.default_rng(i).integers(0, 300))), i, None if i == 5 else f"text {i}") for i in range(60)]
    schema = "source long, ts timestamp, seq long, text string"
    df = spark.createDataFrame(rows, schema)
    cols = ["source", "seq", "sentiment", "epistemic", "aleatoric", "uncertainty", "sentiment_ewma", "uncertainty_ewma"]
    want = rounded(scoring.scored_by_source(df, Model), cols, "source")
    assert all(rounded(scoring.scored_by_source(df, Model, n), cols, "source") == want for n in (1, 7))
    state = {}
    for s, _, seq, text in sorted(rows, key=lambda r: (r[1], r[2])):
        p = np.array(Model()([text or ""])[0])
        mean = p.mean(axis=0)
        score, total = mean[2] - mean[0], p.std(axis=0).mean() - (mean * np.log(mean)).sum()
        state[s] = (score, total) if s not in state else (0.3 * score + 0.7 * state[s][0], 0.3 * total + 0.7 * state[s][1])
        row = next(w for w in want if w[1] == seq)
        assert [row[2], *row[5:]] == pytest.approx([score, total, *state[s]], abs=1e-8)
    late = START + dt.timedelta(days=2)
    for some in (rows[::2], rows[1::2], [(99, late, 900, "x")], [(99, late + dt.timedelta(hours=9), 901, "x")]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = streams.file_stream(spark, str(tmp_path / "in"), df.schema)
    got = streams.run_to_table(scoring.scored_by_source(stream, Model, late="6 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert rounded(got, cols, "source") == want


def test_history_holds_each_row_once(spark, tmp_path):
    schema = "symbol long, ts timestamp, x long"
    rows = [(i % 4, START + dt.timedelta(hours=i), i) for i in range(60)]
    for p in range(3):
        spark.createDataFrame(rows[p::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    seen = []
    stream = streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    path = str(tmp_path / "history")
    history.history_sink(stream, path, str(tmp_path / "ck"), step=lambda batch, n: seen.append((n, batch.count()))).awaitTermination()
    assert seen == [(0, 20), (1, 20), (2, 20)]
    # a batch that runs again, as after a crash between write and commit
    history.write_batch(spark.createDataFrame(rows[1::3], schema), 1, path)
    df = history.read_history(spark, path, stream.schema)
    assert sorted(r.x for r in df.collect()) == list(range(60))
    assert sorted(r.x for r in history.read_history(spark, path, stream.schema, "2024-03-02").collect()) == list(range(24, 60))
    one = spark.read.parquet(f"{path}/batch=0/date=2024-03-01").select("symbol", F.unix_micros("ts").alias("t")).collect()
    assert [tuple(r) for r in one] == sorted((tuple(r) for r in one), key=lambda r: (r[0], -r[1]))


def test_counters_add_up_a_stream(spark, tmp_path):
    for p in range(3):
        spark.range(p * 10, p * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    counters = history.Counters(15, lambda *a: told.append(a))
    spark.streams.addListener(counters)
    try:
        stream = history.watched(streams.file_stream(spark, str(tmp_path / "in"), spark.range(1).schema), "ids", F.col("id") % 5 == 0)
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if str(query.id) in counters.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals["ids"] == {"messages": 30, "errors": 6} and told == [("ids", 20, 4), ("ids", 30, 6)]


def test_messages_have_defaults(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(v, at) for v in ('{"symbol": "X", "mid_price": "7.5", "timestamp": "2024-02-03T04:05:06"}', "{}", "no json", None, '{"mid_price": "x"}')], "value string, arrived timestamp")
    assert sorted((r.symbol, r.mid_price, r.best_bid, r.ts.month) for r in streams.book_messages(df).collect()) == [("BTCUSDT", 0.0, 0.0, 1)] * 2 + [("X", 7.5, 0.0, 2)]
    df = spark.createDataFrame([(v, at) for v in ('{"sentiment": 0.5, "text": "' + "t" * 200 + '"}', '{"title": "head", "text": "body", "source": "s"}', '{"text": "body"}')], "value string, arrived timestamp")
    got = sorted((r.sentiment, r.epistemic, r.aleatoric, r.regime, r.source, r.snippet, r.analysed) for r in streams.sentiment_messages(df).collect())
    assert got == [(0.0, 0.1, 0.2, "neutral", "reddit", "body", False), (0.0, 0.1, 0.2, "neutral", "reddit", "head", False), (0.5, 0.1, 0.2, "neutral", "reddit", "t" * 100, True)]
