"""Registered queries of the live path over stored events: typed messages, aligned books, quotes; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import joins as J
from marketlens.plans.queries import query, r
from marketlens.sources import views as V
from marketlens.streaming import ordered, streams

_SCORE = "(((round(value * 100)::BIGINT * 37) % 201) - 100) / 100.0"


def _score():
    return (F.round(F.col("value") * 100).cast("long") * 37 % 201 - 100) / 100


def _events(spark, sf):
    return V.table(spark, sf, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "symbol": F.col("user_id")})


@query("""WITH s AS (SELECT user_id AS symbol, ts, event_id, SCORE AS sentiment, 0.1 + (event_id % 5) * 0.05 AS epistemic, 0.2 + (event_id % 7) * 0.05 AS aleatoric, CASE WHEN SCORE > 0.2 THEN 'bullish' WHEN SCORE < -0.2 THEN 'bearish' ELSE 'neutral' END AS regime FROM events WHERE event_type = 'view'),
 b AS (SELECT user_id AS symbol, ts, event_id, value AS mid_price FROM events WHERE event_type <> 'view'),
 j AS (SELECT b.symbol, b.event_id, mid_price, s.sentiment, s.epistemic, s.aleatoric, s.regime, (epoch_us(b.ts) - epoch_us(s.ts)) / 1e6 AS age FROM b ASOF LEFT JOIN s ON b.symbol = s.symbol AND b.ts >= s.ts),
 d AS (SELECT *, coalesce(CASE WHEN age > 60 THEN sentiment * pow(0.99, age / 60) ELSE sentiment END, 0) AS x FROM j)
 SELECT symbol, event_id, round(mid_price, 6) AS mid_price, round(x, 6) AS sentiment, round(coalesce(epistemic, 0.1), 6) AS epistemic, round(coalesce(aleatoric, 0.2), 6) AS aleatoric, CASE WHEN age > 60 AND abs(x) < 0.1 THEN 'neutral' ELSE coalesce(regime, 'neutral') END AS regime,
 round(coalesce(age * 1000, 300000), 3) AS sentiment_age_ms, coalesce(age > 300, true) AS stale FROM d""".replace("SCORE", _SCORE))
def join08_aligned(spark, sf):
    """Each event that is no view as a book, with the sentiment of the last view before it, decayed by its age."""
    e = _events(spark, sf)
    regime = F.when(_score() > 0.2, "bullish").when(_score() < -0.2, "bearish").otherwise("neutral")
    views = e.where("event_type = 'view'").select("symbol", "ts", "event_id", F.unix_micros("ts").alias("at"), _score().alias("sentiment"), (0.1 + F.col("event_id") % 5 * 0.05).alias("epistemic"), (0.2 + F.col("event_id") % 7 * 0.05).alias("aleatoric"), regime.alias("regime"))
    books = e.where("event_type <> 'view'").select("symbol", "ts", "event_id", F.col("value").alias("mid_price"))
    found = ordered.decayed(J.asof_join(books, views, "symbol", "ts", ["at", *ordered.NO_SENTIMENT], "event_id", "s_"))
    return found.select("symbol", "event_id", r("mid_price").alias("mid_price"), *[r(c).alias(c) for c in ("sentiment", "epistemic", "aleatoric")], "regime", r("sentiment_age_ms", 3).alias("sentiment_age_ms"), "stale")


@query("""WITH e AS (SELECT user_id AS symbol, ts, event_id, CASE event_type WHEN 'view' THEN 'sentiment' WHEN 'purchase' THEN 'fill' ELSE 'book' END AS kind, CASE WHEN event_type = 'error' THEN 0 ELSE value - 0.01 * (event_id % 4) END AS bid, CASE WHEN event_type = 'error' THEN 0 ELSE value + 0.01 * (event_id % 4) END AS ask, SCORE AS score, (event_id % 5) - 2 AS delta FROM events),
 w AS (SELECT *, coalesce(sum(CASE WHEN kind = 'fill' THEN delta END) OVER (p ROWS UNBOUNDED PRECEDING), 0) AS inventory, last_value(CASE WHEN kind = 'book' THEN bid END IGNORE NULLS) OVER (p ROWS UNBOUNDED PRECEDING) AS b, last_value(CASE WHEN kind = 'book' THEN ask END IGNORE NULLS) OVER (p ROWS UNBOUNDED PRECEDING) AS a,
  last_value(CASE WHEN kind = 'sentiment' THEN score END IGNORE NULLS) OVER (p ROWS UNBOUNDED PRECEDING) AS s, last_value(CASE WHEN kind = 'sentiment' THEN score END IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM e WINDOW p AS (PARTITION BY symbol ORDER BY ts, event_id)),
 q AS (SELECT symbol, event_id, kind, inventory, (a + b) / 2 AS mid, a - b AS spread, coalesce(s, 0) AS s FROM w WHERE (kind = 'book' OR kind = 'sentiment' AND abs(score - coalesce(s0, 0)) > 0.1) AND a + b <> 0)
 SELECT symbol, event_id, kind, round(mid - 0.1 * inventory + s, 6) AS ref_price, round(mid - 0.1 * inventory + s - greatest(spread / 2, mid * 0.0005), 6) AS bid_price, round(-0.1 * inventory, 4) AS inv_skew, round(s, 4) AS sent_skew FROM q""".replace("SCORE", _SCORE))
def str08_quotes(spark, sf):
    """Quotes at books and at jumps of the score, with the inventory of all fills so far: purchases are fills, views are scores, errors are empty books."""
    kind = F.when(F.col("event_type") == "view", "sentiment").when(F.col("event_type") == "purchase", "fill").otherwise("book")
    side = lambda sign: F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value") + sign * 0.01 * (F.col("event_id") % 4))
    e = _events(spark, sf).select("symbol", "ts", F.col("event_id").alias("seq"), kind.alias("kind"), side(-1).alias("bid"), side(1).alias("ask"), _score().alias("score"), (F.col("event_id") % 5 - 2).cast("double").alias("delta"))
    held = J.replay(e, "symbol", "ts", "seq", {"book": (F.col("kind") == "book", ["bid", "ask"]), "sentiment": (F.col("kind") == "sentiment", ["score"])}, {"fills": F.when(F.col("kind") == "fill", F.col("delta"))})
    q = ordered.requoted(held.withColumn("inventory", F.col("fills_total")), digits=6)
    return q.select("symbol", F.col("seq").alias("event_id"), "kind", "ref_price", "bid_price", "inv_skew", "sent_skew")


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'BTCUSDT' ELSE 'S' || user_id END AS symbol, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END, 4) AS mid_price, round(CASE WHEN event_id % 4 = 0 THEN 0 ELSE value - 0.5 END, 4) AS best_bid, epoch_us(ts) AS ts_us FROM events""")
def src13_book_messages(spark, sf):
    """Books sent as JSON with fields that are missing now and then, read back with their defaults."""
    keep = lambda k, c: F.when(F.col("event_id") % k != 0, c)
    sent = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), keep(6, F.concat(F.lit("S"), F.col("user_id").cast("string"))).alias("symbol"), keep(5, F.col("value")).alias("mid_price"), keep(4, (F.col("value") - 0.5).cast("string")).alias("best_bid")))
    books = streams.book_messages(_events(spark, sf).select("event_id", sent.alias("value"), F.lit(None).cast("timestamp").alias("arrived")), keep=["event_id"])
    return books.select("event_id", "symbol", r("mid_price", 4).alias("mid_price"), r("best_bid", 4).alias("best_bid"), F.unix_micros("ts").alias("ts_us"))


@query("""WITH m AS (SELECT conv_id, turn, conv_id % 3 = 0 AS done, role, coalesce(text, '') AS text FROM conversations)
 SELECT conv_id, turn, done AS analysed, round(CASE WHEN done THEN (conv_id % 21 - 10) / 10.0 ELSE 0 END, 6) AS sentiment, round(CASE WHEN done AND turn > 0 THEN turn / 20.0 ELSE 0.1 END, 6) AS epistemic, CASE WHEN done THEN role ELSE 'reddit' END AS source, left(CASE WHEN NOT done AND turn = 0 THEN 'post ' || conv_id ELSE text END, 100) AS snippet FROM m""")
def src14_sentiment_messages(spark, sf):
    """Posts sent as JSON, every third conversation analysed already, the others raw; a raw first post has a title."""
    done = F.col("conv_id") % 3 == 0
    score = F.struct(((F.col("conv_id") % 21 - 10) / 10).alias("sentiment"), F.when(F.col("turn") > 0, F.col("turn") / 20).alias("epistemic_uncertainty"), F.col("role").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    raw = F.struct(F.when(F.col("turn") == 0, F.concat(F.lit("post "), F.col("conv_id").cast("string"))).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", F.when(done, F.to_json(score)).otherwise(F.to_json(raw)).alias("value"), F.timestamp_seconds("turn").alias("arrived"))
    return streams.sentiment_messages(c, keep=["conv_id", "turn"]).select("conv_id", "turn", "analysed", r("sentiment").alias("sentiment"), r("epistemic").alias("epistemic"), "source", "snippet")
