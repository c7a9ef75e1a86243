"""Structured Streaming plans; each has a batch twin with the same result under ``availableNow``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Landed Parquet as a stream; ``maxFilesPerTrigger`` bounds a batch and nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def kafka_messages(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """Messages of a topic from the latest offsets on: ``value`` as text and ``arrived``; ``per_trigger`` bounds a batch and drops nothing."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").option("maxOffsetsPerTrigger", per_trigger).load()
    return raw.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


# What stands for fields that a message lacks.
BOOK_DEFAULTS = {"mid_price": 0.0, "best_bid": 0.0, "best_ask": 0.0, "spread_bps": 0.0, "imbalance": 0.0, "bid_volume": 0.0, "ask_volume": 0.0}
SENTIMENT_DEFAULTS = {"sentiment": 0.0, "epistemic": 0.1, "aleatoric": 0.2}
DEFAULT_SYMBOL, DEFAULT_SOURCE, DEFAULT_REGIME, SNIPPET = "BTCUSDT", "reddit", "neutral", 100


def _fields(messages: DataFrame, value: str) -> DataFrame:
    """The message as a map of texts; rows that are no JSON object have none."""
    return messages.withColumn("_m", F.from_json(value, "map<string,string>"))


def book_messages(messages: DataFrame, value: str = "value", arrived: str = "arrived", keep: Sequence[str] = ()) -> DataFrame:
    """JSON book messages as typed rows, each missing or unreadable field by its default; what is no object is left out."""
    m = _fields(messages, value).where("_m is not null")
    at = F.coalesce(F.col("_m")["timestamp"].try_cast("timestamp"), F.col(arrived))
    number = {n: F.coalesce(F.col("_m")[n].try_cast("double"), F.lit(d)) for n, d in BOOK_DEFAULTS.items()}
    return m.select(*keep, at.alias("ts"), F.coalesce(F.col("_m")["symbol"], F.lit(DEFAULT_SYMBOL)).alias("symbol"), *[c.alias(n) for n, c in number.items()])


def sentiment_messages(messages: DataFrame, value: str = "value", arrived: str = "arrived", keep: Sequence[str] = ()) -> DataFrame:
    """JSON sentiment messages, analysed ones as they are and raw posts with neutral defaults, ``analysed`` telling which; texts as snippets.

    A raw post's snippet is its title, or its text where it has none."""
    m = _fields(messages, value).where("_m is not null")
    f = lambda n: F.col("_m")[n]
    done = F.map_contains_key("_m", "sentiment")
    number = lambda n, key: F.when(done, F.coalesce(f(key).try_cast("double"), F.lit(SENTIMENT_DEFAULTS[n]))).otherwise(SENTIMENT_DEFAULTS[n]).alias(n)
    text = lambda n, default: F.when(done, F.coalesce(f(n), F.lit(default))).otherwise(default).alias(n)
    snippet = F.substring(F.coalesce(F.when(done, f("text")).otherwise(F.coalesce(f("title"), f("text"))), F.lit("")), 1, SNIPPET)
    return m.select(
        *keep, F.coalesce(f("timestamp").try_cast("timestamp"), F.col(arrived)).alias("ts"), number("sentiment", "sentiment"), number("epistemic", "epistemic_uncertainty"), number("aleatoric", "aleatoric_uncertainty"),
        text("regime", DEFAULT_REGIME), text("source", DEFAULT_SOURCE), snippet.alias("snippet"), done.alias("analysed"),
    )


def kafka_sink(df: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.compression.type", "gzip").option("kafka.acks", "all").option("kafka.linger.ms", "100").option("checkpointLocation", checkpoint).start()


def minute_rollup(ticks: DataFrame, late: str = "1 hour", width: str = "1 minute", step: str | None = None) -> DataFrame:
    """Averages and counts per key and window."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    base = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    return base.groupBy("symbol", w.alias("w")).agg(F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("start"), "avg_price", "n")


def deduplicated(df: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def composed_signals(signals: DataFrame, hold: int = 3, width: int = 5, alpha: float = 0.1, late: str = "1 hour", idle_s: int = 86_400) -> DataFrame:
    """Mean of the last ``width`` blends, state with hysteresis and an exponential mean of the blend, per symbol across batches.

    ``signals`` has symbol, ts, seq, blend and crisis; rows of a batch are taken by (ts, seq).  A symbol that is silent until the
    watermark is ``idle_s`` past its last row starts anew, which bounds the state by the symbols that are live.
    """
    schema = "symbol long, ts timestamp, seq long, smoothed double, state string, steps long, ewma double"
    kept = "recent array<double>, state string, steps long, ewma double"

    def step(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        recent, now, steps, mean = state.get if state.exists else ([], "neutral", 0, None)
        recent, rows = list(recent), []
        pdf = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        for ts, seq, blend, crisis in zip(pdf["ts"], pdf["seq"], pdf["blend"], pdf["crisis"]):
            recent = [*recent, float(blend)][-width:]
            smooth = sum(recent) / len(recent)
            candidate = "crisis" if crisis else "bullish" if smooth > 0.25 else "bearish" if smooth < -0.25 else "neutral"
            taken = candidate if candidate == "crisis" or steps >= hold else now
            now, steps = taken, steps + 1 if taken == now else 1
            mean = float(blend) if mean is None else alpha * float(blend) + (1 - alpha) * mean
            rows.append((key[0], ts, seq, smooth, now, steps, mean))
        state.update((recent, now, steps, mean))
        state.setTimeoutTimestamp(max(int(pdf["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_s * 1000)
        yield pd.DataFrame(rows, columns=["symbol", "ts", "seq", "smoothed", "state", "steps", "ewma"])

    return signals.withWatermark("ts", late).groupBy("symbol").applyInPandasWithState(step, schema, kept, "append", "EventTimeTimeout")


def quotes(books: DataFrame, inventory_risk: float = 0.1, sensitivity: float = 1.0, least_bps: float = 5.0, digits: int = 2) -> DataFrame:
    """Bid and ask around a reservation price that inventory and sentiment shift; the spread has a floor in basis points."""
    mid, spread = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid")
    inventory, sentiment = -F.col("inventory") * inventory_risk, F.col("sentiment") * sensitivity
    centre, half = mid + inventory + sentiment, F.greatest(spread / 2, mid * least_bps / 10_000)
    return books.withColumns({"bid_price": F.round(centre - half, digits), "ask_price": F.round(centre + half, digits), "ref_price": F.round(centre, digits), "inv_skew": F.round(inventory, 4), "sent_skew": F.round(sentiment, 4)})


def counted(df: DataFrame, name: str, bad):
    """The rows and a count of all and of the bad ones, observed as the data flow by; (df, observation) in a batch."""
    from pyspark.sql import Observation

    counts = (F.count(F.lit(1)).alias("messages"), F.count(F.when(bad, 1)).alias("errors"))
    if df.isStreaming:
        return df.observe(name, *counts), None
    seen = Observation(name)
    return df.observe(seen, *counts), seen


def scored(texts: DataFrame, analyse, batch_rows: int = 32, column: str = "text") -> DataFrame:
    """Adds sentiment, epistemic and aleatoric uncertainty by ``analyse(list of texts) -> list of triples``, in batches of
    ``batch_rows``; a null text is empty.  ``analyse`` is made once a task if it is a class."""
    fields = ("sentiment", "epistemic", "aleatoric")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema], *[f"{f} double" for f in fields]])

    def run(batches: Iterator) -> Iterator:
        model = analyse() if isinstance(analyse, type) else analyse
        for pdf in batches:
            rows = pdf[column].fillna("").tolist()
            found = [triple for i in range(0, len(rows), batch_rows) for triple in model(rows[i : i + batch_rows])]
            yield pdf.assign(**{f: [float(t[k]) for t in found] for k, f in enumerate(fields)})

    return texts.mapInPandas(run, schema)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a finite stream into Parquet and read it back."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
