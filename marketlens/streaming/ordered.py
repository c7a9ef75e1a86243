"""Scans over streams in the order of event time, whatever batch a row came in.

Rows wait in state until the watermark has passed them; an event-time timer then takes those that are due, sorted by time, through
the same ``Scan`` that runs over the segments of a stored table: a stretch between two watermarks is one more segment.  Results
therefore equal those of the table, but for rows that came later than ``late``, which the watermark drops, and for rows it has not reached.

State of a key: its waiting rows (as Arrow batches), the scan's state and the time of its last row.  A key without rows for ``idle_s``
starts anew and is forgotten meanwhile.  These operators need the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketlens.operators.scans import Scan

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT = "event_us"  # no leading underscore: the stateful operator renames such columns


def _plain(v: Any) -> Any:
    """A value that JSON holds; NaN and missing ones are None."""
    v = v.item() if isinstance(v, np.generic) else v
    return None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v


class Replay(Scan):
    """What was last seen and how much so far: beside each row the fields of the last flagged row strictly before it, and running sums.

    ``marks`` names for each kind of row its flag column and the fields that travel (numbers, texts, booleans); a mark's fields
    travel together, so a null does not fall back to an older row.  ``sums`` are columns whose totals include the row."""

    start = {"marks": {}, "sums": {}}

    def __init__(self, marks: dict[str, tuple[str, Sequence[str]]], sums: Sequence[str] = ()):
        self.marks, self.sums = marks, list(sums)

    def fold(self, rows):
        last = {}
        for name, (flag, fields) in self.marks.items():
            own = rows[rows[flag].fillna(False).astype(bool)]
            if len(own):
                last[name] = {f: _plain(own[f].iloc[-1]) for f in fields}
        return {"marks": last, "sums": {c: float(rows[c].fillna(0).sum()) for c in self.sums}}

    def carry(self, state, folded):
        return {"marks": {**state["marks"], **folded["marks"]}, "sums": {c: state["sums"].get(c, 0.0) + folded["sums"][c] for c in self.sums}}

    def run(self, rows, state, last):
        rows, new = rows.reset_index(drop=True), {}
        for name, (flag, fields) in self.marks.items():
            on = rows[flag].fillna(False).to_numpy(bool)
            upto = np.maximum.accumulate(np.where(on, np.arange(1, len(rows) + 1), 0))
            before = np.append(0, upto[:-1])
            held = state["marks"].get(name, {})
            for f in fields:
                values = [held.get(f), *map(_plain, rows[f])]
                new[f"{name}_{f}"] = pd.Series([values[i] for i in before], dtype=object)
        for c in self.sums:
            new[f"{c}_total"] = rows[c].fillna(0).cumsum() + state["sums"].get(c, 0.0)
        return rows.assign(**new)

    def schema(self, df: DataFrame) -> str:
        kind = {f.name: f.dataType.simpleString() for f in df.schema}
        added = [f"`{name}_{f}` {kind[f]}" for name, (_, fields) in self.marks.items() for f in fields] + [f"`{c}_total` double" for c in self.sums]
        return ", ".join([*(f"`{n}` {k}" for n, k in kind.items()), *added])


class _Ordered(StatefulProcessor):
    """Event time is kept as microseconds alone, as pandas does not keep the zone of timestamps."""

    def __init__(self, scan: Scan, order: list[str], idle_ms: int, ts: str, names: list[str]):
        self.scan, self.order, self.idle_ms, self.ts, self.names = scan, order, idle_ms, ts, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "batch binary")
        self.kept = handle.getValueState("kept", "state string, at long")

    def _pack(self, rows: pd.DataFrame) -> tuple[bytes]:
        import pyarrow as pa

        table = pa.Table.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return (sink.getvalue().to_pybytes(),)

    def _wake(self, at: int, watermark_ms: int) -> None:
        self.handle.registerTimer(max(-(-at // 1000), watermark_ms + 1))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows:
            self.waiting.appendValue(self._pack(pdf.drop(columns=self.ts)))
            least = int(pdf[AT].min()) if least is None else min(least, int(pdf[AT].min()))
        if least is not None:
            self._wake(least, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        watermark = timerValues.getCurrentWatermarkInMs()
        parts = [pa.ipc.open_stream(batch).read_pandas() for (batch,) in self.waiting.get()]
        state, at = self.kept.get() if self.kept.exists() else (json.dumps(self.scan.start), None)
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({AT: np.array([], np.int64)})
        due = rows[AT] <= watermark * 1000
        now, rest = rows[due].sort_values([AT, *self.order], kind="stable") if parts else rows, rows[~due]
        self.waiting.clear()
        if len(rest):
            self.waiting.appendValue(self._pack(rest))
            self._wake(int(rest[AT].min()), watermark)
        if not len(now):
            if at is not None and at + self.idle_ms * 1000 < watermark * 1000:
                self.kept.clear()
            return
        # silence for longer than that starts anew, wherever batches end
        times = now[AT].to_numpy()
        cuts = np.flatnonzero(np.diff(times, prepend=times[0] if at is None else at) > self.idle_ms * 1000)
        held, done = json.loads(state), []
        for i, j in zip([0, *cuts], [*cuts, len(now)]):
            held = self.scan.start if i in cuts else held
            if j > i:
                part = now.iloc[i:j]
                done.append(self.scan.run(part, held, False)[self.names])
                held = self.scan.carry(held, json.loads(json.dumps(self.scan.fold(part))))
        self.kept.update((json.dumps(held), int(times[-1])))
        if not len(rest):
            self.handle.registerTimer(max(int(times[-1]) // 1000 + self.idle_ms + 1, watermark + 1))
        yield from done

    def close(self) -> None:
        pass


def streamed(df: DataFrame, scan: Scan, key: str, schema: str, ts: str = "ts", order: Sequence[str] = (), late: str = "1 hour", idle_s: int = 86_400) -> DataFrame:
    """Runs ``scan`` over each key's rows by (``ts``, ``order``); ``schema`` is that of its result, with ``ts`` in its place."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = T.StructType.fromDDL(schema)
    held = T.StructType([T.StructField(AT, T.LongType()) if f.name == ts else f for f in out])
    rows = df.withWatermark(ts, late).withColumn(AT, F.unix_micros(ts))
    found = rows.groupBy(key).transformWithStateInPandas(_Ordered(scan, list(order), idle_s * 1000, ts, held.names), held, "Append", "EventTime")
    return found.select(*[F.timestamp_micros(AT).alias(ts) if f.name == ts else F.col(f.name) for f in out])


# ---- alignment of books with sentiment

# What stands for sentiment that was never seen, when decay starts and what it falls back to.
NO_SENTIMENT = {"sentiment": 0.0, "epistemic": 0.1, "aleatoric": 0.2, "regime": "neutral"}
DECAY_AFTER_S, DECAY, NEUTRAL_BELOW, MOST_AGE_S = 60, 0.99, 0.1, 300


def decayed(df: DataFrame, ts: str = "ts", seen: str = "s_") -> DataFrame:
    """Sentiment, its uncertainties and regime as they stand at ``ts``, from the last ones seen (columns with the prefix ``seen``, ``at`` in microseconds).

    Over a minute old, sentiment falls toward neutral by 1 % for each minute of its age, and its regime is neutral once it is below 0.1.
    """
    age = (F.unix_micros(ts) - F.col(f"{seen}at")) / 1e6
    old = F.coalesce(age > DECAY_AFTER_S, F.lit(False))
    value = F.coalesce(F.when(old, F.col(f"{seen}sentiment") * F.pow(F.lit(DECAY), age / 60)).otherwise(F.col(f"{seen}sentiment")), F.lit(NO_SENTIMENT["sentiment"]))
    other = {c: F.coalesce(F.col(f"{seen}{c}"), F.lit(NO_SENTIMENT[c])) for c in ("epistemic", "aleatoric")}
    regime = F.when(old & (F.abs(value) < NEUTRAL_BELOW), "neutral").otherwise(F.coalesce(F.col(f"{seen}regime"), F.lit(NO_SENTIMENT["regime"])))
    late = {"sentiment_age_ms": F.coalesce(age * 1000, F.lit(MOST_AGE_S * 1000.0)), "stale": F.coalesce(age > MOST_AGE_S, F.lit(True))}
    return df.withColumns({"sentiment": value, **other, "regime": regime, **late}).drop(*[f"{seen}{c}" for c in ("at", *NO_SENTIMENT)])


BOOK = ("mid_price", "best_bid", "best_ask", "spread_bps", "imbalance")


def aligned(updates: DataFrame, key: str = "symbol", late: str = "1 hour", idle_s: int = 86_400) -> DataFrame:
    """Each book with the sentiment last seen before it, decayed: rows of ``kind`` 'book' and 'sentiment' in one stream, ``seq`` ordering equal times."""
    mark = Replay({"s": ("is_s", ["at", *NO_SENTIMENT])})
    rows = updates.where("kind in ('book', 'sentiment')").select(key, "ts", "seq", "kind", *BOOK, *NO_SENTIMENT, (F.col("kind") == "sentiment").alias("is_s"), F.unix_micros("ts").alias("at"))
    found = streamed(rows, mark, key, mark.schema(rows), order=["seq"], late=late, idle_s=idle_s).where("kind = 'book'")
    return decayed(found.select(key, "ts", "seq", *BOOK, *[f"s_{c}" for c in ("at", *NO_SENTIMENT)]))


# ---- quotes

VELOCITY = 0.1


def requoted(df: DataFrame, score: str = "score", book: str = "book_", before: str = "sentiment_", **quote: float) -> DataFrame:
    """Quotes where one is due: at a book, and at a score over 0.1 away from the one before; none without a mid price.

    ``df`` has kind, the row's own bid, ask and score, inventory (total so far), and the last book and score before the row.
    """
    from marketlens.streaming.streams import quotes

    own = lambda kind, now, held: F.when(F.col("kind") == kind, F.col(now)).otherwise(F.col(held))
    velocity = F.when(F.col("kind") == "sentiment", F.col(score) - F.coalesce(F.col(f"{before}{score}"), F.lit(0.0)))
    df = df.withColumns({"velocity": velocity, "bid": own("book", "bid", f"{book}bid"), "ask": own("book", "ask", f"{book}ask"), "sentiment": F.coalesce(own("sentiment", score, f"{before}{score}"), F.lit(0.0))})
    due = (F.col("kind") == "book") | ((F.col("kind") == "sentiment") & (F.abs("velocity") > VELOCITY))
    return quotes(df.where(due & (F.col("bid") + F.col("ask") != 0)), **quote)


def quote_stream(updates: DataFrame, key: str = "symbol", late: str = "1 hour", idle_s: int = 86_400, **quote: float) -> DataFrame:
    """Quotes from one stream of books (bid, ask), scores and fills (delta of inventory), in event order across batches."""
    replay = Replay({"book": ("is_book", ["bid", "ask"]), "sentiment": ("is_score", ["score"])}, ["delta"])
    rows = updates.select(key, "ts", "seq", "kind", "bid", "ask", "score", F.when(F.col("kind") == "fill", F.col("delta")).alias("delta"), (F.col("kind") == "book").alias("is_book"), (F.col("kind") == "sentiment").alias("is_score"))
    found = streamed(rows, replay, key, replay.schema(rows), order=["seq"], late=late, idle_s=idle_s)
    return requoted(found.withColumn("inventory", F.col("delta_total")), **quote)


def columns_of_quotes(key: str = "symbol") -> list[str | Column]:
    return [key, "ts", "seq", "bid_price", "ask_price", "ref_price", "inv_skew", "sent_skew"]
