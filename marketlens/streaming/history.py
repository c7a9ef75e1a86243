"""History tables that a replayed batch leaves as they were, and counts of what flows through the streams of a session."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def write_batch(batch: DataFrame, number: int, path: str, key: str = "symbol", ts: str = "ts") -> None:
    """One micro-batch as Parquet under its own number, by date, each file by key and newest row first; a second run replaces the first."""
    dated = batch.withColumn("date", F.to_date(ts))
    laid = dated.repartitionByRange("date", key).sortWithinPartitions("date", key, F.col(ts).desc())
    laid.write.mode("overwrite").partitionBy("date").parquet(f"{path.rstrip('/')}/batch={number}")


def history_sink(df: DataFrame, path: str, checkpoint: str, key: str = "symbol", ts: str = "ts", step: Callable[[DataFrame, int], None] | None = None):
    """Starts a stream into a history table; ``step`` is called with each batch and its number once the batch is written."""

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, path, key, ts)
        if step is not None:
            step(batch, number)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, path: str, schema, since: str | None = None) -> DataFrame:
    """The table, from a date on if one is given; whole files of other dates are not read."""
    df = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch int, date date").parquet(path)
    df = df if since is None else df.where(F.col("date") >= F.lit(since).cast("date"))
    return df.drop("batch", "date")


def watched(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """Rows as they are, with counts of all and of the bad ones for a ``Counters`` listener."""
    return df.observe(name, F.count(F.lit(1)).alias("messages"), F.count(F.when(bad, 1)).alias("errors"))


class Counters(StreamingQueryListener):
    """Adds up the counts of ``watched`` streams by name; ``every`` messages of a name it calls ``report(name, messages, errors)``."""

    def __init__(self, every: int = 0, report: Callable[[str, int, int], None] | None = None):
        self.every, self.report = every, report
        self.totals: dict[str, dict[str, int]] = defaultdict(lambda: {"messages": 0, "errors": 0})
        self.ended: set[str] = set()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for name, row in (event.progress.observedMetrics or {}).items():
                seen = row.asDict()
                if "messages" in seen:
                    own = self.totals[name]
                    before = own["messages"]
                    own["messages"] += seen["messages"]
                    own["errors"] += seen["errors"]
                    if self.every and self.report and own["messages"] // self.every > before // self.every:
                        self.report(name, own["messages"], own["errors"])

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
