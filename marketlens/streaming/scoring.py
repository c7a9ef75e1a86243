"""Scoring of texts by a pluggable model inside batches or streams, reduced to scores with uncertainty and smoothed by source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import expressions as E
from marketlens.operators.scans import Scan, Smoothing, segmented
from marketlens.streaming.ordered import streamed

CLASSES = 3
SMOOTH = 0.3


def sampled(texts: DataFrame, model: Callable[[], Callable[[list[str]], Any]], batch_rows: int = 32, column: str = "text") -> DataFrame:
    """Adds ``samples``, for each text an array of sampled class probabilities (bearish, neutral, bullish).

    ``model`` makes the scorer, once a task; the scorer gets at most ``batch_rows`` texts and returns samples by text.  A null text is empty.
    Results must not depend on which texts come together.
    """
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema], "samples array<array<double>>"])

    def run(batches: Iterator) -> Iterator:
        score = model()
        for pdf in batches:
            rows = pdf[column].fillna("").tolist()
            found = [[[float(p) for p in draw] for draw in draws] for i in range(0, len(rows), batch_rows) for draws in score(rows[i : i + batch_rows])]
            yield pdf.assign(samples=found)

    return texts.mapInPandas(run, schema)


def reduced(samples: Column) -> dict[str, Column]:
    """Score (last class less first), mean spread over the samples, entropy of the mean, and both uncertainties together."""
    of = lambda k: F.transform(samples, lambda s: F.get(s, k))
    part = [of(k) for k in range(CLASSES)]
    mean = F.array(*[E.mean_of(p) for p in part])
    spread = sum((E.pop_std(p) for p in part), F.lit(0.0)) / CLASSES
    return {"sentiment": F.get(mean, CLASSES - 1) - F.get(mean, 0), "epistemic": spread, "aleatoric": E.entropy(mean), "uncertainty": spread + E.entropy(mean)}


class _Both(Scan):
    """Scores and uncertainty smoothed side by side."""

    def __init__(self, alpha: float):
        self.parts = [Smoothing("sentiment", alpha, "sentiment_ewma", None), Smoothing("uncertainty", alpha, "uncertainty_ewma", None)]
        self.start = [p.start for p in self.parts]

    def fold(self, rows):
        return [p.fold(rows) for p in self.parts]

    def carry(self, state, folded):
        return [p.carry(s, f) for p, s, f in zip(self.parts, state, folded)]

    def run(self, rows, state, last):
        for p, s in zip(self.parts, state):
            rows = p.run(rows, s, last)
        return rows


def scored_by_source(texts: DataFrame, model: Callable[[], Callable[[list[str]], Any]], batch_rows: int = 32, alpha: float = SMOOTH, source: str = "source", ts: str = "ts", seq: str = "seq", late: str = "1 hour") -> DataFrame:
    """source, ts, seq, sentiment, epistemic, aleatoric, uncertainty and the two exponential means of a source up to each text.

    A stream goes by event time across batches, a table in segments; both give the same rows."""
    scores = reduced(F.col("samples"))
    rows = sampled(texts.select(source, ts, seq, "text"), model, batch_rows).select(source, ts, seq, *[c.alias(n) for n, c in scores.items()])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{n}` {k}" for n, k in kind.items()), "sentiment_ewma double", "uncertainty_ewma double"])
    if rows.isStreaming:
        return streamed(rows, _Both(alpha), source, schema, ts, [seq], late)
    return segmented(rows, _Both(alpha), source, ts, schema, "day")
