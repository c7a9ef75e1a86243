"""Document quality: random Fourier features of text statistics, ridge regression, isotonic calibration.

Each whole text gives a short vector of statistics.  Cosines of random projections of the standardised vector approximate a
Gaussian kernel, and stand beside the statistics themselves and a constant; every partition of the training rows sums its normal
equations, the sums are added, and ridge weights come from one small solve.  Out-of-fold scores, binned on a fine grid,
are made monotone by pooling adjacent violators, which turns scores into shares of good documents.

At most about ``TRAIN_ROWS`` labelled rows, drawn by hash, are used to fit, in one pass over their documents alone; a second
pass scores every document.

Nulls: a null text is empty, and empty texts are scored like any other; label rows with a null id or label are
left out; of repeated label rows the smaller label counts, and of one id's different texts that with the least hash.  Equal
texts have equal scores.  Texts of any length are read whole.  Extra columns are ignored; without any label the score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import materialize

TRAIN_ROWS = 50_000
FOURIER = 192
RIDGE = 1e-3
THRESHOLD = 0.7
GRID = 500
MARKS = "|*#%&$!?@<>{}=_~"
STATISTICS = 19 + len(MARKS)
_WORD = re.compile(r"[^\s]+").findall


def statistics(text: str | None) -> list[float]:
    """Numbers that describe the form of a text, none of which grows with its length but the logarithms."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    seen = np.bincount(raw, minlength=256)
    share = lambda lo, hi: float(seen[lo:hi].sum()) / n
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    kinds = set(words)
    same = sum(map(str.__eq__, words, words[1:])) / w
    lines = [x for x in text.split("\n") if x.strip()]
    rows = max(1, len(lines))
    upper, lower, digit = share(65, 91), share(97, 123), share(48, 58)
    out = [
        np.log1p(len(raw)), np.log1p(len(words)), len(kinds) / w, len(kinds) / np.sqrt(w), same, lengths.mean(), lengths.std(), float(lengths.max()) / 50,
        upper, lower, digit, upper / (upper + lower + 1e-9), share(128, 256), seen[32] / n, (seen[44] + seen[46]) / w, seen[46] / w,
        len(set(lines)) / rows, np.log1p(w / rows), share(33, 48) + share(58, 65) + share(91, 97) + share(123, 127),
    ]
    return [float(x) for x in out] + [min(2.0, float(seen[ord(m)]) / w) for m in MARKS]


def _rows_of(texts) -> np.ndarray:
    return np.asarray([statistics(t.as_py()) for t in texts], np.float32).astype(np.float64).reshape(-1, STATISTICS)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, STATISTICS)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


class Model:
    """Standardisation, random Fourier features, ridge weights and the calibration's steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((STATISTICS, FOURIER)) / np.sqrt(STATISTICS)
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(FOURIER + STATISTICS + 1)
        self.at, self.to = np.array([0.0]), np.array([0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FOURIER), z / 6, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.to), 0.0, 1.0)


def pool_adjacent_violators(value: list[float], weight: list[float]) -> list[float]:
    """The nearest non-decreasing sequence by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return [v for v, _, n in blocks for _ in range(int(n))]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, parts: int = 12) -> Model:
    """Fit on labelled rows (doc_id, label) drawn by hash, about ``train_rows`` of them at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").cast("double").alias("y"))
    share = min(1.0, train_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2**30)) < F.lit(share * 2**30))

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            flat = _rows_of(batch.column(3)).astype(np.float32).ravel()
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, STATISTICS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], ["doc_id", "hash", "y", "x"])

    # the drawn labels are a bounded table of two numbers a row, so they may be broadcast
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "hash", "y", "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(describe, "doc_id long, hash long, y double, x array<float>")
    once = rows.groupBy("doc_id", "y").agg(F.min_by("x", "hash").alias("x"))
    train = once.select((fold_of(F.col("doc_id")) % 3).cast("long").alias("fold"), "x", "y").repartition(parts)
    train = materialize(train, "quality-train")

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(2 * STATISTICS + 1)
        for batch in batches:
            x = _matrix(batch.column(1))
            total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    total = sum((np.frombuffer(r.s) for r in train.mapInArrow(sums, "s binary").collect()), np.zeros(2 * STATISTICS + 1))
    n = total[-1]
    if not n:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    mean = total[:STATISTICS] / n
    model = Model(mean, np.sqrt(np.maximum(total[STATISTICS:-1] / n - mean**2, 1e-8)))
    width = len(model.weights)

    def normal_equations(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gram = np.zeros((3, width, width + 1))
        for batch in batches:
            fold, z, y = batch.column(0).to_numpy(), model.lift(_matrix(batch.column(1))), batch.column(2).to_numpy()
            for k in range(3):
                own = z[fold == k]
                gram[k] += own.T @ np.hstack([own, y[fold == k][:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int64()), pa.array([g.tobytes() for g in gram], pa.binary())], ["fold", "g"])

    # one matrix of a fixed size for each of the few training partitions and each fold
    gram = np.zeros((3, width, width + 1))
    for row in train.mapInArrow(normal_equations, "fold long, g binary").toLocalIterator():
        gram[row.fold] += np.frombuffer(row.g).reshape(width, width + 1)
    solve = lambda g: np.linalg.solve(g[:, :-1] + (RIDGE * n + 1e-6) * np.eye(width), g[:, -1])
    whole = gram.sum(axis=0)
    apart = [solve(whole - g) for g in gram]
    model.weights = solve(whole)

    def bins(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fold, z, y = batch.column(0).to_numpy(), model.lift(_matrix(batch.column(1))), batch.column(2).to_numpy()
            raw = np.choose(fold, [z @ a for a in apart])
            bin_ = np.clip(np.floor((raw + 1) * GRID), 0, 3 * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(y)], ["bin", "y"])

    seen = train.mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    level = pool_adjacent_violators([r.y for r in seen], [r.n for r in seen])
    model.at = np.array([(r.bin + 0.5) / GRID - 1 for r in seen])
    model.to = np.array(level)
    return model


def _fitted(docs: DataFrame, labels: DataFrame, held_out: int) -> Model:
    """Labels (doc_id, quality) of the held-out remainder are never read by the fit."""
    return fit(docs, labels.where(fold_of(F.col("doc_id")) != held_out).select("doc_id", F.col("quality").alias("label")))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = _fitted(docs, labels, held_out)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s = model.score(_rows_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, decided as the rows stream by, so no text is shuffled."""
    model = _fitted(docs, labels, held_out)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(model.score(_rows_of(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
