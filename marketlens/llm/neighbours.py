"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner products become distances by one more coordinate that brings every vector to the greatest norm.  A bounded sample is
halved again and again along the line between two means, at the median, so that its leaves are balanced; their means are the
centroids.  A neighbour graph over the centroids, searched best-first in memory, finds the lists to store a vector in: each
list whose centroid is nearly as close as its closest (boundary vectors in several).  The same graph finds a query's lists: every one whose
distance is within a ratio of its closest, however many these are.  The ratio is measured: it is the one at which queries
drawn from the sample find ``RECALL`` of their nearest in the sample; the nearest in the whole table are closer still.
The closest lists come first; the others return only what is no worse than the last of the ``k`` found there.
Lists that lie side by side in the tree of halves travel together: a query goes once to each bundle with the numbers of the lists
it reads there, is compared with those alone, and returns at most ``k`` rows.  Bundles and their queries are split into parts of bounded size.
Vectors without any structure (independent random directions in many dimensions) leave little to prune: there the ratio reads most lists.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null
ids.  Repeated rows count once; of one id's different vectors the least in order counts.  Equal scores go by the smaller id.
The sample that places the centroids and the ratio has about ``SAMPLE`` vectors; every vector is stored.  Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import materialize

SAMPLE = 50_000
LIST_SIZE = 256
SAMPLE_PER_LIST = 12
COPIES = 4
STORE_RATIO = 1.005
RECALL = 0.998
RATIO_QUERIES = 256
LEAST_LISTS = 12
BUNDLE = 16
PART = 8192
QUERY_PART = 1024
DEGREE = 16
BEAM = 16
SLACK = 1.03


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v as doubles, or as floats if it holds these) of the rows that take part."""
    v = F.col(vector_col)
    v = v if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of the leaves of repeated median splits, neighbours in the tree side by side."""
    rng, out, todo = np.random.default_rng(seed), [], [(np.arange(len(x)), lists)]
    while todo:
        own, k = todo.pop()
        if k <= 1 or len(own) < 2:
            out.append(x[own].mean(axis=0))
            continue
        a, b = x[own[rng.integers(len(own))]], x[own[rng.integers(len(own))]]
        for _ in range(6):
            side = ((x[own] - (a + b) / 2) @ (b - a)) > 0
            if side.all() or not side.any():
                break
            a, b = x[own[~side]].mean(axis=0), x[own[side]].mean(axis=0)
        order = own[np.argsort(x[own] @ (b - a), kind="stable")]
        left = k // 2
        cut = len(own) * left // k
        todo += [(order[:cut], left), (order[cut:], k - left)]
    _, first = np.unique(np.array(out), axis=0, return_index=True)
    return np.array(out)[np.sort(first)]


class CentroidGraph:
    """Each centroid linked with its nearest and a few far ones; best-first search from fixed entries."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, seed: int = 7):
        self.c = centroids
        self.norm = (centroids**2).sum(axis=1)
        n, rng = len(centroids), np.random.default_rng(seed)
        near = []
        for i in range(0, n, 1024):
            d = self.norm - 2 * centroids[i : i + 1024] @ centroids.T
            near.append(np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1])
        near = np.vstack(near)
        self.links = [set(row.tolist()) for row in near]
        for i, row in enumerate(near):
            for j in row.tolist():
                self.links[j].add(i)
        for i in range(n):
            self.links[i] = np.array(sorted(self.links[i] | {i, int(rng.integers(n)), int(rng.integers(n))}))
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of about the ``width`` nearest, nearest first."""
        size = float(x @ x)
        seen = np.zeros(len(self.c), bool)
        ahead: list[tuple[float, int]] = []
        best: list[tuple[float, int]] = []
        fresh = self.entries
        while True:
            seen[fresh] = True
            for d, i in zip((self.norm[fresh] - 2 * self.c[fresh] @ x).tolist(), fresh.tolist()):
                if len(best) < width or d < -best[0][0]:
                    heappush(ahead, (d, i))
                    heappush(best, (-d, i))
                    if len(best) > width:
                        heappop(best)
            if not ahead or len(best) >= width and ahead[0][0] > -best[0][0]:
                break
            links = self.links[heappop(ahead)[1]]
            fresh = links[~seen[links]]
        found = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in found]), np.sqrt(np.maximum(np.array([d for d, _ in found]) + size, 0))

    def within(self, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) up to ``ratio`` times the nearest one's distance, ``least`` at least, nearest first.

        Best-first from the entries, ``BEAM`` nodes a step: links of nodes a little beyond the ratio are still followed, those
        of farther ones are not, so what is read of the graph shrinks with the ratio."""
        n, size = len(self.c), float(x @ x)
        d = np.full(n, np.inf)
        waiting = np.zeros(n, bool)
        fresh = self.entries
        while True:
            d[fresh] = np.maximum(self.norm[fresh] - 2 * self.c[fresh] @ x + size, 0)
            waiting[fresh] = True
            met = np.isfinite(d)
            reach = (ratio * SLACK) ** 2 * d.min() + 1e-12
            if met.sum() > 2 * least:
                reach = max(reach, np.partition(d, 2 * least - 1)[2 * least - 1])
            else:
                reach = np.inf
            ahead = np.flatnonzero(waiting & (d <= reach))
            if not len(ahead):
                break
            ahead = ahead[np.argsort(d[ahead], kind="stable")[:BEAM]]
            waiting[ahead] = False
            near = np.zeros(n, bool)
            near[np.concatenate([self.links[i] for i in ahead])] = True
            fresh = np.flatnonzero(near & ~met)
        order = np.argsort(d, kind="stable")
        inside = np.sqrt(d[order]) <= ratio * np.sqrt(d[order[0]]) + 1e-12
        inside[:least] = True
        order = order[inside & np.isfinite(d[order])]
        return order, np.sqrt(d[order])


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1), 0))


def read_ratio(points: np.ndarray, centroids: np.ndarray, k: int, seed: int = 7) -> float:
    """The ratio of distances up to which lists are read, so that ``RECALL`` of the sample's nearest are found.

    ``points`` are lifted; equal ones count once, as copies are found at any ratio.
    """
    points = np.unique(points, axis=0)
    drawn = np.random.default_rng(seed).permutation(len(points))[:RATIO_QUERIES]
    need, k = [np.ones(1)], min(k, len(points) - 1)
    for i in drawn.tolist() if k else []:
        x = np.append(points[i, :-1], 0)
        score = points @ x
        score[i] = -np.inf
        near = np.argpartition(score, -k)[-k:]
        d = distances(x[None] / max(float(np.sqrt(x @ x)), 1e-300), centroids)[0]
        theirs = distances(points[near], centroids)
        at = np.argsort(theirs, axis=1, kind="stable")[:, :COPIES]
        held = np.take_along_axis(theirs, at, axis=1) <= theirs.min(axis=1)[:, None] * STORE_RATIO + 1e-12
        need.append(np.where(held, d[at], np.inf).min(axis=1) / max(float(d.min()), 1e-300))
    return float(np.quantile(np.concatenate(need), RECALL, method="higher"))


def bundled(lists: list[int]) -> list[dict]:
    """The lists of one query by bundle."""
    out: dict[int, list[int]] = {}
    for i in lists:
        out.setdefault(i // BUNDLE, []).append(i)
    return [{"bundle": b, "lists": own} for b, own in out.items()]


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; ``queries`` is a condition on ``id``."""
    data = materialize(usable(vectors, id_col, vector_col), "vectors")
    spark = data.sparkSession
    by_length = data.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if by_length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    data = data.where(F.size("v") == by_length["n"])
    total = by_length["count"]
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    kind = data.schema["v"].dataType.simpleString()
    top2 = data.agg(F.max(norm2)).first()[0]
    drawn = data.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(2**30)) < F.lit(min(1.0, sample / total) * 2**30)).orderBy("id").select("v").collect()

    def lift(v: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(top2 - (v * v).sum(axis=1), 0))
        return np.hstack([v / np.sqrt(top2), rest[:, None] / np.sqrt(top2)])

    lists = max(1, min(total // LIST_SIZE, len(drawn) // SAMPLE_PER_LIST))
    points = lift(np.array([r.v for r in drawn], np.float64).reshape(len(drawn), -1)) if drawn else np.zeros((1, by_length["n"] + 1))
    del drawn
    centroids = balanced_centroids(points, lists)
    ratio = read_ratio(points, centroids, k)
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids))

    def store(batches: Iterator) -> Iterator:
        import pyarrow as pa

        g = graph.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v, out, which = _rows(batch.column(1)), [], []
            for i, x in enumerate(lift(v)):
                at, d = g.search(x, 4 * COPIES)
                at = at[:COPIES][d[:COPIES] <= d[0] * STORE_RATIO + 1e-12]
                out += at.tolist()
                which += [i] * len(at)
            rows = batch.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), rows.column(0), rows.column(1)], ["list", "id", "v"])

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        g = graph.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lift(_rows(batch.column(1)), True)
            x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
            order = [g.within(row, ratio, LEAST_LISTS)[0].tolist() for row in x]
            kind_of = pa.list_(pa.struct([("bundle", pa.int64()), ("lists", pa.list_(pa.int64()))]))
            lists = [pa.array([bundled(o[:LEAST_LISTS]) for o in order], kind_of), pa.array([bundled(o[LEAST_LISTS:]) for o in order], kind_of)]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(0), batch.column(1)], ["closest", "others", "id", "v"])

    reads = "array<struct<bundle: bigint, lists: array<bigint>>>"
    stored = materialize(data.select("id", "v").mapInArrow(store, f"list long, id long, v {kind}").withColumn("bundle", F.expr(f"list div {BUNDLE}")), "postings")
    asked = materialize(data.where(queries).select("id", "v").repartition(spark.sparkContext.defaultParallelism).mapInArrow(ask, f"closest {reads}, others {reads}, id long, v {kind}"), "probes")

    def best(stored_part, asked_part):
        import pyarrow as pa

        rows: tuple[list, list, list] = ([], [], [])
        if stored_part.num_rows and asked_part.num_rows:
            stored_part = stored_part.sort_by("list")
            ids, x = stored_part.column("id").to_numpy(), _rows(stored_part.column("v").combine_chunks())
            lists, starts = np.unique(stored_part.column("list").to_numpy(), return_index=True)
            ends = np.append(starts[1:], len(ids))
            for part in asked_part.combine_chunks().to_batches(256):
                q, own_lists = _rows(part.column("v")), part.column("lists").to_pylist()
                rough = np.full((len(q), len(ids)), -np.inf)
                for number, start, end in zip(lists.tolist(), starts.tolist(), ends.tolist()):
                    readers = np.array([i for i, own in enumerate(own_lists) if number in own], np.int64)
                    if len(readers):
                        rough[readers, start:end] = q[readers] @ x[start:end].T
                for i, (own, floor) in enumerate(zip(part.column("id").to_pylist(), part.column("floor").to_pylist())):
                    score = np.where(ids == own, -np.inf, rough[i])
                    # a vector stands in at most COPIES lists
                    many = k * COPIES
                    least = max(floor, np.partition(score, -many)[-many] if len(score) > many else -np.inf)
                    # near-ties are scored the same way for equal vectors, then ordered by id
                    at = np.flatnonzero((score >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else score > -np.inf) & (score > -np.inf))
                    at = at[np.unique(ids[at], return_index=True)[1]]
                    exact = (x[at] * q[i]).sum(axis=1)
                    at_best = np.lexsort((ids[at], -exact))[:k]
                    rows[0].extend([own] * len(at_best))
                    rows[1].extend(ids[at][at_best].tolist())
                    rows[2].extend(exact[at_best].tolist())
        return pa.table({"query_id": pa.array(rows[0], pa.int64()), "vec_id": pa.array(rows[1], pa.int64()), "score": pa.array(rows[2], pa.float64())})

    def read(asked: DataFrame) -> DataFrame:
        # a row for each bundle, and there are at most sample / SAMPLE_PER_LIST / BUNDLE bundles
        sizes = stored.groupBy("bundle").count().select("bundle", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
        parts = F.broadcast(sizes.join(asked.groupBy("bundle").count().select("bundle", F.ceil(F.col("count") / QUERY_PART).cast("int").alias("q_parts")), "bundle"))
        hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = stored.join(parts, "bundle").select("bundle", hashed("parts").alias("part"), spread("q_parts").alias("q_part"), "list", "id", "v")
        right = asked.join(parts, "bundle").select("bundle", spread("parts").alias("part"), hashed("q_parts").alias("q_part"), "lists", "id", "v", "floor")
        keys = ("bundle", "part", "q_part")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
        return found.where(F.col("rank") <= k)

    lowest = F.lit(float("-inf"))
    first = materialize(ranked(read(asked.select(F.inline("closest"), "id", "v", lowest.alias("floor")))), "closest")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    others = asked.join(floors, "id", "left").select(F.inline("others"), "id", "v", F.coalesce("floor", lowest).alias("floor"))
    found = first.drop("rank").unionByName(read(others))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
