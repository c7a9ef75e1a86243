"""Exact k-means over integer vectors; each vector finds its centroid by the threshold algorithm.

Every dimension holds the centroids in the order of their value there.  From a vector's own value each list is walked outward,
one entry of every list a step, nearest first; a centroid met for the first time gets its exact squared distance.  A centroid
not met yet is in every dimension at least as far as the next entry of that list, so the walk ends once the sum of these
squared frontier distances strictly exceeds the best exact distance (strictly, as an equal one could have a smaller number),
or once all centroids were met.

Components become ``floor(scale * x)`` and all arithmetic is on integers, so results do not depend on the order of rows.  A round is
one pass over the stored vectors: each task sums its rows by cluster, and what reaches the driver is a row per cluster and
dimension, ``k * dims`` at most.

Vectors that are null, of another length or hold null or non-finite components take no part.  A null id is an empty text where ids
are hashed, and is returned.  Repeated rows are vectors of their own; of equal hashes the lesser vector comes first.  With fewer
than ``k`` vectors each is a centroid.  Integers stop at ``LARGEST`` so that distances fit a long.  Extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import materialize, release

LARGEST = 2**26
BATCH = 2048


class ThresholdLists:
    """The centroids sorted by value in every dimension."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        k, dims = centroids.shape
        # an entry before and after each list that is further than any value
        self.values = np.full((k + 2, dims), 4 * LARGEST, np.int64)
        self.values[0] = -4 * LARGEST
        self.values[1:-1] = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, ties to the smaller number, and how many distances were computed."""
        k, dims = self.c.shape
        n, dim = len(x), np.arange(dims)
        best = np.full(n, np.iinfo(np.int64).max)
        where = np.zeros(n, np.int64)
        met = np.zeros((n, k), bool)
        left = np.stack([np.searchsorted(self.values[1:-1, d], x[:, d]) for d in range(dims)], axis=1).reshape(n, dims)
        right, live, computed = left + 1, np.arange(n), 0
        while len(live):
            below, above = x - self.values[left, dim], self.values[right, dim] - x
            down = below <= above
            entry = np.where(down, left, right) - 1
            fresh = np.zeros((len(live), k), bool)
            fresh[np.arange(len(live))[:, None], self.order[entry, dim]] = True
            fresh &= ~met
            met |= fresh
            row, number = np.nonzero(fresh)
            gap = x[row] - self.c[number]
            exact = np.full((len(live), k), np.iinfo(np.int64).max)
            exact[row, number] = np.einsum("ij,ij->i", gap, gap)
            computed += len(row)
            own = exact.argmin(axis=1)
            least = exact[np.arange(len(live)), own]
            better = (least < best[live]) | ((least == best[live]) & (own < where[live]))
            best[live[better]], where[live[better]] = least[better], own[better]
            left, right = left - down, right + ~down
            frontier = np.minimum(x - self.values[left, dim], self.values[right, dim] - x)
            on = ~met.all(axis=1)
            # what lies behind the end of a list is as far as can be; floats hold the sum, one part in 2^50 is left as a margin
            on &= (frontier.astype(float) ** 2).sum(axis=1) * (1 - 2**-50 * dims) <= best[live]
            live, x, met, left, right = live[on], x[on], met[on], left[on], right[on]
        return where, best, computed


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array of long) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where((F.size("v") == dims) & fine)
    whole = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x * scale))
    return rows.select("id", F.transform("v", lambda x: F.floor(whole(x)).cast("long")).alias("v"))


def _rows(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def assign(data: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lists = ThresholdLists(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                where, best, _ = lists.nearest(_rows(part.column(1), centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(where, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    return data.mapInArrow(run, "vec_id long, cluster int, distance long")


def sums(data: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, total, n): each task adds up its rows first."""
    k, dims = centroids.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lists = ThresholdLists(centroids)
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = _rows(batch.column(1).slice(at, BATCH), dims)
                where = lists.nearest(x)[0]
                np.add.at(total, where, x)
                n += np.bincount(where, minlength=k)
        full = np.flatnonzero(n)
        columns = [np.repeat(full, dims), np.tile(np.arange(dims), len(full)), total[full].ravel(), np.repeat(n[full], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "dim", "total", "n"])

    return data.mapInArrow(run, "cluster long, dim long, total long, n long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    data = materialize(integer_vectors(vectors, dims, scale, id_col, vector_col), "integer-vectors")
    spark = data.sparkSession
    first = data.orderBy(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for r in sums(data, centroids).collect():  # at most k * dims rows
            moved[r.cluster, r.dim] = r.total // r.n
        centroids = moved
    out = materialize(assign(data, centroids), "assigned")
    release(data)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = {r.cluster: r.d for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    rows = [(i, own[i], sum(own.values()), names[i]) for i in sorted(own)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
