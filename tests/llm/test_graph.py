"""The neighbour index on clustered vectors: lists found by the graph, their share of the rows, and recall."""

import numpy as np
from pyspark.sql import functions as F

from marketlens.llm import neighbours as N


def clustered(n, centres, dims=32, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 3
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * 0.6


def test_the_graph_finds_the_lists_within_a_ratio():
    rng = np.random.default_rng(1)
    for c in (rng.normal(size=(600, 24)), clustered(600, 12, 24)):
        graph, missed, wanted, followed = N.CentroidGraph(c), 0, 0, 0
        for _ in range(200):
            x = c[rng.integers(len(c))] + rng.normal(size=24) * 0.5
            d = N.distances(x[None], c)[0]
            want = set(np.flatnonzero(d <= 1.15 * d.min()).tolist())
            at, far = graph.within(x, 1.15, 4)
            missed, wanted, followed = missed + len(want - set(at.tolist())), wanted + len(want), followed + len(at)
            assert np.allclose(far, d[at]) and (np.diff(far) >= 0).all() and len(at) >= 4
        assert missed <= 0.05 * wanted and followed < 0.5 * 200 * len(c)


def test_few_vectors_are_compared_where_there_is_structure(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_SIZE", 16)
    x = clustered(6000, 120)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in N.search(rows, F.col("id") % 60 == 0).collect()}
    queries = np.arange(0, 6000, 60)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    want = {(int(q), int(j)) for q, row in zip(queries, score) for j in np.argsort(-row, kind="stable")[:20]}
    assert len(got & want) >= 0.9 * len(want)
    # the share of stored vectors in the lists that a query reads, by the index's own parts
    top = np.sqrt((x * x).sum(axis=1).max())
    lifted = np.hstack([x / top, np.sqrt(np.maximum(1 - (x * x).sum(axis=1) / top**2, 0))[:, None]])
    centroids = N.balanced_centroids(lifted, 6000 // 16)
    graph, ratio = N.CentroidGraph(centroids), N.read_ratio(lifted, centroids, 20)
    size = np.bincount(N.distances(lifted, centroids).argmin(axis=1), minlength=len(centroids))
    asked = np.hstack([x[queries], np.zeros((len(queries), 1))])
    asked /= np.sqrt((asked * asked).sum(axis=1))[:, None]
    assert np.mean([size[graph.within(q, ratio, N.LEAST_LISTS)[0]].sum() for q in asked]) < 0.25 * 6000
