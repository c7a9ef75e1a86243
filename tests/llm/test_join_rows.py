import random

import pytest

from marketlens.llm import jaccard


def family(rng, n, words=60):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def brute(rows):
    sets = [frozenset(jaccard.shingles(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both * 100 >= 75 * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return label, sets


@pytest.mark.parametrize("split", [10**6, 8])
def test_large_blocks_and_split_shingles(spark, monkeypatch, split):
    """Families over many chunks, with shingles so frequent that several buckets share them."""
    rng = random.Random(5)
    texts = family(rng, 70) + family(rng, 50) + family(rng, 3) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BUNDLE_BYTES", 4000)
    share = 1.0
    real_frequent, real_blocks = jaccard.frequent_shingles, jaccard._blocks
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda docs: real_frequent(docs, share))
    monkeypatch.setattr(jaccard, "_blocks", lambda docs, frequent, buckets: real_blocks(docs, frequent, buckets, split))
    label, _ = brute(rows)
    least = {}
    for (i, _), k in zip(rows, label):
        least[k] = min(least.get(k, i), i)
    got = {r.doc_id: r.component_id for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: least[k] for (i, _), k in zip(rows, label)}


def test_keep_one_judges_rows_not_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    near = a.replace("a29", "zz")
    docs = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (9, near, "x"), (9, c, "z"), (9, c, "z"), (None, b, "n"), (None, None, "n"), (7, "", "e"), (7, " \t", "e"), (None, "lone words here", "n"), (None, "lone words here", "n")]
    df = spark.createDataFrame(docs, "doc_id long, text string, hash string")
    kept = sorted((tuple(r) for r in jaccard.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, a, "x"), (5, b, "y"), (9, c, "z"), (None, None, "n"), (7, "", "e"), (7, " \t", "e"), (None, "lone words here", "n")], key=str)
    assert jaccard.keep_one(df.limit(0)).columns == df.columns and jaccard.keep_one(df.limit(0)).count() == 0
    assert jaccard.components(df.limit(0)).count() == 0
