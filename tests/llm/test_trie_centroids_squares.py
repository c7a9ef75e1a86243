import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marketlens.llm import centroids, prefix_trie, queries, squares

TURNS = "conv_id long, turn long, role string, text string, n_convs int, depth string"
DOCS = "doc_id long, text string, length int, piece string"


def brute_trie(rows):
    """The trie by lists of whole prefixes."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            turns[c].append((t is not None, t or 0, digest, role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    trunc = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(trunc(c), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words(p[-1][1]) if p else 0
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS)
    got = [tuple(r) for r in prefix_trie.build(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in rng.choice(np.arange(-45, 300), 160, replace=False).tolist():
        kind = rng.integers(4)
        n = int(rng.integers(0, 14))
        for t in range(n):
            text = f"same {t}" if kind == 0 or (kind == 1 and t < 6) else f"w{rng.integers(2)} x"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    rows += [(400, None, None, None), (400, 1, "", ""), (400, 1, "a", "b c\td"), (400, 1, "a", "b c\td"), (None, 1, "user", "nobody"), (421, 0, "user", " \n")]
    rows += [(801, t, "user", f"long {t}") for t in range(57)] + [(803, t, "user", f"long {t}" if t != 40 else "turn") for t in range(60)]
    rows += [(777, 0, "user", "word " * 30_000), (999, 0, "user", "word " * 30_000)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_copies_long_conversations_and_nothing(spark, monkeypatch):
    assert trie(spark, []) == set()
    rows = [(c, t, "user", f"t{t}") for c in range(0, 2400, 2) for t in range(3)] + [(3000, 0, "user", "other")]
    assert trie(spark, rows) == brute_trie(rows)
    # segments and hot parents at small sizes
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    monkeypatch.setattr(prefix_trie, "MOST_HOT", 1)
    rows = [(c, t, "user", "a" if t < 90 else str(c)) for c in (1, 7, 45, 1003) for t in range(120)]
    assert trie(spark, rows) == brute_trie(rows)


def test_turns_are_numbered_over_partitions(spark):
    rows = spark.range(5000).selectExpr("7L as conv_id", "id as turn", "'r' as role", "cast(id as string) as text").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns = prefix_trie.numbered_turns(rows, stored := [])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = turns.orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 5001)) and stored[-1].select("part").distinct().count() > 1
    assert got[41].g == hashlib.sha256(b"1:r41").digest()


def test_threshold_walk_equals_brute_force():
    rng = np.random.default_rng(2)
    for k, dims, spread in ((40, 64, 60), (7, 1, 5), (300, 3, 40), (1, 4, 9)):
        c = rng.integers(-spread, spread, (k, dims))
        c[k // 2] = c[0]  # equal centroids: the smaller number wins
        x = np.vstack([rng.integers(-2 * spread, 2 * spread, (500, dims)), c, [[centroids.LARGEST] * dims]])
        where, best, computed = centroids.ThresholdLists(c).nearest(x)
        exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (where == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
        if (k, dims) == (300, 3):
            assert computed < 0.35 * exact.size  # the walk stops early


def brute_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else m for j, m in enumerate(c)]
    found = [(i, near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, (d, j) in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in found), key=str)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(90)] + [(5, [0.5] * 64), (5, [0.5] * 64), (None, [-0.25] * 64)]
    rows += [(200, None), (201, [1.0] * 63), (202, [None] + [1.0] * 63), (203, [float("nan")] + [1.0] * 63), (204, [float("inf")] + [1.0] * 63), (205, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")
    assert sorted((tuple(r) for r in centroids.cluster(df).collect()), key=str) == brute_clusters(rows)
    few = rows[:3] + rows[90:92]
    assert sorted((tuple(r) for r in centroids.cluster(df.limit(0).unionByName(spark.createDataFrame([(i, v, 1, 2) for i, v in few], df.schema))).collect()), key=str) == brute_clusters(few)
    assert centroids.cluster(df.limit(0)).count() == 0
    # what a long cannot hold stops at the largest
    assert centroids.cluster(spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64)], "vec_id long, embedding array<double>")).count() == 2


def brute_squares(lengths, window):
    """Every open sequence tried by the full sum of squares; ties to the smallest gap."""
    gaps = []

    def score(g):
        counts = defaultdict(int)
        for x in g:
            counts[x] += x > 0
        return sum(n * n for n in counts.values())

    for size in sorted(lengths, reverse=True):
        fits = sorted({g for g in gaps if g >= size})
        if not fits:
            gaps.append(window - size)
            continue

        def after(g):
            rest = list(gaps)
            rest.remove(g)
            return score([*rest, g - size])

        g = min(fits, key=lambda g: (after(g), g))
        gaps.remove(g)
        gaps.append(g - size)
    return sorted(gaps)


@pytest.mark.parametrize("window,n", [(10, 60), (64, 120), (100, 40)])
def test_squares_choose_the_smallest_sum(window, n):
    lengths = np.random.default_rng(n).integers(1, window + 1, n).tolist()
    where, offset = squares.sum_of_squares(lengths, window)
    filled = defaultdict(int)
    for i in sorted(range(n), key=lambda i: offset[i]):
        assert filled[where[i]] == offset[i]
        filled[where[i]] += lengths[i]
    assert sorted(window - f for f in filled.values()) == brute_squares(lengths, window)
    assert len(filled) <= max(squares.sum_of_squares(lengths, window, False, True)[0]) + 1


def check_packing(rows, got, window=4096):
    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = sorted(((i, x["piece"], x["start"], x["length"], x["crc"]) for i, text in rows for x in cut(t.encode(text or "", add_special_tokens=False).ids + [1], window)), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(bins), sum(r.length for r in got)


def cut(ids, window):
    return [{"piece": k, "start": s, "length": len(ids[s : s + window]), "crc": zlib.crc32(np.array(ids[s : s + window], "<u4").tobytes())} for k, s in enumerate(range(0, len(ids), window))]


def test_packed_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made, tokens = check_packing(rows, queries.op13_squares(spark, sf).collect())
    assert made <= -(-tokens // 4096) + 1
    rows = [(1, None), (1, None), (None, "no id"), (2, ""), (3, "word " * 30_000), (4, "a"), (4, "a")]
    make = lambda rows: squares.pack_documents(spark.createDataFrame([(i, x, 1, "p") for i, x in rows], DOCS), queries.tokenizer_path("word_bpe_49k.json")).collect()
    check_packing(rows, make(rows))
    assert make([]) == []
