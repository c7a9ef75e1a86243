"""The whole pipeline and the decontamination beside plain versions that look at every pair."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marketlens.llm import decontaminate, packing, quality, queries, secrets
from marketlens.llm.common import table

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def aligned(text, items):
    """Items whose best alignment anywhere in the text reaches half of their whole score."""
    words = decontaminate.words_of((text or "").lower())
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = {}
    for item_id, item in items:
        own = np.array([number.get(w, -1) for w in decontaminate.words_of((item or "").lower())], np.int64)
        # fewer known words than half can't reach half of the score
        if len(own) >= decontaminate.NGRAM and len(ids) and (own >= 0).sum() * 2 >= len(own):
            score = decontaminate.smith_waterman(own, ids)[0] / (decontaminate.MATCH * len(own))
            if score >= decontaminate.LEAST_SCORE:
                out[item_id] = score
    return out


@pytest.fixture(scope="module")
def items(spark, sf):
    return [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]


def test_leaks_equal_aligning_everything(spark, sf, items):
    docs = table(spark, sf, "documents")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, table(spark, sf, "benchmark")).collect()}
    want = {(r.doc_id, i): s for r in docs.collect() for i, s in aligned(r.text, items).items()}
    assert want and got == pytest.approx(want)


def test_a_short_item_in_many_documents(spark):
    docs = spark.createDataFrame([(i, f"word{i} alpha beta word{i + 1}") for i in range(300)] + [(900, "alpha gamma beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Alpha beta"), (2, None), (3, " ")], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(i, 1, 1.0) for i in range(300)]
    assert decontaminate.keep_clean(docs, bench).collect()[0].doc_id == 900


def near_groups(rows):
    """Smallest id of each row's group by exact Jaccard over five-word shingles."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        both = defaultdict(int)
        for g in s:
            for j in holders[g]:
                both[j] += 1
        for j, n in both.items():
            if j < i and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def redacted(text, model):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rest = list(text)
    for a, b in spans:
        rest[a:b] = " " * (b - a)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", "".join(rest)):
        run = best = a = 0
        for c in m[0]:
            b = secrets.LETTERS.find(c) + 1
            run = max(0, run + model[a * len(secrets.LETTERS) + b - 1])
            best, a = max(best, run), b
        spans += [m.span()] if best >= secrets.LEAST_RATIO else []
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def test_the_pipeline_equals_a_plain_one(spark, sf, items):
    got = corpus_pipeline.run(spark, sf).collect()
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score_documents(docs, table(spark, sf, "labels")).collect() if r.predicted}
    assert 0 < len(good) < len(rows)
    kept = {i: rows[i] for i in good}
    kept = {i: kept[i] for i, group in near_groups(list(kept.items())).items() if group == i}
    kept = {i: t for i, t in kept.items() if not aligned(t, items)}
    model = secrets.train(secrets.labelled_samples(docs.where(docs["doc_id"].isin(list(kept)))))
    clean = {i: redacted(t or "", model) for i, t in kept.items()}
    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = set()
    for i, text in clean.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want |= {(i, s, len(ids[s : s + packing.WINDOW]), zlib.crc32(ids[s : s + packing.WINDOW].tobytes()), len(ids)) for s in range(0, len(ids), packing.WINDOW)}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) <= packing.WINDOW
