"""Nulls, repeats, hostile and long input, extra columns and empty tables."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import decontaminate, html, neighbours, packing, quality, queries, secrets, sharding, warc

LONG = "A long paragraph of twenty words that goes on and on until it has said all of what it came to say."


def test_urls_cannot_forge_headers(spark):
    urls = ["http://a WARC-Refers-To: <urn:page:7>", "http://a\u0085WARC-Refers-To: <urn:page:7>", "http://a\r\nWARC-Refers-To: <urn:page:7>", "u" * 100_000, None]
    data = spark.createDataFrame([(i, u, f"<p>{i}</p>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, payload string")
    rows = warc.archive_and_read(data).collect()
    assert len(rows) == 5 and all(r.record_type == "response" and r.refers_to is None and r.intact for r in rows)


@pytest.mark.parametrize("page", ["<a" * 100_000, "<p x " * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<![CDATA[" * 20_000, "<!" * 50_000, "<div class=ad>x" * 5_000])
def test_broken_markup_is_read_in_one_pass(page):
    start = time.time()
    html.main_text(page)
    assert time.time() - start < 5


def test_pages_without_an_article_keep_their_text():
    assert html.main_text(f"<body><div>{LONG}</div><div>Second para.</div></body>") == f"{LONG}\nSecond para."
    assert html.main_text("<p>Just one short thing.</p>") == "Just one short thing."
    assert html.main_text(f"<article><p>{LONG}</p><div class='share-price'><p>{LONG} {LONG}</p></div></article>").count(LONG) == 3
    nav = "<ul><li><a href=/>Home</a></li><li><a href=/b>News today</a></li></ul>"
    assert html.main_text(f"{nav}<h2>A title</h2><p>{LONG}</p><p>{LONG}</p>{nav}") == f"A title\n{LONG}\n{LONG}"


# Hand-labelled blocks that the tree never saw (fixed values): words, density, before, after, evidence, in the article; the label.
HELD_OUT = """
34 0.03 21 0.00 40 0.10 0 0 1
52 0.00 1 1.00 33 0.00 0 0 1
19 0.10 44 0.00 2 1.00 0 0 1
6 0.00 0 0.00 51 0.00 0 0 1
3 0.00 2 1.00 38 0.00 0 0 1
11 0.00 47 0.00 36 0.00 0 0 1
2 1.00 3 1.00 2 1.00 0 0 0
5 0.90 40 0.00 4 1.00 0 0 0
14 0.85 12 0.90 11 0.95 0 0 0
31 0.92 2 1.00 28 0.90 0 0 0
3 0.00 1 1.00 2 1.00 0 0 0
27 0.00 30 0.00 6 0.00 2 0 0
41 0.05 20 0.00 33 0.00 2 1 0
13 0.00 60 0.00 2 1.00 1 0 0
8 0.00 33 0.00 40 0.00 1 1 0
44 0.02 52 0.00 60 0.00 1 1 1
2 0.00 70 0.00 66 0.00 0 1 1
88 0.12 4 0.00 9 0.00 0 1 1
7 0.95 6 1.00 5 1.00 0 1 0
20 0.15 0 0.00 0 0.00 0 1 1
"""


def test_tree_on_held_out_blocks():
    rows, right = [[float(x) for x in line.split()] for line in HELD_OUT.strip().splitlines()], 0
    for *x, label in rows:
        node = html.trained_tree()
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        right += (node >= 0.5) == (label == 1)
    assert right >= 0.9 * len(rows)


def test_pages_through_spark(spark):
    rows = [(1, None, None, "a"), (2, "u", f"<p>{LONG}</p>", "b"), (2, "u", f"<p>{LONG}</p>", "b"), (None, "v", "", "c"), (3, "w", "<p>" + "word " * 200_000 + "</p>", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.n_chars) for r in html.extract(pages).collect()), key=str)
    assert got == sorted([(1, 0), (2, len(LONG)), (2, len(LONG)), (None, 0), (3, 999_999)], key=str)
    assert html.extract(pages.limit(0)).count() == 0


def test_many_spans_and_a_callers_columns(spark):
    text = " ".join(f"token=abcdef{i}" for i in range(700))
    docs = spark.createDataFrame([(1, text, "mine", "too"), (None, None, "mine", None)], "doc_id long, text string, base_spans string, all_spans string")
    model = secrets.train(secrets.labelled_samples(docs))
    row = secrets.scan(docs.where("doc_id = 1"), model).first()
    at, want = 0, []
    for word in text.split(" "):
        want.append(f"assign:{at}:{at + len(word)}")
        at += len(word) + 1
    assert row.n_assign == 700 and row.spans == ",".join(want)
    clean = {r.doc_id: r for r in secrets.redact(docs, model).collect()}
    assert clean[1].text == " ".join(["[REDACTED]"] * 700) and clean[1].base_spans == "mine" and clean[None].text is None and clean[None].all_spans is None


def test_leaks_of_repeats_and_nulls(spark):
    item = " ".join(f"item{k}" for k in range(40))
    items = spark.createDataFrame([(1, item), (1, item), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"a {item}"), (5, f"b {item}"), (5, f"b {item}"), (5, "clean"), (6, None), (7, "")], "doc_id long, text string")
    rows = decontaminate.leaks(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.first_word, r.after_word) for r in rows) == sorted([("None", 1, 1, 41), ("5", 1, 1, 41), ("5", 1, 1, 41)] * 2)
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    kept = sorted((str(r.doc_id), str(r.text)) for r in decontaminate.keep_clean(docs, items).collect())
    assert kept == [("5", "clean"), ("6", "None"), ("7", "")]


def naive_score(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for w in item:
        new = [0]
        for j, t in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if w == t else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 40))
        assert decontaminate.smith_waterman(item, text)[0] == naive_score(item.tolist(), text.tolist())


def test_equal_texts_with_one_id_are_split(spark):
    same = spark.createDataFrame([(7, "hot text " * 30)] * 600 + [(i, f"text {i} " * (1 + i % 9)) for i in range(300)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(same, 8).collect()
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    total = sum(sizes.values())
    assert len(rows) == 900 and max(sizes.values()) - min(sizes.values()) < 0.1 * total / 8
    groups = {}
    for r in rows:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(("hot text " * 30).encode())
    assert all(len(s) == 1 for c, s in groups.items() if c != hot)


def test_vectors_that_repeat_or_differ_in_length(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [0.5, 0.5])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in neighbours.search(data, F.col("id") % 20 == 0).collect())
    assert got == [(1, 2), (2, 4), (3, 1)]  # of id 20 the vector least in order, [0, 1]
    assert neighbours.search(data.limit(0), F.col("id") % 20 == 0).count() == 0


def test_quality_against_a_direct_solve_and_edges(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(["good", "fine", "text", "words"] if i % 2 else ["$$", "##", "%%"], 30).tolist())) for i in range(400)]
    docs += [(3, "another text for id three"), (None, None), (9000, ""), (9000, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = quality.score_documents(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    model = quality.fit(df, labels.select("doc_id", F.col("quality").alias("label")))
    first = {}
    for i, t in docs:
        if i is not None and i < 400 and i != 3:
            first.setdefault(i, t)
    x = np.asarray([quality.statistics(t) for t in first.values()], np.float32).astype(np.float64)
    z, y = model.lift(x), np.array([float(i % 2) for i in first])
    direct = np.linalg.solve(z.T @ z + (quality.RIDGE * len(y) + 1e-6) * np.eye(z.shape[1]), z.T @ y)
    assert np.abs(z @ direct - model.raw(x)).max() < 0.1
    assert quality.score_documents(df.limit(0), labels).count() == 0
    assert {r.score for r in quality.score_documents(df, labels.limit(0)).collect()} == {0.5}


def test_packing_splits_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "the same words here")] * 500, "doc_id long, text string")
    pieces = packing.cut_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"), "byte", 0, 64)
    rows = packing.pack(pieces, 64, 50).collect()
    assert len(rows) == 500 and len({r.sequence_id >> 32 for r in rows}) > 5


def test_stages_keep_extra_columns_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame([(1, "some words", "hash", "n"), (None, None, None, None)], "doc_id long, text string, hash string, node string")
    for name, stage in pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns and stage(spark, docs, str(tmp_path)).count() == 2, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
