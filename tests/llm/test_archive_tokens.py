import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marketlens.llm import packing, queries, sharding, warc, wavelet
from marketlens.llm.tokens import ChunkEncoder

DOCS = "doc_id long, text string, source string, n_chars long, extra int"
PAGES = "page_id long, url string, html string, size int"
HARD = [None, "", " ", "a", "a b", "<|endoftext|> x", "tail \n\n  x\t", "é́ñ ☃😀　漢字", "it's we'll " * 3, "word " * 3000, "x" * 5000]


def hard_docs(spark):
    rows = [(i, t, "s", 1, 2) for i, t in enumerate(HARD)] + [(3, "a", "s", 1, 2), (3, "a", None, None, None), (None, "no id", "s", 1, 2), (99, "a b", "s", 1, 2)]
    return spark.createDataFrame(rows, DOCS)


def encoded(encoder, texts, end):
    return [ids[a:b].tobytes() for _, ids, at in encoder.encode(pa.array(texts, pa.string()), end) for a, b in zip(at[:-1], at[1:])]


def reference_ids(name, text, end):
    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,cut", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_chunks_give_the_tokenizers_ids(name, cut):
    random.seed(3)
    alphabet = "ab'sS 　\n\t\x1c\x85\xa0  ​́é1２.,İΣ😀\r<|>"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(1500)] + HARD
    got = encoded(ChunkEncoder(queries.tokenizer_path(name), cut), texts, 5)
    assert all(np.frombuffer(g, "<u4").tolist() == reference_ids(name, t, 5) for g, t in zip(got[-200:], texts[-200:]))
    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.encode_special_tokens = True
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert all(np.frombuffer(g, "<u4").tolist() == w.ids + [5] for g, w in zip(got, want))


def test_wavelet_matrix_answers_from_the_file():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 700, 3000).astype("<u4")
    m, docs, lengths = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes([4, None], [1000, 2000]))
    assert docs == [4, None] and lengths.tolist() == [1000, 2000] and (m.decode() == ids).all()
    for i in (0, 1, 511, 512, 2999):
        assert m.access(i) == ids[i]
    for token in (int(ids[9]), 699, 5000):
        where = np.flatnonzero(ids == token)
        assert m.count(token, 10, 2500) == ((where >= 10) & (where < 2500)).sum() and m.rank(token, 1500) == (where < 1500).sum()
        assert [m.select(token, k) for k in range(len(where) + 1)] == [*where, -1]
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"WMX1" + b"\0" * 40)


def test_token_files_round_trip(spark):
    rows = wavelet.encode_and_read(hard_docs(spark), queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert len(rows) == len(HARD) + 4
    ordered, at = sorted(rows, key=lambda r: r.start), 0
    assert [r.doc_id if r.doc_id is not None else -1 for r in ordered] == sorted(r.doc_id if r.doc_id is not None else -1 for r in rows)
    for r in ordered:
        ids = reference_ids("word_bpe_49k.json", "no id" if r.doc_id is None else "a b" if r.doc_id == 99 else HARD[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += r.n_tokens
    assert wavelet.encode_and_read(hard_docs(spark).limit(0), queries.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_small_shards_keep_the_order(spark, tmp_path):
    docs = hard_docs(spark)
    wavelet.write_shards(docs, str(tmp_path / "w"), queries.tokenizer_path("word_bpe_49k.json"), shard_ids=10)
    small = wavelet.read_documents(spark.read.parquet(str(tmp_path / "w"))).collect()
    assert sorted(map(tuple, small), key=str) == sorted(map(tuple, wavelet.encode_and_read(docs, queries.tokenizer_path("word_bpe_49k.json")).collect()), key=str)


def test_packing_covers_every_id_once(spark):
    rows = packing.pack_documents(hard_docs(spark), queries.tokenizer_path("byte_bpe_50k.json"), window=64).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for doc, text in enumerate(HARD):
        ids = reference_ids("byte_bpe_50k.json", text, 0)
        mine = sorted({(r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc})
        assert [s for s, _, _ in mine] == list(range(0, len(ids), 64)) and all(crc(ids[s : s + n]) == c for s, n, c in mine)
        assert {r.doc_tokens for r in rows if r.doc_id == doc} == {len(ids)}
    assert packing.pack_documents(hard_docs(spark).limit(0), queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_best_fit_decreasing_takes_the_tightest_window():
    random.seed(2)
    lengths = [random.randint(1, 50) for _ in range(400)]
    where, offset = packing.best_fit_decreasing(lengths, 50)
    room, want = [], {}
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        capacity = min(fits) if fits else 50
        if fits:
            room.remove(capacity)
        want[i] = 50 - capacity
        room.append(capacity - lengths[i])
    assert [want[i] for i in range(400)] == offset and max(where) + 1 == len(room)


def test_shards_by_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    hot = spark.createDataFrame([(10_000 + i, "hot text " * 40, "s") for i in range(300)] + [(None, None, None), (7, "", "s")], "doc_id long, text string, source string")
    for data in (docs, docs.unionByName(hot), hot):
        rows, source = sharding.shard_by_bytes(data, 8).collect(), {r.doc_id: r.text for r in data.collect()}
        assert len(rows) == data.count()
        sizes = {}
        for r in rows:
            sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        for s in range(8):
            mine = sorted(r.slot for r in rows if r.shard == s)
            assert mine == list(range(len(mine)))
        total, largest = sum(sizes.values()), max(r.size for r in rows)
        assert all(abs(sizes.get(s, 0) - total / 8) <= largest + 0.1 * total / 8 for s in range(8))
        for r in rows:
            raw = (source[r.doc_id] or "").encode() if r.doc_id != 7 else None
            assert raw is None or (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert sharding.shard_by_bytes(docs.limit(0), 8).count() == 0


def test_archive_round_trip(spark, tmp_path):
    pages = [(5, "http://a", "<p>x</p>", 1), (3, "http://b", "<p>x</p>", 1), (9, None, None, 1), (8, "http://e\r\nX: y", "", 1), (4, "u", "é" * 9000, 1), (3, "http://b", "<p>x</p>", 1), (None, "n", "<p>x</p>", 1)]
    data = spark.createDataFrame(pages, PAGES)
    rows = warc.archive_and_read(data).collect()
    want = []
    for page, _, html, _ in pages:
        body = (html or "").encode()
        first = min(p for p, _, h, _ in pages if (h or "") == (html or "") and p is not None)
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if page == first else "revisit", None if page == first else first, True))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    warc.write_archive(data, str(tmp_path / "w"), min_revisit_bytes=5)
    for r in warc.rebuild(spark, str(tmp_path / "w")).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nX:" not in head
        assert body[:-4] == (b"" if b"Type: revisit" in head else bytes(r.payload))
        assert b"Type: revisit" not in head or len(r.payload) >= 5
    assert warc.archive_and_read(data.limit(0)).count() == 0


def test_encoder_matches_the_library_on_letters_and_marks():
    texts = ["ΟΔΥΣΣΕΥΣ Σ İstanbul ÉTÉ Straße ŉ ª º µ Ĳ", None, "", "don't IT'S x's (word), \"Word\"... word word$$$ 12ab", "ñ" * 70 + " ẞß é É ﬁ Å", "<|endoftext|> a<|x \x1c b", "Same same SAME same,"]
    for name, cut in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        path = queries.tokenizer_path(name)
        library, ours = Tokenizer.from_file(path), ChunkEncoder(path, cut)
        library.encode_special_tokens = True
        expected = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        for _ in range(2):  # the second time from the cache
            assert [np.frombuffer(b, "<u4").tolist() for b in encoded(ours, texts, 2)] == expected
