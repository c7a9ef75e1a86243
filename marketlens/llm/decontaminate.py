"""Benchmark passages in documents: rare n-gram seeds, then Smith-Waterman alignment.

Words (letters and digits, lower-cased) of a test item give its n-grams.  One pass over all documents stores, for each that has
any, the n-grams it shares with items, and its coded words if enough of one item lie along a diagonal.  The counts of these
rows say in how many documents each n-gram occurs; an item's seeds are its rarer half by that count.  The stored
candidates are joined with the seeds: the hits of an item are gathered along diagonals, and the item is aligned with the words
around them.  The score is the alignment's share of the score of the whole item, so an edited or reworded copy still scores high.

Seeds travel to the tasks as arrays, at most about ``SLICE_NGRAMS`` n-grams at a time, which bounds what the driver and a
broadcast hold; a larger benchmark takes more passes.

Nulls: null or wordless items and documents match nothing; a null id is kept.  Repeated rows are aligned again; of alignments
with equal scores the first in the text counts.  Texts of any length are read whole; a very long one is a slice of its own.
Extra columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import materialize, release
from marketlens.llm.tokens import ChunkTable

NGRAM = 3
SLICE_NGRAMS = 1_000_000
CODE_BITS = 21
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
LEAST_SEEDS = 2
words_of = re.compile(r"[^\W_]+").findall


class Seeds:
    """The n-grams of a bounded slice of items, coded by the vocabulary of those items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items, codes, owner, place = [], [], [], []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of((text or "").lower())]
            if ids:
                self.items.append((item_id, np.array(ids, np.int64)))
        for k, (_, ids) in enumerate(self.items):
            own = self.grams(ids)
            codes.append(own)
            owner.append(np.full(len(own), k, np.int64))
            place.append(np.arange(len(own)))
        self.code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place) if place else np.zeros(0, np.int64)
        self.short = [(i, w) for i, w in self.items if len(w) < NGRAM]
        words = np.array([len(w) for _, w in self.items], np.int64)
        self.band, self.need = np.maximum(4, words // 3), np.minimum(LEAST_SEEDS, np.maximum(1, words - NGRAM + 1))
        self._index(np.arange(len(self.code)))

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the n-grams; an item of fewer words has none and is looked up whole."""
        n = NGRAM
        if len(ids) < n:
            return np.zeros(0, np.int64)
        out = np.zeros(len(ids) - n + 1, np.int64)
        for i in range(n):
            out = out * (1 << CODE_BITS) + ids[i : len(ids) - n + 1 + i]
        return out

    def hits(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, indices into ``distinct``) of n-grams that some item has, in texts whose coded words lie between offsets."""
        if len(ids) < NGRAM or not len(self.distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = np.logical_and.reduce([ids[i : len(ids) - NGRAM + 1 + i] >= 0 for i in range(NGRAM)])
        at = np.flatnonzero(whole)
        at = at[np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + NGRAM - 1, "right")]
        code = np.zeros(len(at), np.int64)
        for i in range(NGRAM):
            code = code * (1 << CODE_BITS) + ids[at + i]
        where = np.minimum(np.searchsorted(self.distinct, code), len(self.distinct) - 1)
        same = self.distinct[where] == code
        return at[same], where[same]

    def keep_rare(self, seen: np.ndarray) -> None:
        """Keep each item's rarer half (at least three) by document counts along ``distinct``."""
        count = seen[np.searchsorted(self.distinct, self.code)]
        order = np.lexsort((np.arange(len(count)), count, self.owner))
        size = np.bincount(self.owner, minlength=len(self.items))
        first = np.cumsum(size) - size
        rank = np.arange(len(order)) - np.repeat(first, size)
        keep = np.sort(order[rank < np.repeat(np.maximum(3, (size + 1) // 2), size)])
        self._index(keep)

    def _index(self, keep: np.ndarray) -> None:
        keep = keep[np.argsort(self.code[keep], kind="stable")]
        self.code, self.owner, self.place = self.code[keep], self.owner[keep], self.place[keep]
        self.distinct = np.unique(self.code)
        self.first = np.searchsorted(self.code, self.distinct)
        self.after = np.append(self.first[1:], len(self.code))

    def diagonals(self, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, offset of the item in the text, place in the item) of every hit, by item and offset."""
        spread = self.after[gram] - self.first[gram]
        each = np.repeat(np.arange(len(at)), spread)
        index = np.repeat(self.first[gram], spread) + np.arange(len(each)) - np.repeat(np.cumsum(spread) - spread, spread)
        owner, offset, place = self.owner[index], at[each] - self.place[index], self.place[index]
        order = np.lexsort((offset, owner))
        return owner[order], offset[order], place[order]


class CodedWords(ChunkTable):
    """Texts as their words' codes in the items' vocabulary; -1 for a word that no item has."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__("word")
        self.vocabulary = vocabulary

    def _learn(self, chunks: list[str]) -> np.ndarray:
        entry = np.arange(self.entries, self.entries + len(chunks))
        codes = [[self.vocabulary.get(w, -1) for w in words_of(c.lower())] for c in chunks]
        ends = np.cumsum([len(c) for c in codes])
        self._store(np.array([x for c in codes for x in c], np.int64).astype(np.uint32), ends, 0)
        self.known.update((c, e) for c, e in zip(chunks, entry.tolist()) if len(c) <= 64)
        return entry


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(best local score, start, end) of the item's alignment in the text, with linear gaps."""
    ramp = np.arange(len(text) + 1) * -GAP
    row = np.zeros(len(text) + 1, np.int64)
    begin = np.arange(len(text) + 1)
    best, start, end = 0, 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(text == word, MATCH, MISMATCH)
        above = row[1:] + GAP
        value = np.maximum(np.maximum(diagonal, above), 0)
        origin = np.where(diagonal >= above, begin[:-1], begin[1:])
        value, origin = np.append(0, value), np.append(0, np.where(value > 0, origin, np.arange(1, len(text) + 1)))
        reach = np.maximum.accumulate(value + ramp)
        source = np.maximum.accumulate(np.where(value + ramp == reach, np.arange(len(value)), 0))
        row, begin = reach - ramp, np.where(reach - ramp > value, origin[source], origin)
        top = int(row.argmax())
        if row[top] > best:
            best, start, end = int(row[top]), int(begin[top]), top
    return best, start, end


def leaks_in(ids: np.ndarray, seeds: Seeds, least: float = LEAST_SCORE) -> list[tuple[int | None, float, int, int]]:
    """(item_id, score, first word, word after) of the best alignment of each item that scores at least ``least``."""
    out: list[tuple[int | None, float, int, int]] = []
    for item_id, w in seeds.short:
        places = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - len(w) + 1 + k] == w[k] for k in range(len(w))])) if len(ids) >= len(w) else []
        if len(places):
            out.append((item_id, 1.0, int(places[0]), int(places[0]) + len(w)))
    at, gram = seeds.hits(ids, np.array([0, len(ids)]))
    if not len(at):
        return out
    owner, offset, place = seeds.diagonals(at, gram)
    for k in np.unique(owner).tolist():
        item_id, w = seeds.items[k]
        a, b = np.searchsorted(owner, [k, k + 1])
        band = max(4, len(w) // 3)
        cuts = np.flatnonzero(np.diff(offset[a:b]) > band) + 1
        best = (0.0, 0, 0)
        for run in np.split(np.arange(a, b), cuts):
            if len(np.unique(place[run])) < min(LEAST_SEEDS, max(1, len(w) - NGRAM + 1)):
                continue
            # a long run of offsets is aligned in overlapping windows
            for low in range(int(offset[run[0]]), int(offset[run[-1]]) + 1, 4 * len(w)):
                inside = (offset[run] >= low) & (offset[run] < low + 4 * len(w))
                if not inside.any():
                    continue
                lo = max(0, int(offset[run][inside].min()) - band)
                hi = min(len(ids), int(offset[run][inside].max()) + len(w) + band)
                score, start, end = smith_waterman(w, ids[lo:hi])
                if score / (MATCH * len(w)) > best[0]:
                    best = (score / (MATCH * len(w)), lo + start, lo + end)
        if best[0] >= least:
            out.append((item_id, *best))
    return out


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in slices of a bounded number of words, one at a time on the driver."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append((row.item_id, row.text))
        size += 1 + len(words_of(row.text or ""))
        if size >= SLICE_NGRAMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _promising(seeds: Seeds, at: np.ndarray, gram: np.ndarray) -> bool:
    """Whether enough n-grams of one item, rare or not, lie near a diagonal: what ``leaks_in`` asks of the rare ones alone."""
    owner, offset, place = seeds.diagonals(at, gram)
    cut = np.ones(len(owner), bool)
    cut[1:] = (owner[1:] != owner[:-1]) | (np.diff(offset) > seeds.band[owner[1:]])
    run = np.cumsum(cut)
    pairs = np.unique(run * (1 << 32) + place) >> 32
    enough = np.bincount(pairs, minlength=int(run[-1]) + 1)[run] >= seeds.need[owner]
    return bool(enough.any())


def _candidates(docs: DataFrame, sent) -> DataFrame:
    """doc_id, the text's hash, the n-grams (numbers in ``distinct``) of every document that shares one with an item, and its
    coded words where it may hold an item."""

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seeds = sent.value
        coder = CodedWords(seeds.vocabulary)
        for batch in batches:
            for row, coded, offsets in coder.encode(batch.column(2), None):
                ids = coded.view(np.int32)
                at, gram = seeds.hits(ids, offsets)
                doc = np.searchsorted(offsets, at, "right") - 1
                cuts = np.searchsorted(doc, np.arange(len(offsets)))
                which = np.flatnonzero(np.diff(cuts)).tolist() if not seeds.short else range(len(offsets) - 1)
                rows, grams, words = [], [], []
                for k in which:
                    a, b = cuts[k], cuts[k + 1]
                    own = ids[offsets[k] : offsets[k + 1]]
                    if b > a or any((own == w[0]).any() for _, w in seeds.short):
                        keep = bool(seeds.short) or _promising(seeds, at[a:b] - offsets[k], gram[a:b])
                        rows.append(row + k)
                        grams.append(np.unique(gram[a:b]))
                        words.append(own.tobytes() if keep else None)
                some = batch.take(pa.array(rows, pa.int64()))
                held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(g) for g in grams])).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *grams])))
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(1), held, pa.array(words, pa.binary())], ["doc_id", "hash", "grams", "words"])

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(find, "doc_id long, hash long, grams array<long>, words binary")


def _leaks_of(docs: DataFrame, items: list, least: float) -> DataFrame:
    """doc_id, hash, item_id, score, first_word, after_word, stored."""
    spark = docs.sparkSession
    seeds = Seeds(items)
    found = materialize(_candidates(docs, spark.sparkContext.broadcast(seeds)), "candidates")
    seen = np.zeros(len(seeds.distinct), np.int64)
    counts = found.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).toArrow()
    seen[counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
    seeds.keep_rare(seen)
    rare = spark.sparkContext.broadcast(seeds)

    def align(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(doc, h, *leak) for doc, h, words in zip(*(batch.column(k).to_pylist() for k in range(3))) for leak in leaks_in(np.frombuffer(words, np.int32).astype(np.int64), rare.value, least)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "hash", "item_id", "score", "first_word", "after_word"])

    some = found.where("words is not null").select("doc_id", "hash", "words")
    out = materialize(some.mapInArrow(align, "doc_id long, hash long, item_id long, score double, first_word long, after_word long"), "leaks")
    release(found)
    return out


def _all_leaks(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    found = [_leaks_of(docs, items, least) for items in _slices(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, hash long, item_id long, score double, first_word long, after_word long")
    return reduce(DataFrame.unionByName, found)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score (0.5 to 1) and the words it spans, for every document and item that align."""
    return _all_leaks(docs, benchmark, least).drop("hash")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose own text aligns with no item: a row is known by its id, which may be null, and its text's hash."""
    found = _all_leaks(docs, benchmark, least).select(F.col("doc_id").alias("id"), "hash").distinct()
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    return hashed.join(found, (hashed["_hash"] == found["hash"]) & hashed["doc_id"].eqNullSafe(found["id"]), "left_anti").select(*docs.columns)
