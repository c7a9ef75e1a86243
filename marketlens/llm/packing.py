"""Best-fit-decreasing packing of token sequences into windows of a fixed length.

Overlong documents are first cut into full windows; what is left of each document is packed, longest first,
into the open window with the least room that still holds it.  A segment tree indexed by remaining capacity
finds that window.  Pieces are dealt by the hash of their number in the stored table into groups of bounded size, each packed
by one task, whatever ids repeat; the last windows of the groups are the only loose ones.

Nulls: a null text is empty and packs as its end id alone; a null id is kept.  Rows that repeat are packed as often
as they come.  Ties of length are packed by id, start and number.  Texts of any length are encoded whole, one at a time where
they are long.  Extra columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import materialize
from marketlens.llm.tokens import encoder

WINDOW = 1024
PIECES_PER_GROUP = 16_384
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Open windows by remaining capacity 0..size; finds the smallest capacity of at least some length."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for ``length``, taken out of the tree."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The window and the offset in it of each length (1..window), packed longest first, ties in the given order."""
    tree, windows = CapacityTree(window), 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.pop_tightest(lengths[i])
        capacity, at = found or (window, windows)
        windows += found is None
        where[i], offset[i] = at, window - capacity
        if capacity > lengths[i]:
            tree.push(capacity - lengths[i], at)
    return where, offset


def cut_documents(docs: DataFrame, tokenizer_path: str, cut: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row per piece: full windows of a document and then its rest."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 36
        for batch in batches:
            for row, ids, offsets in encoder(tokenizer_path, cut).encode(batch.column(1), end_id):
                size = np.diff(offsets)
                parts = -(-size // window)
                doc = np.repeat(np.arange(len(size)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, size[doc] - start)
                view, at = memoryview(ids).cast("B"), (offsets[doc] + start) * 4
                crcs = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                cols = [start, length, np.array(crcs, np.int64), size[doc], made + np.arange(len(doc))]
                made += len(doc)
                ids_of = batch.column(0).cast(pa.int64()).take(pa.array(row + doc))
                yield pa.RecordBatch.from_arrays([ids_of, *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE_SCHEMA + ", piece long")


def pack(pieces: DataFrame, window: int = WINDOW, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; ``pieces`` should be a stored table, it is read twice."""
    groups = max(1, -(-pieces.count() // per_group))

    def pack_group(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        group = group.take(pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")]))
        where, offset = best_fit_decreasing(group.column("length").to_pylist(), window)
        first = group.column("grp")[0].as_py() << 32
        group = group.drop_columns(["grp", "piece"])
        return group.append_column("sequence_id", pa.array([first + w for w in where], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(pack_group, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, cut: str = "byte", end_id: int = 0, window: int = WINDOW) -> DataFrame:
    return pack(materialize(cut_documents(docs, tokenizer_path, cut, end_id, window), "pieces"), window)
