"""Sum-of-squares packing of whole documents into sequences of at most ``window`` tokens.

For every gap (room left) the number of open sequences with that gap is kept.  A piece goes where the sum of the squares of these
numbers becomes smallest: out of gap g into gap g - length, or into a new sequence; full ones no longer count.  Gaps of
which there are many are thus filled first, and gaps that nothing else has are made.  Pieces come longest first, and a new
sequence is opened only if no open one has room, which gave fewer sequences than arrival order and than opening by
squares alone.  Equal sums go to the smallest gap.

Only documents longer than the window are cut, into full windows and a rest.  Pieces are dealt by the hash of their number in
the stored table into groups of bounded size, each packed by one task, whatever ids repeat.

Nulls: a null text is empty and packs as its end id alone; a null id is kept.  Repeated rows are packed as often as they come.
Ties of length are packed by id, start and number.  Texts of any length are encoded whole.  Extra columns are ignored.  Empty tables
give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import materialize
from marketlens.llm.packing import PIECE_SCHEMA, cut_documents

WINDOW = 4096
PIECES_PER_GROUP = 32_768


def sum_of_squares(lengths: list[int], window: int = WINDOW, longest_first: bool = True, any_fit: bool = True) -> tuple[list[int], list[int]]:
    """The sequence and the offset in it of each length (1..window)."""
    where, offset = [0] * len(lengths), [0] * len(lengths)
    count = np.zeros(window + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(window + 1)]
    opened, none = 0, np.iinfo(np.int64).max
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]) if longest_first else range(len(lengths)):
        size = lengths[i]
        # what the move adds to the sum; a full sequence (gap 0) counts nothing
        cost = np.where(count[size:] > 0, 2 * (count[: window - size + 1] - count[size:] + 1), none)
        if count[size]:
            cost[0] = 1 - 2 * count[size]
        gap = int(cost.argmin()) + size
        if cost[gap - size] == none or (not any_fit and cost[gap - size] > 2 * count[window - size] + 1):
            gap, at = window, opened
            opened += 1
        else:
            at = held[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = at, window - gap
        if gap > size:
            count[gap - size] += 1
            held[gap - size].append(at)
    return where, offset


def pack(pieces: DataFrame, window: int = WINDOW, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Adds ``piece``, ``sequence_id`` and ``offset``; ``pieces`` should be a stored table, it is read twice."""
    groups = max(1, -(-pieces.count() // per_group))

    def pack_group(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        group = group.take(pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")]))
        where, offset = sum_of_squares(group.column("length").to_pylist(), window)
        first = group.column("grp")[0].as_py() << 32
        group = group.drop_columns(["grp", "piece"])
        return group.append_column("sequence_id", pa.array([first + w for w in where], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInArrow(pack_group, PIECE_SCHEMA + ", sequence_id long, offset long")
    return packed.withColumn("piece", F.expr(f"cast(start div {window} as int)"))


def pack_documents(docs: DataFrame, tokenizer_path: str, cut: str = "word", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, doc_tokens of each piece."""
    out = pack(materialize(cut_documents(docs, tokenizer_path, cut, end_id, window), "whole-pieces"), window)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")
