"""Token ids stored as one wavelet matrix per shard.

A shard file holds the ids of whole documents in ascending id order: the distinct ids (so that codes are dense), one
bit plane per code bit with a rank directory, and the documents' ids and lengths.  From the one file ``access``
reads tokens, ``rank`` and ``count`` count a token in a range and ``select`` finds its occurrences, without unpacking
the rest.  Files travel in a Parquet column of binary values because only Spark's writers reach every store.

Layout, little-endian: magic ``WMX1``, u32 number of ids, u32 planes, u32 alphabet, u32 documents, alphabet as u32,
zeros of each plane as u32, planes (bits from the low end of each byte), ones before each block of 512 bits as u32 per
plane, document ids as i64, their validity as u8, document lengths as u32, crc32 of all before as u32.

Nulls: a null text is empty (its end id alone is stored), a null doc_id sorts first.  Repeated rows are stored again; rows of
one id follow each other by their texts' hashes.  A very long text is encoded alone and closes its shard.  Extra columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import scratch
from marketlens.llm.tokens import encoder

BLOCK = 512
SHARD_IDS = 4_000_000
SHARD_TEXT_BYTES = 24_000_000


class WaveletMatrix:
    """Succinct sequence of codes: bit planes from the highest bit down, each stably split by its bit."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        used = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype("<u4") if len(ids) else np.zeros(0, "<u4")
        code = np.zeros(len(used), np.uint32)
        code[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        s = code[ids] if len(ids) else np.zeros(0, np.uint32)
        if len(alphabet) <= 65536:
            s = s.astype(np.uint16)
        levels = max(1, int(len(alphabet) - 1).bit_length()) if len(ids) else 1
        width = -(-len(s) // BLOCK) * (BLOCK // 8)
        planes, zeros = np.zeros((levels, width), np.uint8), np.zeros(levels, "<u4")
        for level in range(levels):
            bits = (s >> (levels - 1 - level)) & 1 == 1
            packed = np.packbits(bits, bitorder="little")
            planes[level, : len(packed)] = packed
            low = s[~bits]
            zeros[level] = len(low)
            s = np.concatenate([low, s[bits]])
        ones = np.bitwise_count(planes).reshape(levels, -1, BLOCK // 8).sum(axis=2, dtype=np.int64)
        ranks = (np.cumsum(ones, axis=1) - ones).astype("<u4")
        return cls(len(ids), alphabet, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[level])
        block, byte = i // BLOCK, i // 8
        total = int(self.ranks[level, block]) + int(np.bitwise_count(self.planes[level, block * (BLOCK // 8) : byte]).sum())
        return total + (int(self.planes[level, byte]) & ((1 << (i % 8)) - 1)).bit_count()

    def access(self, i: int) -> int:
        """The id at position i."""
        code = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level, i // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int] | None:
        at = int(np.searchsorted(self.alphabet, token))
        if at == len(self.alphabet) or self.alphabet[at] != token:
            return None
        levels = len(self.planes)
        for level in range(levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            zero = int(self.zeros[level])
            lo, hi = (zero + a, zero + b) if at >> (levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        hi = self.n if hi is None else min(hi, self.n)
        found = self._range(token, lo, hi) if lo < hi else None
        return found[1] - found[0] if found else 0

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0); -1 if there are fewer."""
        found = self._range(token, 0, self.n)
        if not found or not 0 <= k < found[1] - found[0]:
            return -1
        at, i = int(np.searchsorted(self.alphabet, token)), found[0] + k
        levels = len(self.planes)
        for level in range(levels - 1, -1, -1):
            bit = at >> (levels - 1 - level) & 1
            i = self._select_bit(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        blocks = self.ranks[level].astype(np.int64)
        before = blocks if bit else np.arange(len(blocks)) * BLOCK - blocks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level, block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the splits from the lowest plane up."""
        if not self.n:
            return np.zeros(0, "<u4")
        dtype = np.uint16 if len(self.alphabet) <= 65536 else np.uint32
        levels = len(self.planes)
        s = None
        for level in range(levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zero = int(self.zeros[level])
            up = np.empty(self.n, dtype)
            if s is None:
                up[...] = bits
            else:
                up[~bits] = s[:zero]
                up[bits] = s[zero:] | dtype(1 << (levels - 1 - level))
            s = up
        return self.alphabet[s]

    def to_bytes(self, doc_ids: list[int | None], lengths: list[int]) -> bytes:
        parts = [b"WMX1", struct.pack("<4I", self.n, len(self.planes), len(self.alphabet), len(lengths))]
        parts += [self.alphabet.astype("<u4").tobytes(), self.zeros.astype("<u4").tobytes(), self.planes.tobytes(), self.ranks.astype("<u4").tobytes()]
        parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u4").tobytes()]
        body = b"".join(parts)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        """The matrix, the documents' ids and their lengths; a damaged file raises ValueError."""
        if data[:4] != b"WMX1" or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole wavelet file")
        n, levels, letters, docs = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        blocks = -(-n // BLOCK)
        alphabet, zeros = take("<u4", letters), take("<u4", levels)
        planes = take("u1", levels * blocks * (BLOCK // 8)).reshape(levels, -1)
        ranks = take("<u4", levels * blocks).reshape(levels, -1)
        ids, valid, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        return cls(n, alphabet, zeros, planes, ranks), [int(i) if v else None for i, v in zip(ids, valid)], lengths


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, cut: str = "word", end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode documents in ascending id order and write shard files of about ``shard_ids`` ids under ``path``."""

    def shards(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, held, ids, docs_in = TaskContext.get().partitionId(), 0, 0, [], []

        def close():
            nonlocal number, held, ids, docs_in
            body = WaveletMatrix.build(np.concatenate(ids)).to_bytes(docs_in, [len(x) for x in ids])
            row = pa.RecordBatch.from_arrays([pa.array([part << 20 | number], pa.int64()), pa.array([held], pa.int64()), pa.array([body], pa.binary())], ["shard", "n_ids", "body"])
            number, held, ids, docs_in = number + 1, 0, [], []
            return row

        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, found, offsets in encoder(tokenizer_path, cut).encode(batch.column(1), end_id):
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    ids.append(found[a:b])
                    docs_in.append(names[row + k])
                    held += b - a
                    if held >= shard_ids:
                        yield close()
        if ids:
            yield close()

    spark = docs.sparkSession
    parts = max(1, int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_TEXT_BYTES) + 1)
    # rows that share an id, or have none, are split by their texts' hashes and row numbers
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "tie", "row")
    ordered = keyed.repartitionByRange(max(parts, spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(shards, "shard long, n_ids long, body binary").write.parquet(path)


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of shard files: doc_id, start, n_tokens and the crc32 of its ids, decoded from the planes."""

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                matrix, docs, lengths = WaveletMatrix.from_bytes(body.as_py())
                ids = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array([shard] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "body").mapInArrow(decode, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer_path: str, cut: str = "word", end_id: int = 2) -> DataFrame:
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "wavelet")
    write_shards(docs, path, tokenizer_path, cut, end_id)
    return read_documents(spark.read.schema("shard long, n_ids long, body binary").parquet(path))
