"""Token ids of whole texts, computed inside Arrow batches.

A pre-tokenizer never joins characters across the white space it cuts at, nor a letter or digit and the marks that end its
word, so a text's ids are the ids of its chunks put one after another.  Arrays find the chunks of many texts in their UTF-8
bytes, Arrow's dictionary names each distinct one, the tokenizers library encodes those not met before by this worker, and
arrays again put the ids together.  Special tokens' strings in a text are ordinary text, as the files' own description asks
(``encode_special_tokens``).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np

# ASCII white space, the other white space of the Unicode property in UTF-8, and ASCII marks that end a run of
# letters or digits and never start a contraction by themselves.
SPACES = b"\t\n\x0b\x0c\r "
WIDE_SPACES = "\x85\xa0                　"
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
# letters that composition leaves alone and whose lower case does not depend on their neighbours
PLAIN = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-į]+").fullmatch
CACHE_ENTRIES = 600_000
LONGEST_CACHED = 64
SLICE_BYTES = 4 << 20
JOINED = 2048
PLAIN_JOINED = 512

_CODES = np.arange(256)
_IS_SPACE = np.isin(_CODES, list(SPACES))
_IS_TAIL = np.isin(_CODES, list(TAIL))
_IS_WORD = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_IS_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LEADS = np.isin(_CODES, sorted({c.encode()[0] for c in WIDE_SPACES}))
_WIDE = np.array([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in WIDE_SPACES])


def _spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _IS_SPACE[raw]
    at = np.flatnonzero(_LEADS[raw])
    if len(at):
        pad = np.append(raw, np.zeros(2, np.uint8)).astype(np.int64)
        two = raw[at] == 0xC2
        code = (pad[at] << 16) + (pad[at + 1] << 8) + np.where(two, 0, pad[at + 2])
        found = np.isin(code, _WIDE)
        for k in (0, 1, 2):
            out[at[found & ~(two & (k == 2))] + k] = True
    return out


def chunks_of(raw: np.ndarray, offsets: np.ndarray, cut: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each chunk in them and their end, first chunk of each text and the end) of texts lying in ``raw``.

    ``cut`` names how the pre-tokenizer treats white space: ``word`` drops it; for ``byte`` one space belongs to the word
    after it, and the rest of a run is a chunk of its own, without the run's last character if a word follows.
    """
    n = len(raw)
    space = _spaces(raw)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    solid = ~space
    start, end = solid.copy(), np.zeros(n + 1, bool)
    start[1:] &= space[:-1] | begins[1:-1]
    end[1:] = solid
    end[1:-1] &= space[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    # marks that end a word
    other = np.maximum.accumulate(np.where(_IS_TAIL[raw], -1, np.arange(n))) if n else np.zeros(0, np.int64)
    tail = other[ends - 1] + 1
    tail = tail[(tail > starts) & (tail < ends)]
    first[tail[_IS_WORD[raw[tail - 1]]]] = True
    if cut == "word":
        low = np.append(raw[1:] < 0x80, True) & _IS_UPPER[raw]
        data = np.where(low, raw + 32, raw)[solid] if n else raw
        at = np.flatnonzero(first[:-1])
        place = (np.cumsum(solid) - 1)[at] if n else at
        return data, np.append(place, len(data)), np.searchsorted(at, offsets)
    after = starts[~begins[starts]]
    before = raw[after - 1]
    wide = before >= 0x80
    back = np.where(wide, np.where(raw[after - 2] == 0xC2, 2, 3), 1)
    first[after[before == 32]] = False
    first[after - back] = True
    first[ends] = True
    first[offsets[:-1]] = True
    first[n] = False
    at = np.flatnonzero(first[:-1])
    return raw, np.append(at, n), np.searchsorted(at, offsets)


class ChunkTable:
    """Numbers for texts, chunk by chunk: each distinct chunk is looked up in a table that ``_learn`` fills."""

    def __init__(self, cut: str):
        self.cut = cut
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.end: dict[int, int] = {}
        self.ids, self.held = np.zeros(1 << 20, np.uint32), 0
        self.first, self.count, self.entries = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), 0

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Store the numbers of new chunks and return their entries."""
        raise NotImplementedError

    def _store(self, ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Keep the ids of a run of chunks; ``ends`` are their ends, with ``gap`` ids between two."""
        size = len(ids)
        while self.held + size > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while self.entries + len(ends) > len(self.first):
            self.first, self.count = np.append(self.first, np.zeros_like(self.first)), np.append(self.count, np.zeros_like(self.count))
        begins = np.append(0, ends[:-1] + gap)
        self.ids[self.held : self.held + size] = ids
        self.first[self.entries : self.entries + len(ends)] = begins + self.held
        self.count[self.entries : self.entries + len(ends)] = ends - begins
        self.held, self.entries = self.held + size, self.entries + len(ends)

    def _encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        if self.entries > CACHE_ENTRIES:
            self._forget()
        data, starts, of_text = chunks_of(raw, offsets, self.cut)
        texts = len(offsets) - 1
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        entry = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = self._learn([distinct[i] for i in new.tolist()])
        if end_id is not None and end_id not in self.end:
            self.end[end_id] = self.entries
            self._store(np.array([end_id], np.uint32), np.array([1]), 0)
        chunk = entry[words.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        after = of_text if end_id is None else np.append(0, of_text[1:] + np.arange(1, texts + 1))
        chunk = chunk if end_id is None else np.insert(chunk, of_text[1:], self.end[end_id])
        count = self.count[chunk]
        upto = np.append(0, np.cumsum(count))
        kind = np.int32 if upto[-1] + self.held < 2**31 else np.int64
        at = np.repeat((self.first[chunk] - upto[:-1]).astype(kind), count)
        at += np.arange(upto[-1], dtype=kind)
        return self.ids[at], upto[after]

    def encode(self, column, end_id: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) for runs of rows of an Arrow column of texts: each text's ids and then ``end_id``, if any.

        A null text is empty; a run has about ``SLICE_BYTES`` of text, or one text.
        """
        import pyarrow as pa

        held = column.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
        data = held.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(held):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE_BYTES, "right")) - 1)
            yield row, *self._encode(raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row], end_id)
            row = stop


class ChunkEncoder(ChunkTable):
    """Encodes texts with a tokenizers file; ``cut`` names how its pre-tokenizer treats white space."""

    def __init__(self, path: str, cut: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # new chunks are encoded many at a time with a special token between them, which nothing joins across
        self.joiner = Tokenizer.from_file(path)
        self.mark_id, mark = min((i, t.content) for i, t in self.joiner.get_added_tokens_decoder().items())
        self.mark, self.marks = mark, [t.content for t in self.joiner.get_added_tokens_decoder().values()]
        super().__init__(cut)
        self.plain = self._plain_words(path)
        # of a byte-level file, the ids that begin with a space: chunks that begin with theirs need no mark between them
        spaced = [i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")] if cut == "byte" else []
        self.spaced = np.isin(np.arange(self.tokenizer.get_vocab_size()), spaced)

    def _plain_words(self, path: str):
        """A tokenizer for words of plain lower-case letters, and which ids end a word, if the file folds case and marks
        the ends of words; such words need none of its normalising."""
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        if steps != ["NFC", "Replace", "Lowercase"] or not suffix:
            return None
        words = Tokenizer.from_file(path)
        words.normalizer = None
        words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = words.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return words, last

    def _alone(self, chunks: list[str]) -> None:
        for c in chunks:
            ids = np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32)
            self._store(ids, np.array([len(ids)]), 0)

    def _together(self, tokenizer, joint: str, chunks: list[str], size: int, ends_in, gap: int) -> None:
        """Many chunks by one call; should their number not come back, each by its own."""
        for i in range(0, len(chunks), size):
            part = chunks[i : i + size]
            ids = np.asarray(tokenizer.encode_batch_fast([joint.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = ends_in(ids)
            if len(ends) == len(part):
                self._store(ids, ends, gap)
            else:
                self._alone(part)

    def _learn(self, chunks: list[str]) -> np.ndarray:
        entry = np.empty(len(chunks), np.int64)
        plain, spaced, joined, alone = [], [], [], []
        for i, c in enumerate(chunks):
            if self.plain and PLAIN(c):
                plain.append(i)
            elif self.cut == "byte" and PLAIN(c, 1) and c[0] == " ":
                spaced.append(i)
            elif "<" in c or ">" in c or "|" in c or any(m in c for m in self.marks):  # a special token could begin or end here
                alone.append(i)
            else:
                joined.append(i)
        for kind, encode in (
            (plain, lambda part: self._together(self.plain[0], " ", [c.lower() for c in part], PLAIN_JOINED, lambda ids: np.flatnonzero(self.plain[1][ids]) + 1, 0)),
            (spaced, lambda part: self._together(self.tokenizer, "", part, PLAIN_JOINED, lambda ids: np.append(np.flatnonzero(self.spaced[ids])[1:], len(ids)), 0)),
            (joined, lambda part: self._together(self.joiner, self.mark, part, JOINED, lambda ids: np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1)),
            (alone, self._alone),
        ):
            at = self.entries
            if kind:
                encode([chunks[i] for i in kind])
            entry[kind] = np.arange(at, self.entries)
        self.known.update((c, e) for c, e in zip(chunks, entry.tolist()) if len(c) <= LONGEST_CACHED)
        return entry


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, cut: str) -> ChunkEncoder:
    """One encoder per worker process, shared by the tasks that run there."""
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = ChunkEncoder(path, cut)
    return _ENCODERS[path, cut]
