"""Similarity join on word shingles: Jaccard of at least 0.75, through count-vector R-trees.

1. Every text becomes its set of shingle hashes; texts with the same set are one node from here on, named by 64 bits.
2. Two sets that link must share one of the first ``n - ceil(t n) + 1`` shingles of each in any common order.  Shingles that are
   frequent in a sample of a fixed share of the documents come last in that order, which changes the work and never the
   result.  The leading shingles are dealt by hash to buckets, very frequent ones to several; sets that share one and whose
   sizes allow a link form a block.  A block over ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles is cut by size into chunks.
3. In a block each set is a point: its shingles counted by hash group.  An R-tree over the points prunes with the bound
   "overlap <= sum of coordinate minima", on node corners first and on points then; surviving pairs are verified on the whole
   sets.  A pair that is already connected needs no check.
4. In a first round each set meets only those that have the same largest chunk, which joins families of copies at one
   row a set.  Blocks that lie inside one component hold no new link and are left out from then on.  In the others
   only points travel, once for each bundle of blocks with the same least component, and beside them integers say which
   point is in which chunk.  Every pair across components has a member outside the commonest one of its block: such members
   alone visit the block's other chunks.  The R-tree gives pairs across components: in one round each set's nearest
   alone, which joins what is left of the families, at last all of them.  Components come from star contraction.

Nulls: a null or blank text has no shingle and no link; a null doc_id takes part and is never a component's name unless all of its
members have none.  Repeated rows are copies, and so are rows of one doc_id with the same shingles; rows of one doc_id with
other texts are documents of their own.  Texts of any length are taken whole.  Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import materialize, release

NUM, DEN = 75, 100
WIDTH = 5
GROUPS = 256
LEAF = 32
NEAREST_ROUNDS = 1
BLOCK = 1500
BLOCK_SHINGLES = 2_000_000
BUCKET_ENTRIES = 1_500_000
SPLIT_ENTRIES = 200_000
MOST_BROADCAST = 500_000
SAMPLE_SHARE = 1 / 16
SAMPLE_OFTEN = 2
MOST_FREQUENT = 1_000_000
CHUNK_BYTES = 1 << 19
BUNDLE_BYTES = 24 << 20
BUNDLE_ROWS = 10_000

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_U = np.uint64
_STEP = _U(0x2545F4914F6CDD1D)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers, or more, of an odd base modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        step = np.full(max(1 << 12, 2 * n), _BASE, np.uint64)
        step[0] = 1
        _POWERS[:] = [np.cumprod(step, dtype=np.uint64)]
    return _POWERS[0]


def _word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one hash per word, first word of each text and the end) of texts that lie in ``raw`` between ``cuts``.

    Words are runs without ASCII white space, A-Z lower-cased; the end of a text ends a word.
    """
    raw = _LOWER[raw]
    solid = ~_SPACE[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[cuts] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | begins[1:-1]
    end[:-1] &= ~solid[1:] | begins[1:-1]
    starts, length = np.flatnonzero(start), np.flatnonzero(end) + 1
    length -= starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    first = np.cumsum(length) - length
    value = _letters()[raw[solid]]
    value *= _powers(int(length.max()))[np.arange(len(value)) - np.repeat(first, length)]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), np.searchsorted(starts, cuts)


def shingle_sets(raw: np.ndarray, cuts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each text in ``raw`` the sorted distinct hashes of all runs of ``width`` words; of the whole
    sequence if it is shorter."""
    words, first = _word_hashes(raw, cuts)
    count = np.diff(first)
    each = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros(at[-1], np.uint64)
    if len(words) >= width:
        total = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            total = total * _STEP + words[i : len(words) - width + 1 + i]
        left = np.repeat(first[1:], count)[: len(total)] - np.arange(len(total))
        out[np.repeat(count >= width, each)] = total[left >= width]
    for k in np.flatnonzero((count > 0) & (count < width)).tolist():
        total = _U(count[k])
        with np.errstate(over="ignore"):
            for w in words[first[k] : first[k + 1]]:
                total = total * _STEP + w
        out[at[k]] = total
    out = mix(out)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][each > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def shingled(column, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets) for runs of rows of an Arrow column of texts, about ``chunk`` bytes at a time."""
    import pyarrow as pa

    held = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = held.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(held):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + chunk, "right")) - 1)
        yield row, *shingle_sets(raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


def sets_in(column) -> Iterator[np.ndarray]:
    """The shingle set of every row."""
    for _, hashes, offsets in shingled(column):
        yield from np.split(hashes, offsets[1:-1])


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), width)[0]


def least_overlap(a, b):
    """The least intersection of linked sets of sizes a and b: 100 i >= 75 (a + b - i)."""
    return -((-NUM * (a + b)) // (DEN + NUM))


def names_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set."""
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=run[1:])
    return mix(run[offsets[1:]] - run[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


class CountRTree:
    """Points of counts under boxes; finds the points whose bound allows an overlap that links."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 16, fan: int = 8):
        spread = points.astype(np.int64).var(axis=0)
        order = np.lexsort((points[:, int(spread.argmax())], sizes))
        self.points, self.sizes, self.order = points[order], sizes[order], order
        cuts = np.arange(0, len(order), leaf)
        top, low, high = np.maximum.reduceat(self.points, cuts), np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts)
        self.levels = [(top, low, high, leaf)]
        while len(top) > 1:
            cuts = np.arange(0, len(top), fan)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high, fan))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions, in the given order, of all points that may link."""
        at = np.zeros(1, np.int64)
        for top, low, high, width in reversed(self.levels):
            sized = (NUM * low[at] <= DEN * size) & (NUM * size <= DEN * high[at])
            at = at[sized]
            bound = np.minimum(top[at], point).sum(axis=1, dtype=np.int64)
            at = at[bound >= least_overlap(size, np.maximum(low[at], -(-NUM * size // DEN)))]
            below = (at[:, None] * width + np.arange(width)).ravel()
            count = len(self.points) if top is self.levels[0][0] else len(self.levels[self._index(top) - 1][0])
            at = below[below < count]
        at = at[np.minimum(self.points[at], point).sum(axis=1, dtype=np.int64) >= least_overlap(size, self.sizes[at])]
        return self.order[at]

    def _index(self, top: np.ndarray) -> int:
        return next(i for i, level in enumerate(self.levels) if level[0] is top)


def groups_for(size: int) -> int:
    """Hash groups of a point, a power of four times ``GROUPS``: about as many as the set has members, at most four a group."""
    groups = GROUPS
    while size >= 4 * groups:
        groups *= 4
    return groups


def counts_of(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((s >> _U(17)).astype(np.int64) & (groups - 1), minlength=groups).astype(np.int32)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """The same sets counted in fewer groups."""
    return points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.int32)


class Points:
    """The points of many sets, kept by their number of groups."""

    def __init__(self, counts: list[bytes], sizes: np.ndarray):
        self.sizes = sizes
        self.width = np.array([len(c) for c in counts], np.int64)
        self.row = np.zeros(len(counts), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for groups in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == groups)
            self.row[own] = np.arange(len(own))
            self.of[groups] = np.frombuffer(b"".join([counts[i] for i in own.tolist()]), np.uint8).reshape(len(own), groups)

    def at(self, which: np.ndarray, groups: int, level: int) -> np.ndarray:
        """Points of sets that are counted in ``groups``, folded to ``level``; a count that did not fit bounds nothing."""
        points = self.of[groups][self.row[which]].astype(np.int32)
        points[points == 255] = 2**20
        return folded(points, level)

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most that the sets of each pair can share."""
        out = np.zeros(len(a), np.int64)
        kind = self.width[a] * (1 << 32) + self.width[b]
        for k in np.unique(kind).tolist():
            pairs, wide, other = np.flatnonzero(kind == k), k >> 32, k & 0xFFFFFFFF
            level = min(wide, other)
            step = max(1, (1 << 20) // max(wide, other))
            for i in range(0, len(pairs), step):
                own = pairs[i : i + step]
                out[own] = np.minimum(self.at(a[own], wide, level), self.at(b[own], other, level)).sum(axis=1, dtype=np.int64)
        return out

    def sized(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs whose sizes allow a link."""
        return (NUM * self.sizes[a] <= DEN * self.sizes[b]) & (NUM * self.sizes[b] <= DEN * self.sizes[a])

    def near(self, members: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a, b) of members that may link, each with at least one asked one, by R-trees over the members' points.

        Points of each number of groups have a tree; a set asks its own and, at the coarser of both widths, the next on either
        side, since linked sizes differ by a third at most.
        """
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        width = self.width[members]
        for groups in np.unique(width[asked]).tolist():
            mine = members[asked & (width == groups)]
            for other in (groups // 4, groups, groups * 4):
                theirs = members[width == other]
                if len(theirs):
                    level = min(groups, other)
                    tree = CountRTree(self.at(theirs, other, level), self.sizes[theirs])
                    for i, point in zip(mine.tolist(), self.at(mine, groups, level)):
                        found = theirs[tree.search(point, int(self.sizes[i]))]
                        a.append(np.full(len(found), i))
                        b.append(found)
        return np.concatenate(a), np.concatenate(b)


def links_in_block(sets: list[np.ndarray], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets; ``known`` names components that need no more links inside."""
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.stack([counts_of(s) for s in sets])
    component = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    tree, out = CountRTree(points, sizes), []
    for i in np.argsort(sizes, kind="stable").tolist():
        near = tree.search(points[i], int(sizes[i]))
        near = near[component[near] != component[i]]
        while len(near):
            j = int(near[0])
            near = near[1:]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if DEN * both >= NUM * (sizes[i] + sizes[j] - both):
                out.append((i, j))
                component[component == component[j]] = component[i]
                near = near[component[near] != component[i]]
    return out


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, the number of shingles and the set's name per document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, hashes, offsets in shingled(batch.column(2)):
                cols = [pa.array(c, pa.int64()) for c in (np.diff(offsets), names_of(hashes, offsets))]
                some = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(1), *cols], ["doc_id", "hash", "n", "node"])

    return docs.select("doc_id", _text_hash(), "text").mapInArrow(run, "doc_id long, hash long, n long, node long")


def _text_hash():
    return F.xxhash64("text").alias("hash")


def frequent_shingles(docs: DataFrame, share: float = SAMPLE_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, estimated number of documents) of shingles met often in a sample, for the order and the split only."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, hashes, _ in shingled(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["h"])

    drawn = docs.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(2**30)) < F.lit(share * 2**30)).select("text").distinct()
    often = drawn.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= SAMPLE_OFTEN)
    top = often.orderBy(F.col("count").desc(), "h").limit(MOST_FREQUENT).toArrow()
    hashes, count = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy() / share
    order = np.argsort(hashes)
    return hashes[order], count[order]


def _blocks(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int, split: int = SPLIT_ENTRIES) -> DataFrame:
    """(block, chunk, m, lo, hi, whole, members): sets that share a leading shingle and whose sizes allow a link, each
    membership once; ``whole`` if the block has one chunk, lo and hi the sizes in it."""
    frequent, number = frequent
    hot = np.flatnonzero(number > split)
    parts = np.ones(len(frequent) + 1, np.int64)
    parts[hot] = -(-number[hot] // split).astype(np.int64)
    hot_tags = np.unique((frequent[hot] >> _U(32)).astype(np.uint32))

    def leading(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            node, size, owner, heads, salts = [], [], [], [], []
            for _, hashes, offsets in shingled(batch.column(0)):
                where = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
                unusual = frequent[where] != hashes if len(frequent) else np.ones(len(hashes), bool)
                split_in = parts[np.where(unusual, len(frequent), where)]
                for name, a, b in zip(names_of(hashes, offsets).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    if b > a and name not in seen:
                        seen.add(name)
                        rare = unusual[a:b]
                        order = np.concatenate([np.flatnonzero(rare), np.flatnonzero(~rare)])[: b - a - (-(-NUM * (b - a) // DEN)) + 1] + a
                        owner.append(np.full(len(order), len(node), np.uint32))
                        heads.append(hashes[order])
                        salts.append(np.full(len(order), name) % split_in[order])
                        node.append(name)
                        size.append(b - a)
            if not node:
                continue
            head, owner_, salt = np.concatenate(heads), np.concatenate(owner), np.concatenate(salts)
            bucket = ((head + salt.astype(np.uint64) * _U(7919)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            names, sizes = np.array(node, np.int64), np.array(size, np.uint32)
            out: tuple[list, ...] = ([], [], [], [], [])
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[b] : cuts[b + 1]]
                used, at = np.unique(owner_[own], return_inverse=True)
                tags = (head[own] >> _U(32)).astype(np.uint32)
                for c, v in zip(out, (b, tags.tobytes(), at.astype(np.uint32).tobytes(), names[used].tobytes(), sizes[used].tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["bucket", "tags", "at", "names", "sizes"])

    def meet(group):
        import pyarrow as pa

        tags, names, sizes = [], [], []
        for row in group.to_batches():
            for t, a, nm, sz in zip(*[row.column(k) for k in ("tags", "at", "names", "sizes")]):
                at = np.frombuffer(a.as_py(), np.uint32)
                tags.append(np.frombuffer(t.as_py(), np.uint32))
                names.append(np.frombuffer(nm.as_py(), np.int64)[at])
                sizes.append(np.frombuffer(sz.as_py(), np.uint32)[at])
        bucket = group.column("bucket")[0].as_py()
        tag, name, size = np.concatenate(tags), np.concatenate(names), np.concatenate(sizes).astype(np.int64)
        del tags, names, sizes, group
        order = np.argsort(tag, kind="stable")
        again = np.diff(tag[order], prepend=tag[order[:1]] ^ 1) == 0
        own = order[again | np.append(again[1:], False) | np.isin(tag[order], hot_tags)]
        own = own[np.lexsort((name[own], size[own], tag[own]))]
        tag, name, size = tag[own], name[own], size[own]
        fresh = np.ones(len(tag), bool)
        fresh[1:] = (tag[1:] != tag[:-1]) | (name[1:] != name[:-1])
        tag, name, size = tag[fresh], name[fresh], size[fresh]
        cut = np.ones(len(tag), bool)
        cut[1:] = (tag[1:] != tag[:-1]) | (NUM * size[1:] > DEN * size[:-1])
        starts = np.flatnonzero(cut)
        length = np.diff(np.append(starts, len(tag)))
        code = np.append(np.uint64(0), np.cumsum(mix(name.view(np.uint64)), dtype=np.uint64))
        keys = mix(code[starts + length] - code[starts] + length.astype(np.uint64)).view(np.int64)
        split_ = np.isin(tag[starts], hot_tags) if len(starts) else np.zeros(0, bool)
        keys[split_] = mix(tag[starts[split_]].astype(np.uint64)).view(np.int64)  # one block over all buckets
        some = np.flatnonzero((length > 1) & ~split_)
        some = np.concatenate([some[np.unique(keys[some], return_index=True)[1]], np.flatnonzero(split_)])
        weight = np.append(0, np.cumsum(size))
        rows: tuple[list, ...] = ([], [], [], [])
        for key, a, n, parted in zip(keys[some].tolist(), starts[some].tolist(), length[some].tolist(), split_[some].tolist()):
            if n <= BLOCK and weight[a + n] - weight[a] <= BLOCK_SHINGLES:
                ends = [a, a + n]
            else:
                run = np.arange(n) // BLOCK + (weight[a + 1 : a + n + 1] - weight[a]) // BLOCK_SHINGLES
                ends = [a, *(np.flatnonzero(np.diff(run)) + 1 + a).tolist(), a + n]
            whole = len(ends) == 2 and not parted
            for i, (x, y) in enumerate(zip(ends, ends[1:])):
                for c, v in zip(rows, (key, (bucket << 32) + (starts_at(a) if parted else 0) + i, whole, (x, y))):
                    c.append(v)
        spans = np.array(rows[3], np.int64).reshape(-1, 2)
        take = np.repeat(spans[:, 0], spans[:, 1] - spans[:, 0]) + _within(spans[:, 1] - spans[:, 0])
        at = np.concatenate([[0], np.cumsum(spans[:, 1] - spans[:, 0])]).astype(np.int32)
        chunk = [0 if w else c for c, w in zip(rows[1], rows[2])]
        members = pa.ListArray.from_arrays(pa.array(at), pa.array(name[take]))
        return pa.table({
            "block": pa.array(rows[0], pa.int64()), "chunk": pa.array(chunk, pa.int64()), "m": pa.array(spans[:, 1] - spans[:, 0]), "lo": pa.array(size[spans[:, 0]]), "hi": pa.array(size[spans[:, 1] - 1]),
            "whole": pa.array(rows[2], pa.bool_()), "members": members,
        })

    starts_at = lambda a: a << 8  # noqa: E731  # chunks of a block that is split over buckets have names of their own
    dealt = docs.select("text").mapInArrow(leading, "bucket long, tags binary, at binary, names binary, sizes binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "block long, chunk long, m long, lo long, hi long, whole boolean, members array<long>").dropDuplicates(["block", "chunk"])


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _bundles(weight: int) -> int:
    return max(12, -(-weight // BUNDLE_BYTES))


def _runs(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each run of equal keys."""
    order = np.lexsort(keys)
    new = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        new |= np.diff(k[order]) != 0
    yield from np.split(order, np.flatnonzero(new) + 1) if len(order) else ()


def _verified(rows: DataFrame) -> DataFrame:
    """Links (a, b) of chunks given as rows (bundle, block, chunk, node, text)."""

    def run(group):
        import pyarrow as pa

        a, b = [], []
        node, texts = group.column("node").to_numpy(), group.column("text").combine_chunks()
        for own in _runs(group.column("chunk").to_numpy(), group.column("block").to_numpy()):
            pairs = links_in_block(list(sets_in(texts.take(pa.array(own)))))
            a += [node[own[i]] for i, _ in pairs]
            b += [node[own[j]] for _, j in pairs]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("bundle", "block", "chunk", "node", "text").groupBy("bundle").applyInArrow(run, "a long, b long")


def _open_rows(chunks: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(home, block, chunk, node, label, asked) of the blocks with more than one component; ``home`` is the least of them.

    Members outside the commonest component are asked, and visit the other chunks of their block where sizes allow a link.
    """
    rows = chunks.select("block", "chunk", F.explode("members").alias("node")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by = rows.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
    state = by.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.min("label").alias("home"), F.count(F.lit(1)).alias("k")).where("k > 1")
    of_chunk = chunks.select("block", "chunk", "whole").join(state.select("block", "common", "home"), "block")
    own = rows.join(of_chunk, ["block", "chunk"]).select("home", "block", "chunk", "node", "label", (F.col("label") != F.col("common")).alias("asked"), "whole")
    visit = own.where("asked and not whole").drop("chunk").join(sizes, "node").join(chunks.where("not whole").select("block", "chunk", "lo", "hi"), "block")
    visit = visit.where(f"{NUM} * lo <= {DEN} * size and {NUM} * size <= {DEN} * hi")
    columns = ("home", "block", "chunk", "node", "label", "asked")
    return own.select(*columns).unionByName(visit.select(*columns)).distinct()


def _survivors(rows: DataFrame, points: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) across labels that the R-tree cannot rule out, from memberships and points (node, size, counts).

    ``nearest`` keeps of each set only the pair with the highest bound.
    """

    def run(own, points):
        import pyarrow as pa

        if not (own.num_rows and points.num_rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        names = points.column("node").to_numpy()
        order = np.argsort(names)
        names = names[order]
        held = Points(points.column("counts").take(pa.array(order)).to_pylist(), points.column("size").to_numpy()[order])
        at = np.searchsorted(names, own.column("node").to_numpy())
        label = np.zeros(len(names), np.int64)
        label[at] = own.column("label").to_numpy()
        asked = own.column("asked").combine_chunks().to_numpy(zero_copy_only=False)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for run_ in _runs(own.column("chunk").to_numpy(), own.column("block").to_numpy()):
            if len(run_) <= LEAF:  # one leaf
                x, y = np.triu_indices(len(run_), 1)
                left.append(at[run_[x]])
                right.append(at[run_[y]])
            else:
                a, b = held.near(at[run_], asked[run_])
                other = label[a] != label[b]
                left.append(a[other])
                right.append(b[other])
        a, b = np.concatenate(left), np.concatenate(right)
        other = (label[a] != label[b]) & held.sized(a, b)
        low, high = np.minimum(a[other], b[other]), np.maximum(a[other], b[other])
        a, b = np.divmod(np.unique(low * len(names) + high), len(names))
        bound = held.bounds(a, b)
        fits = bound >= least_overlap(held.sizes[a], held.sizes[b])
        a, b, bound = a[fits], b[fits], bound[fits]
        if nearest:
            share = bound / (held.sizes[a] + held.sizes[b])
            ends, pair = np.concatenate([a, b]), np.concatenate([np.arange(len(a))] * 2)
            order = np.lexsort((-share[pair], ends))
            best = np.unique(pair[order][np.unique(ends[order], return_index=True)[1]])
            a, b = a[best], b[best]
        one, two = names[a], names[b]
        return pa.table({"a": pa.array(np.minimum(one, two), pa.int64()), "b": pa.array(np.maximum(one, two), pa.int64())})

    own = rows.select("bundle", "block", "chunk", "node", "label", "asked")
    sent = own.select(F.col("bundle").alias("to"), F.col("node").alias("of")).distinct()
    sent = sent.join(points, sent["of"] == points["node"]).select("to", "node", "size", "counts")
    return own.groupBy("bundle").cogroup(sent.groupBy("to")).applyInArrow(run, "a long, b long")


def _verified_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for s, t in zip(sets_in(batch.column(2)), sets_in(batch.column(3))):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node on an edge (a, b); the label is the component's least node.

    Alternates large and small stars; each round is a stored table, and the number of rounds grows with the logarithm.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = lambda: tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = state()
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "stars")
        now = state()
        if now == last:
            break
        last = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops.select("node", F.col("node").alias("label")))


def sets_of(docs: DataFrame, nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, size, counts, text) of the chosen nodes, by one document for each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, hashes, offsets in shingled(batch.column(1)):
                counts = [np.minimum(counts_of(s, groups_for(len(s))), 255).astype(np.uint8).tobytes() for s in np.split(hashes, offsets[1:-1])]
                some = batch.slice(row, len(counts))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(offsets)), pa.array(counts, pa.binary()), some.column(1)], ["node", "size", "counts", "text"])

    first = nodes.where("n > 0").groupBy("node").agg(F.min(F.struct("hash", "doc_id")).alias("x"), F.count(F.lit(1)).alias("rows"))
    first = first.join(chosen, "node").select("node", F.col("x.hash").alias("hash"), F.col("x.doc_id").alias("id"))
    rows = docs.select("doc_id", _text_hash(), "text")
    texts = rows.join(first, (rows["hash"] == first["hash"]) & rows["doc_id"].eqNullSafe(first["id"])).select("node", "text")
    sets = texts.mapInArrow(run, "node long, size long, counts binary, text string")
    # a row that is repeated comes more than once
    repeated = nodes.where("n > 0").groupBy("doc_id", "hash").count().where("count > 1")
    return sets if repeated.isEmpty() else sets.dropDuplicates(["node"])


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, labels): the stored rows of ``nodes_of`` and the component (node, label) of every node with a link."""
    nodes = materialize(nodes_of(docs), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(12, -(-int(total * (DEN - NUM) / DEN) // BUCKET_ENTRIES))
    chunks = materialize(_blocks(docs, frequent_shingles(docs), buckets), "chunks")
    members = chunks.select("block", "chunk", "m", F.explode("members").alias("node"))
    sets = materialize(sets_of(docs, nodes, members.select("node").distinct()), "sets")
    held = sets.agg(F.sum(F.length("text")).alias("text"), F.avg(F.length("counts")).alias("point")).first()

    # every set in one chunk only: families of copies are joined here at the cost of one row a set
    pick = members.groupBy("node").agg(F.max(F.struct("m", "block", "chunk")).alias("best")).select("node", "best.block", "best.chunk")
    pick = materialize(pick, "picks")
    met = pick.join(pick.groupBy("block", "chunk").count().where("count > 1").select("block", "chunk"), ["block", "chunk"])
    met = met.withColumn("bundle", F.pmod(F.xxhash64("block", "chunk"), F.lit(_bundles(held["text"] or 0))))
    links = materialize(_verified(met.join(sets.select("node", "text"), "node")), "links")
    labels = materialize(connected_components(links), "labels")
    release(pick)

    points, sizes = sets.select("node", "size", "counts"), sets.select("node", "size")
    for last in [False] * NEAREST_ROUNDS + [True]:
        rows = materialize(_open_rows(chunks, labels, sizes), "rows")
        # a part of a home has a bounded number of bytes and of memberships
        weight = max((held["point"] or 0) + 64, BUNDLE_BYTES / BUNDLE_ROWS)
        homes = rows.groupBy("home").agg(F.ceil(F.count(F.lit(1)) * F.lit(weight) / F.lit(BUNDLE_BYTES)).alias("parts")).where("parts > 1")
        homes = materialize(homes, "homes")
        homes_ = F.broadcast(homes) if homes.count() <= MOST_BROADCAST else homes
        salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("block", "chunk"), F.col("parts"))).otherwise(0)
        bundled = rows.join(homes_, "home", "left").withColumn("bundle", F.pmod(F.xxhash64("home", salt), F.lit(_bundles(int(rows.count() * weight)))))
        pairs = materialize(_survivors(bundled, points, not last).distinct(), "survivors")
        links = materialize(_verified_pairs(pairs, sets), "links")
        if not links.isEmpty():
            stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = materialize(connected_components(stars.unionByName(links)), "labels")
        release(rows, pairs, homes)
    release(chunks, sets)
    return nodes, labels


def _components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, hash, n_shingles and the component's label of the rows with shingles."""
    some = nodes.where("n > 0").join(labels, "node", "left")
    return some.select("doc_id", "hash", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("label"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per document."""
    nodes, labels = labelled(docs)
    rows = materialize(_components(nodes, labels), "components")
    # a label's rows meet by partial minima, so a hot component sends one row from each task
    names = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = rows.join(names, "label").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(nodes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest id, and of such rows that with the least text hash.

    Rows are judged by their own texts: rows that share an id and nothing else stay apart.  Rows without an id take part and
    stay only where their component has no id at all; rows without a word stay.
    """
    nodes, labels = labelled(docs)
    rows = materialize(_components(nodes, labels), "components")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("x")
    kept = rows.groupBy("label").agg(best).select(F.col("x.doc_id").alias("id"), F.col("x.hash").alias("hash"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    same = lambda d: (F.col("_hash") == d["hash"]) & F.col("doc_id").eqNullSafe(d["id"])
    out = hashed.where(~wordless).join(kept, same(kept), "left_semi")
    repeated = nodes.where("n > 0").groupBy(F.col("doc_id").alias("id"), "hash").count().where("count > 1").drop("count")
    if not repeated.isEmpty():
        again = out.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "_hash"])
        out = out.join(repeated, same(repeated), "left_anti").unionByName(again)
    return out.select(*docs.columns).unionByName(docs.where(wordless))
