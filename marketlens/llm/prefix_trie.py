"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of ``BLOCK`` turns.  The digests of a block and of all blocks before it give a key of the prefix that
ends there, and conversations are grouped by these keys first: one row per conversation and block, not per turn.  Only
where a prefix goes on in several different blocks are the turns inside these blocks looked at, once per distinct block,
whatever the number of conversations behind it, and grouped by the turns they share.  Where it goes on in one block alone, all of that
block's turns have the members of the block, and nothing is grouped.

A node belongs to its smallest member, so a conversation owns the nodes from some depth down to its end.  A subtree's sum is then the
sum, over the members of its top, of all that each owns, less what the top's owner owns above it: two groupings by prefix
instead of a walk from the leaves, whatever the depth.

Turns are put in order by a range partitioning over (conversation, turn), so that a conversation of any length is spread over tasks; running values
over a conversation go in segments of ``SEGMENT`` rows.  Digests of turns are SHA-256, prefix keys have 128 bits, made
of two XORs of 64-bit hashes of them: safe against chance, not against someone who looks for collisions.

Rows without a conversation are left out.  A null role or text is empty, a null turn comes first, and equal turn numbers are taken in the order of
the digests of role and text; repeated rows are turns of their own.  Texts of any length are read where they lie and only their digests
travel.  Extra columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import materialize, release

BLOCK = 4
SEGMENT = 4096
ID_SPAN_BITS = 10
MOST_HOT = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame, stored: list[DataFrame]) -> DataFrame:
    """(conv_id, pos from 1, g, words) of every turn."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    g = F.unhex(F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256))
    words = F.size(F.regexp_extract_all(text("text"), F.lit(WORD), F.lit(0))).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", g.alias("g"), words.alias("words"))
    # the range partitioning reads its input twice
    rows = materialize(rows, "digests")
    stored.append(rows)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "g"]

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows:
                conv = batch.column(0).to_numpy()
                first = np.flatnonzero(np.append(conv[0] != last, conv[1:] != conv[:-1]))
                base = np.zeros(len(conv), np.int64)
                base[first] = first
                pos = np.arange(1, len(conv) + 1) - np.maximum.accumulate(base)
                if conv[0] == last:
                    pos[: first[0] if len(first) else len(conv)] += count
                last, count = conv[-1], int(pos[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(pos), batch.column(2), batch.column(3)], ["conv_id", "part", "pos", "g", "words"])

    turns = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "conv_id long, part int, pos long, g binary, words long"), "turns")
    stored.append(turns)
    # conversations that go over a border of partitions: two a partition at most
    counts = turns.groupBy("conv_id", "part").agg(F.max("pos").alias("n"))
    own = Window.partitionBy("conv_id")
    before = counts.withColumn("parts", F.count(F.lit(1)).over(own)).where("parts > 1")
    before = before.select("conv_id", "part", F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = turns.join(F.broadcast(before), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "g", "words")


def crc32_of_id(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): the first h turns of the family's first conversation before the own ones from h on.

    A family has at most ``2 * family - 1`` conversations, so what a head joins is bounded."""
    h = lambda: crc32_of_id("conv_id") % most
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", h())
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "g", "words")
    asked = convs.where("h > 0").select("conv_id", "h", F.expr(f"conv_id - conv_id % {family}").alias("base"))
    sizes = heads.groupBy("base").agg(F.max("pos").alias("there"))
    # a base that is absent or has fewer turns than h: own turns move up
    shifts = asked.join(sizes, "base", "left").select("conv_id", (F.col("h") - F.coalesce("there", F.lit(0))).alias("shift")).where("shift > 0")
    borrowed = asked.join(heads, "base").where("pos <= h").select("conv_id", "pos", "g", "words")
    kept = turns.where(F.col("pos") > h()).join(shifts, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "g", "words")
    return convs.select("conv_id"), borrowed.unionByName(kept)


def running(df: DataFrame, key: str, order: str, fold: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each new column an aggregate (``sum``, ``bit_xor``) of another over the key's rows before this one, null where there are none.

    ``order`` counts rows of a key; segments of it are folded first, so that no window holds more than a segment's rows, or a
    key's segments."""
    df = df.withColumn("_seg", F.expr(f"{order} div {SEGMENT}"))
    totals = df.groupBy(key, "_seg").agg(*[F.expr(f"{how}({c})").alias(f"_{out}") for out, (how, c) in fold.items()])
    earlier = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_seg", *[F.expr(f"{how}(_{out})").over(earlier).alias(f"_{out}") for out, (how, _) in fold.items()]).where("_seg > 0")
    inside = Window.partitionBy(key, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({out: F.expr(f"{how}({c})").over(inside) for out, (how, c) in fold.items()}).join(carried, [key, "_seg"], "left")
    both = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    joined = {out: both[how](F.coalesce(out, F.lit(0).cast("long")), F.coalesce(f"_{out}", F.lit(0).cast("long"))) for out, (how, _) in fold.items()}
    return df.withColumns(joined).drop("_seg", *[f"_{out}" for out in fold])


def blocks_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation and block: the prefix keys before it (``a``, ``b``), at each turn's end (arrays ``ka``, ``kb``)
    and at its own (``pa``, ``pb``), words by turn; besides a row with no turns for the root."""
    turns = turns.withColumn("block", F.expr(f"(pos - 1) div {BLOCK}"))
    held = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "g", "words"))).alias("t"))
    upto = F.sequence(F.lit(1), F.size("t"))
    key = lambda salt: F.transform(upto, lambda o: F.xxhash64(F.lit(salt), F.col("block"), F.slice(F.col("t.g"), F.lit(1), o)))
    held = held.select("conv_id", "block", key(1).alias("ha"), key(2).alias("hb"), F.col("t.words").alias("words"))
    held = held.withColumns({"ea": F.element_at("ha", -1), "eb": F.element_at("hb", -1)})
    held = running(held, "conv_id", "block", {"a": ("bit_xor", "ea"), "b": ("bit_xor", "eb")})
    x = lambda pre, c: F.transform(c, lambda h: h.bitwiseXOR(F.col(pre)))
    held = held.select("conv_id", "block", "a", "b", x("a", "ha").alias("ka"), x("b", "hb").alias("kb"), "words", F.col("a").bitwiseXOR(F.col("ea")).alias("pa"), F.col("b").bitwiseXOR(F.col("eb")).alias("pb"))
    none, zero = F.array().cast("array<long>"), F.lit(0).cast("long")
    root = convs.select("conv_id", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), none.alias("ka"), none.alias("kb"), none.alias("words"), zero.alias("pa"), zero.alias("pb"))
    return held.unionByName(root)


def distinct_blocks(blocks: DataFrame, stored: list[DataFrame]) -> DataFrame:
    """One row per prefix that ends at a block: its members, the smallest of them, and whether it is all that follows the prefix before."""
    one = blocks.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"), *[F.any_value(c).alias(c) for c in ("block", "a", "b", "ka", "kb", "words")])
    one = materialize(one, "blocks-once")
    stored.append(one)
    alone = one.where("block >= 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.min("pa").alias("pa"), F.min("pb").alias("pb")).where("k = 1")
    return one.join(alone.select("pa", "pb", F.lit(True).alias("straight")), ["pa", "pb"], "left").withColumn("straight", F.coalesce("straight", F.lit(False)))


def by_turn(blocks: DataFrame, fold: list[Column], *more: str) -> DataFrame:
    """Nodes inside the given distinct blocks, (ka, kb) and folded measures: grouped only where blocks diverge."""
    at = lambda c: F.col(c)[F.col("o") - 1]
    before = lambda pre, c: F.when(F.col("o") == 1, F.col(pre)).otherwise(F.col(c)[F.greatest(F.col("o") - 2, F.lit(0))])
    rows = blocks.where("block >= 0").withColumn("o", F.explode(F.sequence(F.lit(1), F.size("ka"))))
    rows = rows.select(at("ka").alias("ka"), at("kb").alias("kb"), before("a", "ka").alias("up_a"), before("b", "kb").alias("up_b"), (F.col("block") * BLOCK + F.col("o")).alias("depth"), at("words").alias("words"), "straight", *more)
    kept = ("up_a", "up_b", "depth", "words")
    # any member has them, as they go with the key; minima stay in a hash aggregate
    found = rows.where("not straight").groupBy("ka", "kb").agg(*[F.min(c).alias(c) for c in kept], *fold)
    zero = F.lit(0).cast("long")
    nothing = F.lit(None).cast("long")
    root = blocks.where("block < 0").select(zero.alias("ka"), zero.alias("kb"), nothing.alias("up_a"), nothing.alias("up_b"), zero.alias("depth"), zero.alias("words"), *more)
    return found.unionByName(rows.where("straight").drop("straight")).unionByName(root)


def with_parents(nodes: DataFrame, stored: list[DataFrame]) -> DataFrame:
    """Adds ``n_children`` and ``parent``, the parent's owner.

    A parent of very many nodes would draw them all into one task, so these parents are broadcast: each has over a
    ``MOST_HOT``-th of the nodes as children, so there are fewer than ``MOST_HOT``."""
    kids = nodes.where("depth > 0").groupBy(F.col("up_a").alias("ka"), F.col("up_b").alias("kb")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = materialize(nodes.join(kids, ["ka", "kb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes-counted")
    stored.append(counted)
    most = max(1000, counted.count() // MOST_HOT)
    parents = counted.where("n_children > 0").select(F.col("ka").alias("up_a"), F.col("kb").alias("up_b"), F.col("owner").alias("parent"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > most).drop("n_children"))
    up = counted.join(hot.withColumnRenamed("parent", "hot"), ["up_a", "up_b"], "left")
    # the others look theirs up by key
    cold = up.where("hot is null and depth > 0").drop("hot").join(parents.where(F.col("n_children") <= most).drop("n_children"), ["up_a", "up_b"])
    return up.where("hot is not null or depth = 0").withColumnRenamed("hot", "parent").unionByName(cold)


def end_digests(blocks: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256): the ids of the conversations that end at a node, ascending, joined by commas.

    Ids of one span of numbers are joined first, a bounded string each; the spans of a node then flow in order through one hash."""
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct("pa", "pb"), "block").alias("k")).select("conv_id", "k.pa", "k.pb")
    # a conversation ends once, so a span holds no more ids than its width
    spans = last.groupBy("pa", "pb", F.shiftright("conv_id", ID_SPAN_BITS).alias("span")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    spans = spans.select("pa", "pb", "span", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(*[batch.column(c).to_pylist() for c in ("pa", "pb", "ids")]):
                if (a, b) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("ka", "kb", "ends_sha256"), d)) for d in done], schema)
            done = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("ka", "kb", "ends_sha256"), (*key, state.hexdigest())))], schema)

    import pyarrow as pa

    schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("ends_sha256", pa.string())])
    return spans.repartition("pa", "pb").sortWithinPartitions("pa", "pb", "span").mapInArrow(digest, "ka long, kb long, ends_sha256 string")


def build(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    stored: list[DataFrame] = []
    blocks = materialize(blocks_of(*rebuilt(numbered_turns(conversations, stored))), "blocks")
    once = materialize(distinct_blocks(blocks, stored), "blocks-distinct")
    nodes = by_turn(once, [F.sum("n").alias("n"), F.min("owner").alias("owner")], "n", "owner")
    nodes = materialize(with_parents(nodes, stored), "nodes")
    # what each conversation owns: its saved tokens, and the leaf at its end, if that is one
    saved = (F.col("n") - 1) * F.col("words")
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum(saved).alias("all_saved"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("all_leaves"))
    passing = blocks.select("conv_id", "pa", "pb").join(owned, "conv_id").groupBy("pa", "pb").agg(F.sum("all_saved").alias("all_saved"), F.sum("all_leaves").alias("all_leaves"))
    below = by_turn(once.drop("n", "owner").join(passing, ["pa", "pb"]), [F.sum(c).alias(c) for c in ("all_saved", "all_leaves")], "all_saved", "all_leaves").select("ka", "kb", "all_saved", "all_leaves")
    above = running(nodes.withColumn("saved", saved), "owner", "depth", {"own_above": ("sum", "saved")})
    out = above.join(below, ["ka", "kb"]).join(end_digests(blocks), ["ka", "kb"], "left")
    none = hashlib.sha256(b"").hexdigest()
    out = materialize(out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("all_leaves").cast("long").alias("n_leaves"),
        (F.col("all_saved") - F.col("own_above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    ), "trie")
    release(*stored, blocks, once, nodes)
    return out
