"""Shards of near-equal bytes by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, id, row number), so equal texts lie together.  A sample in which a record's chance is
in proportion to its size gives quantile boundaries of that order; each range is then summed exactly, and ranges that turn
out overfull are subdivided by splitters drawn from their own records until none is: between texts first, and inside a text
only where one text alone overfills a range, by ids and row numbers.  Exact running sizes inside the ranges, and range totals before them, give every record
its place: shard = floor(shards * middle of the record / all bytes).  A group of equal texts stays in one shard unless it
weighs over ``GROUP_SHARE`` of a shard.

Nulls: a null text weighs the fixed 16 bytes and counts as empty; a null id sorts first.  Repeated rows are placed
one after another, split by their row numbers where they overfill a range.  Texts of any length are weighed whole.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import materialize

OVERHEAD = 16
RANGES_PER_SHARD = 8
SAMPLES_PER_RANGE = 32
GROUP_SHARE = 0.05
LOWEST = -(2**63) + 1
MOST_ROUNDS = 40


def _unit(*cols) -> Column:
    """A number in [0, 1) from a hash, the same on every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(2**53)) / F.lit(float(2**53))


KEY = ("h", "i", "k")


def range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at most the row's key: a binary search in constant arrays."""
    if not splitters:
        return F.lit(0)
    steps = len(splitters).bit_length()
    of = [F.split(F.lit(",".join(str(s[n]) for s in splitters)), ",").cast("array<bigint>") for n in range(3)]

    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        open_ = at["lo"] < at["hi"]
        h, i, k = (F.get(x, mid) for x in of)
        at_most = (h < F.col("h")) | (h == F.col("h")) & ((i < F.col("i")) | (i == F.col("i")) & (k <= F.col("k")))
        right = open_ & at_most
        return F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(at["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]


def _quantiles(sample: list, weight_floor: float, pieces: int) -> list:
    """Keys at the weighted quantiles 1/pieces .. (pieces-1)/pieces of a bounded sample."""
    sample = sorted((tuple(row[c] for c in KEY), max(float(row["size"]), weight_floor)) for row in sample)
    total, run, out = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        run += weight
        while len(out) < pieces - 1 and run >= total * (len(out) + 1) / pieces:
            out.append(key)
    return out


def splitters_of(records: DataFrame, total: int, ranges: int) -> list[tuple[int, int, int]]:
    """Boundaries of about equal bytes; the sample has ``ranges * SAMPLES_PER_RANGE`` records at the expected most."""
    unit = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    chance = lambda salt: _unit(F.lit(salt), *KEY) < F.col("size") / F.lit(unit)
    text_start = lambda keys: [(h, LOWEST, LOWEST) for h, _, _ in keys]
    drawn = records.where(chance(17)).select(*KEY, "size").collect()
    splits = sorted(set(text_start(_quantiles(drawn, unit, ranges))))
    target, salt = total / ranges, 18
    while True:
        sums = records.groupBy(range_of(splits).alias("r")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        overfull = {row["r"]: row for row in sums.where((F.col("b") > 2 * target) & (F.col("n") > 1)).collect()}
        if not overfull:
            return splits
        inside = records.withColumn("r", range_of(splits)).where(F.col("r").isin(*overfull))
        drawn = inside.where(chance(salt)).select("r", *KEY, "size").collect()
        more = set(splits)
        for r, row in overfull.items():
            found = _quantiles([x for x in drawn if x["r"] == r], unit, int(row["b"] // target) + 1)
            # a range of several texts is cut between texts: at the start of a drawn one and at that of the last
            more.update(found if row["low"] == row["high"] else text_start([*found, (row["high"], 0, 0)]))
        salt += 1
        if len(more) == len(splits) or salt > 18 + MOST_ROUNDS:
            return sorted(more)
        splits = sorted(more)


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per record: id, size, text_crc32, shard 0..shards-1 and slot, gapless from 0 in each shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("i"),
        F.monotonically_increasing_id().alias("k"),
    )
    records = materialize(records, "shard-records")
    total = records.agg(F.sum("size")).first()[0] or 0
    splits = splitters_of(records, total, shards * RANGES_PER_SHARD)
    ranged = records.withColumn("r", range_of(splits))

    # at most as many rows as ranges, whatever the input
    sums = ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("r", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"))

    order = Window.partitionBy("r").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("size").over(order)).withColumn("nth", F.count(F.lit(1)).over(order))
    group = Window.partitionBy("r", "h")
    placed = placed.withColumn("g_size", F.sum("size").over(group)).withColumn("g_from", F.min(F.col("upto") - F.col("size")).over(group))
    placed = placed.join(F.broadcast(sums), "r")
    whole = F.col("g_size") <= F.lit(GROUP_SHARE * total / shards)
    twice = 2 * F.col("base_b") + F.when(whole, 2 * F.col("g_from") + F.col("g_size")).otherwise(2 * F.col("upto") - F.col("size"))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(twice * shards / F.lit(float(max(2 * total, 1))))).cast("int"))
    placed = materialize(placed.select("id", "size", "crc", "shard", (F.col("base_n") + F.col("nth") - 1).alias("at")), "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).alias("slot"))
