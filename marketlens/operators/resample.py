"""Resampling and sensitivity sweeps: replicates and scenarios are group keys of one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cumulative shares of Poisson(1) draws of 0 to 5 among 10,000.
POISSON_CUTS = (3679, 7358, 9197, 9810, 9963, 9994)
CHUNK = 1000
BLOCK_ROWS = 512
MOST_HELD = 20_000_000


def hashed(row: Column, replicate: Column) -> Column:
    """An integer in 0..9999 from plain integer arithmetic, the same in every engine."""
    x = (row * 7919 + replicate * 104_729 + 12_345) % 2_147_483_647
    x = (x * 48_271) % 2_147_483_647
    return ((x * 48_271) % 2_147_483_647) % 10_000


def poisson_weight(h: Column) -> Column:
    """Poisson(1) draws from 0..9999 by its cumulative shares."""
    out = F.when(h < POISSON_CUTS[0], 0)
    for k, cut in enumerate(POISSON_CUTS[1:], 1):
        out = out.when(h < cut, k)
    return out.otherwise(len(POISSON_CUTS))


def _draws(rows: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Poisson weights of each row in each replicate, the same as ``poisson_weight(hashed(row, replicate))``."""
    x = (rows[:, None] * 7919 + reps * 104_729 + 12_345) % 2_147_483_647
    x = (x * 48_271) % 2_147_483_647
    return np.searchsorted(POISSON_CUTS, (x * 48_271) % 2_147_483_647 % 10_000, side="right").astype(np.float64)


def _flat_schema(df: DataFrame, by: list[str]) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "_chunk int, _sums array<double>"])


def _merged(parts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Adds up the partial arrays of each group and chunk of replicates: ``by``, rep, one column a sum."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["_sums"].to_list()), axis=0).reshape(len(names), -1)
        out = pdf[by].iloc[[0] * total.shape[1]].reset_index(drop=True)
        return out.assign(rep=int(pdf["_chunk"].iloc[0]) * CHUNK + np.arange(total.shape[1]), **dict(zip(names, total)))

    schema = ", ".join([*(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in by), "rep long", *(f"`{c}` double" for c in names)])
    return parts.groupBy(*by, "_chunk").applyInPandas(merge, schema)


def replicate_sums(df: DataFrame, row: str, sums: dict[str, Column], n: int, by: list[str]) -> DataFrame:
    """Weighted sums of the given columns in each of ``n`` Poisson bootstrap replicates, per group: ``by``, rep, one column a sum.

    No row is copied per replicate: each task keeps one array of all replicates' sums a group, and these arrays are all that is
    shuffled, so the shuffle grows with tasks, groups and replicates and not with rows.  A null adds nothing.
    """
    held = df.select(*by, F.col(row).cast("long").alias("_n"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{k}") for k, c in sums.items()])
    width = len(sums)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        state: dict[tuple, np.ndarray] = {}

        def flush():
            keys, chunks, arrays = [], [], []
            for key, total in state.items():
                for c in range(0, n, CHUNK):
                    keys.append(key)
                    chunks.append(c // CHUNK)
                    arrays.append(total[:, c : c + CHUNK].ravel())
            state.clear()
            columns = [pa.array([k[i] for k in keys], kinds[i]) for i in range(len(by))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(chunks, pa.int32()), pa.array(arrays, pa.list_(pa.float64()))], [*by, "_chunk", "_sums"])

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(by))]
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in range(len(by))])):
                groups.setdefault(key, []).append(i)
            rows = batch.column(len(by)).to_numpy(zero_copy_only=False)
            values = np.stack([batch.column(len(by) + 1 + j).to_numpy(zero_copy_only=False) for j in range(width)])
            for key, own in groups.items():
                total = state.setdefault(key, np.zeros((width, n)))
                for c in range(0, n, CHUNK):
                    reps = np.arange(c, min(n, c + CHUNK))
                    for i in range(0, len(own), BLOCK_ROWS):
                        some = own[i : i + BLOCK_ROWS]
                        total[:, c : c + CHUNK] += values[:, some] @ _draws(rows[some], reps)
                if len(state) * width * n > MOST_HELD:
                    yield flush()
        if state:
            yield flush()

    return _merged(held.mapInArrow(run, _flat_schema(held, by)), by, list(sums))


def resampled(df: DataFrame, row: str, sums: dict[str, Column], statistics: dict[str, Column], n: int, by: list[str]) -> DataFrame:
    """Any statistic that is an expression over weighted sums, in each replicate: means, gaps, slopes, variances.

    ``sums`` names what is added up, ``statistics`` are columns over these names."""
    return replicate_sums(df, row, sums, n, by).select(*by, "rep", *[c.alias(k) for k, c in statistics.items()])


def bootstrap_gap(df: DataFrame, row: str, value: str, n: int, by: str = "symbol") -> DataFrame:
    """Gap of extreme over neutral means in each of ``n`` replicates."""
    of = lambda s, c: F.when(F.col("strength") == s, c)
    sums = {f"{s}_{k}": of(s, c) for s in ("extreme", "neutral") for k, c in (("sum", F.col(value)), ("n", F.lit(1.0)))}
    mean = lambda s: F.try_divide(f"{s}_sum", f"{s}_n")
    return resampled(df.where("strength in ('extreme', 'neutral')"), row, sums, {"gap": mean("extreme") - mean("neutral")}, n, [by])


def bootstrap_sums(df: DataFrame, row: str, means: dict[str, tuple[Column, Column]], n: int, by: list[str]) -> DataFrame:
    """Weighted means (each a value and its own weight) in each of ``n`` replicates: what means and slopes are made of."""
    sums = {f"{k}_{part}": c for k, (v, w) in means.items() for part, c in (("sum", w * v), ("n", w))}
    return resampled(df, row, sums, {k: F.try_divide(f"{k}_sum", f"{k}_n") for k in means}, n, by)


def permuted_gaps(df: DataFrame, row: str, value: str, chosen: Column, n: int, by: str = "symbol", seed: int = 7, block: int = 4096) -> DataFrame:
    """Mean of the chosen over the mean of the others under ``n`` random relabellings that keep the number chosen.

    Rows are cut into blocks by their number.  How many labels each block gets in a replicate is drawn from the multivariate
    hypergeometric law, so blocks can then pick theirs each by itself: together they are a uniform choice among all rows, and no
    replicate sorts a series.  Draws depend on the seed, the group, the block and the replicates alone.  NumPy draws for up to
    10^9 rows a group.  Rows without a value are left out; ``row`` numbers a group's rows without ties.
    """
    held = df.where(F.col(value).isNotNull()).select(by, F.floor(F.col(row) / block).cast("long").alias("_block"), F.col(row).cast("long").alias("_n"), F.col(value).cast("double").alias("_v"), F.coalesce(chosen, F.lit(False)).cast("long").alias("_c"))
    kind = f"`{by}` {df.schema[by].dataType.simpleString()}"
    sizes = held.groupBy(by, "_block").agg(F.count(F.lit(1)).alias("_size"), F.sum("_c").alias("_m"), F.sum("_v").alias("_total"))
    code = lambda v: int(pd.util.hash_array(np.array([str(v)], object))[0])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        chunk = int(pdf["_chunk"].iloc[0])
        rng = np.random.default_rng([seed, code(pdf[by].iloc[0]), chunk])
        colors, many = pdf["_size"].to_numpy(np.int64), min(n, (chunk + 1) * CHUNK) - chunk * CHUNK
        take = rng.multivariate_hypergeometric(colors, int(pdf["_m"].sum()), size=many, method="marginals")
        return pdf[[by, "_block", "_chunk"]].assign(_take=list(take.T))

    def pick(rows: pd.DataFrame, deals: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(deals):
            return pd.DataFrame({by: [], "_chunk": [], "_sums": []}, dtype=object)
        v = rows.sort_values("_n")["_v"].to_numpy()
        out = []
        for chunk, take in zip(deals["_chunk"], deals["_take"]):
            rng = np.random.default_rng([seed, code(rows[by].iloc[0]), int(rows["_block"].iloc[0]), int(chunk), 1])
            picked = np.empty(len(take))
            for i, k in enumerate(take):
                draw = rng.random(len(v))
                # the k smallest draws, without a sort
                picked[i] = 0.0 if k == 0 else v[draw <= np.partition(draw, k - 1)[k - 1]].sum()
            out.append(picked)
        return pd.DataFrame({by: rows[by].iloc[0], "_chunk": deals["_chunk"].to_numpy(), "_sums": out})

    many = sizes.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CHUNK))))
    deals = many.groupBy(by, "_chunk").applyInPandas(deal, f"{kind}, _block long, _chunk int, _take array<long>")
    picked = held.groupBy(by, "_block").cogroup(deals.groupBy(by, "_block")).applyInPandas(pick, _flat_schema(held, [by]))
    whole = sizes.groupBy(by).agg(F.sum("_size").alias("_size"), F.sum("_m").alias("_m"), F.sum("_total").alias("_total"))
    gap = F.try_divide("picked", "_m") - F.try_divide(F.col("_total") - F.col("picked"), F.col("_size") - F.col("_m"))
    return _merged(picked, [by], ["picked"]).join(whole, by).select(by, "rep", gap.alias("gap"))


def permuted_gap(df: DataFrame, row: str, value: str, n: int, by: str = "symbol") -> DataFrame:
    """Gap under ``n`` relabellings: each replicate deals the labels out again in a hashed order of the rows."""
    rows = df.select(by, row, value, (F.col("strength") == "extreme").cast("int").alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("rep"))
    rows = rows.withColumn("h", hashed(F.col(row), F.col("rep")))
    size = F.sum("e").over(Window.partitionBy(by, "rep"))
    rank = F.row_number().over(Window.partitionBy(by, "rep").orderBy("h", row))
    rows = rows.withColumn("x", rank <= size)
    return rows.groupBy(by, "rep").agg((F.avg(F.when(F.col("x"), F.col(value))) - F.avg(F.when(~F.col("x"), F.col(value)))).alias("gap"))


def sweep(df: DataFrame, scenarios: list[tuple], names: list[str]) -> DataFrame:
    """Each row once per scenario; scenarios are constants inside the plan."""
    items = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in scenarios])
    return df.withColumn("_s", F.explode(items)).select(*df.columns, "_s.*")


def unit_draw(row: Column) -> Column:
    """A number strictly between 0 and 1 from ``hashed``."""
    return (hashed(row, F.lit(0)) + 0.5) / 10_000
