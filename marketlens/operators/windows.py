"""Analytic operators on bars: every frame is partitioned by symbol and ordered by day."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_day() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def frame(width: int, series: WindowSpec | None = None) -> WindowSpec:
    return (series or by_day()).rowsBetween(-width + 1, 0)


def full(value: Column, of: Column, width: int, series: WindowSpec | None = None) -> Column:
    """The rolling value once the frame holds ``width`` non-null inputs."""
    return F.when(F.count(of).over(frame(width, series)) == width, value)


def log_return(df: DataFrame, price: str = "close", out: str = "ret") -> DataFrame:
    return df.withColumn(out, F.ln(F.col(price) / F.lag(price).over(by_day())))


def realised_volatility(df: DataFrame, width: int, periods: int = 1, out: str = "rv") -> DataFrame:
    r = F.col("ret")
    return df.withColumn(out, full(F.stddev_samp(r).over(frame(width)), r, width) * math.sqrt(periods))


def parkinson(df: DataFrame, width: int = 1, periods: int = 1, out: str = "pk") -> DataFrame:
    sq = F.pow(F.ln(F.col("high") / F.col("low")), 2)
    return df.withColumn(out, F.sqrt(full(F.avg(sq).over(frame(width)), sq, width) / (4 * math.log(2)) * periods))


def corwin_schultz(df: DataFrame, scale: float = 10_000.0, beta_days: int = 2, out: str = "cs") -> DataFrame:
    """Two-day high-low spread estimate, negative values at zero."""
    sq = F.pow(F.ln(F.col("high") / F.col("low")), 2)
    beta = F.sum(sq).over(frame(2)) if beta_days == 2 else sq
    gamma = F.pow(F.ln(F.max("high").over(frame(2)) / F.min("low").over(frame(2))), 2)
    k = 3 - 2 * math.sqrt(2)
    df = df.withColumn("_a", (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k))
    spread = 2 * (F.exp("_a") - 1) / (1 + F.exp("_a"))
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(frame(2)) == 2, F.greatest(spread, F.lit(0.0)) * scale)).drop("_a")


def abdi_ranaldo(df: DataFrame, width: int = 20, out: str = "ar") -> DataFrame:
    eta = (F.ln("high") + F.ln("low")) / 2
    df = df.withColumn("_eta", eta)
    x = (F.ln(F.lag("close").over(by_day())) - F.lag("_eta").over(by_day())) * (F.ln(F.lag("close").over(by_day())) - F.col("_eta"))
    df = df.withColumn("_x", x)
    return df.withColumn(out, full(2 * F.sqrt(F.greatest(F.avg("_x").over(frame(width)), F.lit(0.0))), F.col("_x"), width)).drop("_eta", "_x")


def midpoint_spread(df: DataFrame, width: int = 20) -> DataFrame:
    """Spread from the mean of 4 (close - mid)(close - last close), in basis points of the close, and its error by the delta method."""
    df = df.withColumn("_x", 4 * (F.col("close") - (F.col("high") + F.col("low")) / 2) * (F.col("close") - F.lag("close").over(by_day())))
    df = df.withColumns({"spread_sq": full(F.avg("_x").over(frame(width)), F.col("_x"), width), "_s": F.stddev_samp("_x").over(frame(width))})
    scale = 10_000 / F.col("close")
    error = F.col("_s") / math.sqrt(width) / (2 * F.sqrt(F.greatest("spread_sq", F.lit(1e-10))))
    return df.withColumns({"spread_bps": F.when(F.col("spread_sq").isNotNull(), F.sqrt(F.greatest("spread_sq", F.lit(0.0))) * scale), "se_bps": error * scale}).drop("_x", "_s")


def roll_measure(df: DataFrame, width: int = 20, out: str = "roll") -> DataFrame:
    df = df.withColumn("_lag", F.lag("ret").over(by_day()))
    cov = full(F.covar_samp("ret", "_lag").over(frame(width)), F.col("_lag"), width)
    return df.withColumn(out, 2 * F.sqrt(F.greatest(-cov, F.lit(0.0)))).drop("_lag")


def amihud(df: DataFrame, width: int = 20, out: str = "amihud") -> DataFrame:
    df = df.withColumn("_i", F.abs("ret") / F.nullif("volume", F.lit(0.0)))
    return df.withColumn(out, full(F.avg("_i").over(frame(width)), F.col("_i"), width) * 1e6).drop("_i")


def rolling_correlation(df: DataFrame, a: str, b: str, width: int, out: str) -> DataFrame:
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    x, y = F.when(both == 1, F.col(a)), F.when(both == 1, F.col(b))
    corr = F.try_divide(F.covar_pop(x, y).over(frame(width)), F.stddev_pop(x).over(frame(width)) * F.stddev_pop(y).over(frame(width)))
    return df.withColumn(out, full(corr, both, width))


def expanding_min_max(df: DataFrame, col: str, least: int = 30, out: str = "scaled") -> DataFrame:
    """Min-max by history strictly before the row; 0.5 on flat history."""
    before = by_day().rowsBetween(Window.unboundedPreceding, -1)
    lo, hi = F.min(col).over(before), F.max(col).over(before)
    value = F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(0.5)
    return df.withColumn(out, F.when(F.count(col).over(before) >= least, value))


def rolling_min_max(df: DataFrame, col: str, width: int = 252, least: int = 30, out: str = "scaled") -> DataFrame:
    lo, hi = F.min(col).over(frame(width)), F.max(col).over(frame(width))
    return df.withColumn(out, F.when(F.count(col).over(frame(width)) >= least, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(0.5)))


def transitions(df: DataFrame) -> DataFrame:
    """Flags of entering and leaving extreme and neutral regimes."""
    before = F.lag("regime").over(by_day())
    extreme = ["extreme_fear", "extreme_greed"]
    return df.withColumns({
        "enter_extreme": F.col("regime").isin(extreme) & ~before.isin(extreme), "exit_extreme": ~F.col("regime").isin(extreme) & before.isin(extreme),
        "enter_neutral": (F.col("regime") == "neutral") & (before != "neutral"), "exit_neutral": (F.col("regime") != "neutral") & (before == "neutral"),
    })


def spells(df: DataFrame, col: str = "regime") -> DataFrame:
    """Runs of equal values: spell number and day in the spell."""
    changed = F.when(F.col(col) == F.lag(col).over(by_day()), 0).otherwise(1)
    df = df.withColumn("_c", changed).withColumn("spell", F.sum("_c").over(by_day())).drop("_c")
    return df.withColumn("age", F.row_number().over(Window.partitionBy("symbol", "spell").orderBy("date")))


def quantile_bins(df: DataFrame, col: str, bins: int, key: str = "symbol", out: str = "bin") -> DataFrame:
    """Bins between linearly interpolated quantiles, right-closed, the lowest included."""
    edges = df.groupBy(key).agg(F.percentile(col, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_e"))
    at = F.size(F.filter("_e", lambda e: e < F.col(col))) + 1
    return df.join(edges, key).withColumn(out, F.when(F.col(col).isNotNull(), at)).drop("_e")


def divergence_log(df: DataFrame, value: str, price: str, threshold: float, ahead: int = 24) -> DataFrame:
    """Events where abs(value) reaches the threshold, with what follows in the next ``ahead`` rows."""
    after = by_day().rowsBetween(1, ahead)
    df = df.withColumn("_r", F.ln(F.col(price) / F.lag(price).over(by_day()))).withColumn("_n", F.row_number().over(by_day()))
    calm = F.min(F.when(F.abs(value) < threshold, F.col("_n"))).over(after) - F.col("_n")
    complete = F.count(F.lit(1)).over(after) == ahead
    events = df.withColumns({
        "forward_vol": F.when(complete, F.stddev_pop("_r").over(by_day().rowsBetween(2, ahead))), "forward_change": F.when(complete, F.last(price).over(after) / F.col(price) - 1), "steps_to_converge": F.when(complete, calm),
    })
    return events.where(F.abs(value) >= threshold).drop("_r", "_n")


def numbered(df: DataFrame, key: str, order: list[str], part: str = "day", out: str = "rn") -> DataFrame:
    """Row numbers by (key, order) from 1; a window holds one part of time (by the first column of ``order``) or one row a part."""
    rows = df.withColumn("_slot", F.date_trunc(part, order[0]))
    counts = rows.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "_slot", F.coalesce(before, F.lit(0)).alias("_c"))
    inside = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(*order))
    return rows.withColumn("_i", inside).join(counts, [key, "_slot"]).select(*df.columns, (F.col("_c") + F.col("_i")).alias(out))


def with_halo(df: DataFrame, rn: str, halo: int, block: int = 4096) -> DataFrame:
    """Numbered rows in blocks of ``block`` rows, the last ``halo`` of each once more in the next one: ``_block``, and ``_own`` where a row is at home.

    A frame of ``halo`` rows before the present one can then be taken within (key, ``_block``), which is bounded."""
    at = F.col(rn) - 1
    home = F.floor(at / block).cast("long")
    places = F.when(at % block >= block - halo, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == home)


def ranked(df: DataFrame, key: str, value: str, tie: str, slots: int = 32) -> DataFrame:
    """Adds ``rank`` (by value, ties by ``tie``) and ``of`` (the key's rows): approximate quantiles cut a key's values into slots, a window holds one of them.

    Rows without a value are left out."""
    rows = df.where(F.col(value).isNotNull())
    cuts = rows.groupBy(key).agg(F.percentile_approx(value, [i / slots for i in range(1, slots)], 10 * slots).alias("_cuts"))
    rows = rows.join(cuts, key).withColumn("_s", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    sizes = rows.groupBy(key, "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "_s", F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_c").over(Window.partitionBy(key)).alias("of"))
    inside = F.row_number().over(Window.partitionBy(key, "_s").orderBy(value, tie))
    return rows.withColumn("_i", inside).join(sizes, [key, "_s"]).withColumn("rank", F.col("_base") + F.col("_i")).drop("_s", "_i", "_base")


def effective_spread(df: DataFrame, price: str, buy: str, size: str, order: list[str], width: int = 50, least: int = 25, key: str = "symbol", part: str = "day", block: int = 4096) -> DataFrame:
    """Rolling median mid and VWAP of the last ``width`` trades, and what a trade pays over the mid, in basis points.

    The tape of a key is cut into blocks of trades that bring the ``width`` - 1 trades before them along."""
    df = with_halo(numbered(df, key, order, part), "rn", width - 1, block)
    last = Window.partitionBy(key, "_block").orderBy("rn").rowsBetween(-width + 1, 0)
    mid = F.when(F.count(F.lit(1)).over(last) >= least, F.percentile(price, F.lit(0.5)).over(last))
    df = df.withColumns({"mid": mid, "vwap": F.sum(F.col(price) * F.col(size)).over(last) / F.sum(size).over(last)}).where("_own").drop("_block", "_own", "rn")
    over_mid = F.try_divide(F.col(price) - F.col("mid"), F.col("mid")) * 10_000
    return df.withColumns({"eff": 2 * F.abs(over_mid), "signed": F.when(F.col(buy), 2).otherwise(-2) * over_mid})


def before_in_order(df: DataFrame, fields: list[str], order: list[str], key: str = "symbol", part: str = "day", prefix: str = "last_") -> DataFrame:
    """The fields of the row before, by (key, order); a window holds one part of time, and the last row of each part is carried to the next.

    One row a part travels, as one struct."""
    slot = F.date_trunc(part, order[0])
    rows = df.withColumns({"_slot": slot, "_f": F.struct(*fields)})
    ends = rows.groupBy(key, "_slot").agg(F.max_by("_f", F.struct(*order)).alias("_e"))
    carried = ends.select(key, "_slot", F.lag("_e").over(Window.partitionBy(key).orderBy("_slot")).alias("_e"))
    inside = Window.partitionBy(key, "_slot").orderBy(*order)
    found = F.coalesce("_b", "_e")
    return rows.withColumn("_b", F.lag("_f").over(inside)).join(carried, [key, "_slot"]).select(*df.columns, *[found[f].alias(prefix + f) for f in fields])


def institutional(df: DataFrame, retail: str, slow: str, vol: str, corr: str, out: str = "institutional") -> DataFrame:
    """Half the smoothed index, half calm of volatility, pulled against the index where it ran against prices; within -1 to 1."""
    low, high = 0.005, 0.065
    calm = F.coalesce(1 - 2 * (F.greatest(F.lit(low), F.least(F.lit(high), F.col(vol))) - low) / (high - low), F.lit(0.0))
    base = 0.5 * F.col(slow) + 0.5 * F.when(F.col(vol).isNotNull(), calm).otherwise(0.0)
    against = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.coalesce(corr, F.lit(0.0))))
    return df.withColumn(out, F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), base + 0.3 * against * (-F.col(retail) - base))), F.lit(0.0)))
