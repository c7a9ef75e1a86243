"""Joins of series: as-of, grid replay, forward fill, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, fields: list[str], tie: str, prefix: str = "r_", width: str | int = "day") -> DataFrame:
    """The last right row at or before each left row, by key: one union and one sorted window, no range join.

    Time is cut into slots (a unit of ``date_trunc``, or a number where ``ts`` is one), so a window holds one key's rows of one
    slot; the last right row of each slot reaches later ones by a window over one row a slot.  The right row travels as one
    struct, so its null fields do not fall back to an older row; ``tie`` orders equal times.  A null key or time matches nothing.
    """
    slot = F.date_trunc(width, ts) if isinstance(width, str) else F.floor(F.col(ts) / width)
    value = F.struct(F.col(ts).alias(ts), *fields)
    kind = right.schema
    empty = F.lit(None).cast(right.select(value.alias("x")).schema["x"].dataType)
    right = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    a = left.select(F.struct(*left.columns).alias("l"), F.col(key), F.col(ts), slot.alias("_slot"), F.lit(1).alias("side"), F.lit(None).cast(kind[tie].dataType).alias("tie"), empty.alias("r"))
    b = right.select(F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.col(key), F.col(ts), slot.alias("_slot"), F.lit(0).alias("side"), F.col(tie).alias("tie"), value.alias("r"))
    both = a.unionByName(b)
    lasts = both.groupBy(key, "_slot").agg(F.max_by("r", F.when(F.col("side") == 0, F.struct(ts, "tie"))).alias("_r"))
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_r", F.last("_r", ignorenulls=True).over(earlier)).where("_r is not null")
    upto = Window.partitionBy(key, "_slot").orderBy(ts, "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("r", F.last("r", ignorenulls=True).over(upto)).where("side = 1").join(carried, [key, "_slot"], "left")
    found = F.coalesce("r", "_r")
    return both.select("l.*", *[found[f].alias(prefix + f) for f in [ts, *fields]])


def grid(bounds: DataFrame, key: str, start: str, end: str, step: str, ts: str = "ts") -> DataFrame:
    """One row per key and step of time between two bounds."""
    return bounds.where(F.col(start) <= F.col(end)).select(key, F.explode(F.sequence(start, end, F.expr(f"interval {step}"))).alias(ts))


def forward_fill(left: DataFrame, right: DataFrame, on: str, column: str, series: Column | str) -> DataFrame:
    """Left join, then the last known value by ``series`` order."""
    fill = Window.partitionBy("symbol").orderBy(series).rowsBetween(Window.unboundedPreceding, 0)
    return left.join(right, on, "left").withColumn(column, F.last(column, ignorenulls=True).over(fill))


def neighbourhood(df: DataFrame, event: Column, reach: int, value: str) -> DataFrame:
    """Mean of ``value`` before, at and after each event row, within ``reach`` rows."""
    series = Window.partitionBy("symbol").orderBy("date")
    marked = df.withColumns({"before": F.avg(value).over(series.rowsBetween(-reach, -1)), "after": F.avg(value).over(series.rowsBetween(1, reach)), "_e": event})
    return marked.where("_e").select("symbol", "date", "before", F.col(value).alias("at"), "after")


def replay(df: DataFrame, key: str, ts: str, tie: str, marks: dict[str, tuple[Column, list[str]]], sums: dict[str, Column], width: str | int = "day") -> DataFrame:
    """Beside each row the fields of the last row of each kind strictly before it (``<mark>_<field>``), and running sums that include it.

    Rows are ordered by (``ts``, ``tie``) within a key; slots of time as in ``asof_join``, so a window holds one key's rows of a slot or one row
    a slot.  A mark's fields travel as one struct, so nulls do not fall back to an older row.
    """
    slot = F.date_trunc(width, ts) if isinstance(width, str) else F.floor(F.col(ts) / width)
    held = {f"_m_{m}": F.when(test, F.struct(*fields)) for m, (test, fields) in marks.items()}
    rows = df.withColumns({"_slot": slot, **held, **{f"_s_{s}": c for s, c in sums.items()}})
    at = F.struct(ts, tie)
    ends = rows.groupBy(key, "_slot").agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), at)).alias(f"{m}_0") for m in held], *[F.sum(f"_s_{s}").alias(f"_s_{s}_0") for s in sums])
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_slot", *[F.last(f"{m}_0", ignorenulls=True).over(earlier).alias(f"{m}_0") for m in held], *[F.sum(f"_s_{s}_0").over(earlier).alias(f"_s_{s}_0") for s in sums])
    inside = Window.partitionBy(key, "_slot").orderBy(ts, tie)
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({**{f"{m}_1": F.last(m, ignorenulls=True).over(before) for m in held}, **{f"_s_{s}_1": F.sum(f"_s_{s}").over(upto) for s in sums}})
    rows = rows.join(carried, [key, "_slot"])
    found = {f"{m}_{f}": F.coalesce(f"_m_{m}_1", f"_m_{m}_0")[f] for m, (_, fields) in marks.items() for f in fields}
    totals = {f"{s}_total": F.coalesce(f"_s_{s}_1", F.lit(0.0)) + F.coalesce(f"_s_{s}_0", F.lit(0.0)) for s in sums}
    return rows.withColumns({**found, **totals}).select(*df.columns, *found, *totals)
