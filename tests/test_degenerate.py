"""Queries beside their SQL where a denominator is zero or a group has too little to estimate from."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from marketlens.functions import expressions as E
from marketlens.operators import specs, stats
from marketlens.plans import forms, queries, studies, sweeps  # noqa: F401  register their queries


def plain(rows):
    """Rows in one order; null, NaN and the infinities stay apart."""
    one = lambda v: ("nan" if math.isnan(v) else round(float(v), 4) + 0.0) if v is not None and not isinstance(v, str) else v
    return sorted(([one(v) for v in row] for row in rows), key=str)


def both(spark, folder, name, table):
    """(rows, rows by SQL) of a query over one written table."""
    got = queries.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    columns = ", ".join(got.columns)
    return plain(map(tuple, got.collect())), plain(con.execute(f"SELECT {columns} FROM ({queries.ORACLE[name]})").fetchall())


def written(folder, table, select):
    duckdb.connect().execute(f"COPY ({select}) TO '{folder}/{table}.parquet'")
    return folder


def test_divided_is_ieee(spark):
    inf, nan = math.inf, math.nan
    cases = [(1.0, 0.0, inf), (-1.0, 0.0, -inf), (1.0, -0.0, -inf), (0.0, 0.0, "nan"), (nan, 0.0, "nan"), (1.0, nan, "nan"), (3.0, 2.0, 1.5), (0.0, 2.0, 0.0), (1.0, None, None), (None, 0.0, None), (inf, 0.0, inf)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a double, b double").withColumn("q", E.divided(F.col("a"), F.col("b"))).orderBy("i").collect()
    assert ["nan" if r.q is not None and math.isnan(r.q) else r.q for r in rows] == [c[2] for c in cases]


def test_book_with_a_mid_of_zero_equals_sql(spark, tmp_path):
    """Values of zero (either sign) and null, and ids whose volumes are missing or add up to nothing."""
    values = "(0, 0.0::DOUBLE), (1, -0.0), (2, 50.0), (3, NULL), (4, -3.25), (5, 1.0), (-4, 2.0), (NULL, 2.0), (-32, 2.0), (-33, 0.0)"
    got, want = both(spark, written(tmp_path, "events", f"SELECT * FROM (VALUES {values}) t(event_id, value)"), "exp09_book_features", "events")
    assert got == want and any(math.inf in row for row in got)


EXTREME, NEUTRAL = "xx", "un"


def orders(folder, days, flat=False):
    """Two orders a day for each of its symbols: low ones on extreme days (index 0), one urgent and one low on neutral ones (index 50)."""
    rows, key = [], 0
    for n, (kind, symbols) in enumerate(days):
        for symbol in symbols:
            for k in range(2):
                price = 100.0 if flat else 100.0 + (n * 37 + symbol * 11 + k * 23) % 29 + (key % 7) / 4
                rows.append(f"({key * 4 + symbol}, DATE '1995-01-02' + {n}, {price}::DOUBLE, '{'1-URGENT' if kind[k] == 'u' else '5-LOW'}')")
                key += 1
    return written(folder, "orders", f"SELECT o_orderkey::BIGINT AS o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate, o_totalprice, o_orderpriority FROM (VALUES {', '.join(rows)}) t(o_orderkey, o_orderdate, o_totalprice, o_orderpriority)")


SHAPES = {
    "no extreme day": [(NEUTRAL, range(4))] * 12,
    "no neutral day": [(EXTREME, range(4))] * 12,
    # symbol 0 has no extreme day, 1 one, 2 two and 3 no neutral one
    "few": [*[(NEUTRAL, [0, 1, 2])] * 9, (EXTREME, [1, 2, 3]), (EXTREME, [2, 3]), (EXTREME, [3]), (EXTREME, [3]), *[(NEUTRAL, [0, 1, 2])] * 3],
    # one spread a symbol, or none
    "short": [(NEUTRAL, [0, 1, 2]), (NEUTRAL, [0, 1]), (EXTREME, [3]), (EXTREME, [3])],
    # symbol 0 has one neutral and one extreme day with a spread
    "two": [(NEUTRAL, range(2)), (NEUTRAL, range(2)), (EXTREME, range(2)), (EXTREME, [1]), (NEUTRAL, [1])],
    "usual": [(EXTREME if n % 3 == 0 else NEUTRAL, range(4)) for n in range(20)],
}
FLAT = ["usual", "no extreme day"]
CASES = [*[(s, False) for s in SHAPES], *[(s, True) for s in FLAT]]


def equals_sql(spark, folder, name, shape, flat):
    got, want = both(spark, orders(folder, SHAPES[shape], flat), name, "orders")
    assert got == want and got


@pytest.mark.parametrize("shape, flat", CASES)
def test_effect_of_a_symbol_with_too_few_days_equals_sql(spark, tmp_path, shape, flat):
    equals_sql(spark, tmp_path, "exp27_effect_labels", shape, flat)


def test_premium_of_every_stratum(spark):
    """No row fails or is lost at ``least`` 0, whichever columns are read; by default too small strata have none."""
    rows = [("a", "extreme", 1.0), ("b", "neutral", 1.0), ("b", "extreme", 3.0), ("c", "extreme", 2.0), ("c", "extreme", 2.0), ("c", "neutral", 1.0), ("c", "neutral", 1.0)]
    df = spark.createDataFrame(rows, "k string, strength string, v double")
    got = {r.k: r for r in stats.premium(df, ["k"], "v", least=0, ieee=True).collect()}
    assert (got["a"].gap, got["a"].d, got["b"].gap, got["b"].d, got["b"].dof) == (None, None, 2.0, None, None) and (got["c"].d, got["c"].t) == (math.inf, math.inf)
    assert stats.premium(df, ["k"], "v").count() == 0 and {r.k: r.d for r in stats.premium(df, ["k"], "v", least=2).collect()} == {"c": None}


@pytest.mark.parametrize("shape, flat", CASES)
def test_robust_test_of_a_dummy_without_contrast_equals_sql(spark, tmp_path, shape, flat):
    equals_sql(spark, tmp_path, "reg05_wald_of_extremes", shape, flat)


def test_gram_where_tasks_have_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0)], "symbol long, a double, y double").repartition(8, "symbol")
    assert [(r.symbol, r.total) for r in specs.gram(df, ["a", "y"], "symbol").collect()] == [(1, [2.0, 3.0, 5.0, 3.0, 5.0, 8.0, 5.0, 8.0, 13.0])]


@pytest.mark.parametrize("shape, flat", [c for c in CASES if c[0] != "two"])
def test_controlled_slope_without_contrast_equals_sql(spark, tmp_path, shape, flat):
    equals_sql(spark, tmp_path, "reg09_volume_controlled", shape, flat)


def test_controlled_slope_of_small_and_constant_groups(spark):
    """Three rows have both slopes, whatever their order and tasks; without contrast both are undefined."""
    three = [("a", 1.0, 0.0, 0.0), ("a", 4.0, 1.0, 0.0), ("a", 11.0, 1.0, 1.0)]
    flat = [("b", float(i), 1.0, float(i % 3)) for i in range(50)]
    rows = spark.createDataFrame([*three, *flat, ("c", None, 1.0, 1.0)], "symbol string, y double, x double, v double").repartition(7)
    got = {r.symbol: (r.alone, r.controlled) for r in stats.controlled_slope(rows, "y", "x", "v").collect()}
    assert got["a"] == pytest.approx((6.5, 3.0)) and all(math.isnan(v) for v in got["b"]) and set(got) == {"a", "b"}
