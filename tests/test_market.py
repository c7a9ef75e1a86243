import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from marketlens.operators import joins, scans, stats
from marketlens.plans.queries import ORACLE, QUERIES
from marketlens.sources import views
from marketlens.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICKED = ["src01_bars", "join01_daily_features", "join06_asof", "join07_grid_replay", "agg01_regime_statistics", "win17_durations", "tst15_premium", "tst05_corrections", "rsp01_bootstrap", "evt01_event_study", "evt01_thresholds", "join07_two_sided_replay", "bt01_summary", "rsp01_slope", "win14_method_agreement", "win19_ewma_from_zero"]


def plain(rows):
    return sorted(str([round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in map(lambda v: None if v is not None and v != v else v, row)]) for row in rows)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = sorted(got.columns)
    assert plain(map(tuple, got.select(*names).collect())) == plain(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall())


def test_robust_error_of_a_mean_takes_its_own_lags(spark):
    x = np.cumsum(np.random.default_rng(5).normal(size=150)) / 10
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("a", 200, None), ("b", 0, 1.0), ("b", 1, 2.0)]
    got = {r.k: r for r in stats.mean_with_auto_lags(spark.createDataFrame(rows, "k string, n long, x double"), "x", ["k"], "n").collect()}
    u, lags = x - x.mean(), int(4 * (150 / 100) ** (2 / 9))
    variance = x.var(ddof=1) + sum(2 * (1 - j / (lags + 1)) * (u[j:] @ u[:-j]) / 150 for j in range(1, lags + 1))
    assert got["a"].se == pytest.approx((variance / 150) ** 0.5) and got["a"].n == 150
    assert got["b"].n == 2 and got["b"].mean == 1.5


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("width", [1, 5, 100])
def test_asof_keeps_null_fields_of_the_matched_row(spark, width):
    left = spark.createDataFrame([(1, 10, 0), (1, 5, 1), (1, 3, 2), (1, 96, 3), (None, 10, 4), (1, None, 5), (2, 50, 6)], "k long, t long, id long")
    right = spark.createDataFrame([(1, 4, 1.0, 1), (1, 10, None, 2), (1, 10, 7.0, 1), (None, 4, 1.0, 1), (1, None, 1.0, 1), (2, 51, 2.0, 1)], "k long, t long, v double, tie long")
    got = {r.id: (r.r_t, r.r_v) for r in joins.asof_join(left, right, "k", "t", ["v"], "tie", width=width).collect()}
    none = (None, None)
    assert got == {0: (10, None), 1: (4, 1.0), 2: none, 3: (10, None), 4: none, 5: none, 6: none}


@pytest.mark.parametrize("slots", [2, 7, 256])
def test_adjusted_p_equals_the_plain_rules(spark, slots):
    rng = np.random.default_rng(3)
    p = [round(float(x) ** 3, 3) for x in rng.random(150)] + [0.0, 1.0]
    rows = [("a", i, x) for i, x in enumerate(p)] + [("b", 0, 0.2), ("b", 1, None)]
    got = {(r.family, r.test): (r.bonferroni, r.holm, r.bh) for r in stats.adjusted_p(spark.createDataFrame(rows, "family string, test long, p double"), "family", slots=slots).collect()}
    order, m = sorted(range(len(p)), key=lambda i: p[i]), len(p)
    holm = np.minimum(np.maximum.accumulate([p[i] * (m - n) for n, i in enumerate(order)]), 1)
    bh = np.minimum(np.minimum.accumulate([p[i] * m / (n + 1) for n, i in reversed(list(enumerate(order)))])[::-1], 1)
    for n, i in enumerate(order):
        assert got["a", i] == pytest.approx((min(1, p[i] * m), holm[n], bh[n]))
    assert got["b", 0] == pytest.approx((0.2, 0.2, 0.2)) and got["b", 1] == (None, None, None) and len(got) == len(rows)


def test_hysteresis_waits_unless_crisis(spark):
    rows = [(1, i, c) for i, c in enumerate(["bullish", "bullish", "bullish", "bullish", "bearish", "crisis"])]
    out = scans.hysteresis(spark.createDataFrame(rows, "symbol long, date int, candidate string"), "candidate").orderBy("date").collect()
    assert [r.state for r in out] == ["neutral", "neutral", "neutral", "bullish", "bullish", "crisis"]


def test_stream_equals_batch(spark, sf, tmp_path):
    ticks = views.ticks(spark, sf)
    ticks.write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), ticks.schema)
    got = streams.run_to_table(streams.deduplicated(stream, "event_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert got.count() == ticks.count()
    assert streams.minute_rollup(ticks).groupBy().sum("n").first()[0] == ticks.count()


def test_the_entry_works_without_the_training_data_operators(tmp_path):
    """With both folders and the pipeline gone the other queries still register."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "marketlens"), tmp_path / "marketlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 150, out.stderr
