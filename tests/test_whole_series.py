from collections import defaultdict

from marketlens.plans.queries import QUERIES, daily


def test_every_fourth_and_last_hundred_of_whole_series(spark, sf):
    series = defaultdict(list)
    for r in daily(spark, sf).select("symbol", "date").collect():
        series[r.symbol].append(str(r.date))
    rows = lambda name: {(r.symbol, r.date) for r in QUERIES[name](spark, sf).collect()}
    assert max(map(len, series.values())) > 100
    assert rows("flt06_every_fourth") == {(k, d) for k, days in series.items() for d in sorted(days)[::4]}
    assert rows("flt05_last_hundred") == {(k, d) for k, days in series.items() for d in sorted(days)[-100:]}
