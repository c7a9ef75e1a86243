"""Registered queries that complete the others: further forms, standard errors, summaries and two-sided replay; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import expressions as E
from marketlens.operators import joins as J
from marketlens.operators import resample as R
from marketlens.operators import scans, stats
from marketlens.operators import windows as W
from marketlens.plans.queries import _GRID, _HASH, _RECURSIVE, _ROWS, BARS, DAILY, REGIME, S, _numbered, daily, over, query, r
from marketlens.plans.studies import _each, n_rows
from marketlens.sources import views as V

_WEIGHT = "CASE WHEN h < 3679 THEN 0 WHEN h < 7358 THEN 1 WHEN h < 9197 THEN 2 WHEN h < 9810 THEN 3 WHEN h < 9963 THEN 4 WHEN h < 9994 THEN 5 ELSE 6 END"

# ---- windows and summaries


@query(f"""{BARS}, v AS (SELECT symbol, date, close, 4 * (close - (high + low) / 2) * (close - lag(close) {S}) AS v FROM bars), w AS (SELECT symbol, date, close, avg(v) {over(20)} AS m, stddev_samp(v) {over(20)} AS s, count(v) {over(20)} AS n FROM v)
 SELECT symbol, date, round(sqrt(greatest(m, 0)) / close * 10000, 4) AS spread_bps, round(s / sqrt(20) / (2 * sqrt(greatest(m, 1e-10))) / close * 10000, 2) AS se_bps FROM w WHERE n = 20 AND m > 1e-6""")
def win04_spread_with_error(spark, sf):
    """The delta method needs a positive mean, so days without one are left out."""
    d = W.midpoint_spread(V.bars(spark, sf), 20).where("spread_sq > 1e-6")
    return d.select("symbol", "date", r("spread_bps", 4).alias("spread_bps"), r("se_bps", 2).alias("se_bps"))


_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(f"""{DAILY}, q AS (SELECT symbol, count(*) AS n, min(ret) AS least, max(ret) AS most, quantile_cont(ret, {list(_SHARES)}) AS q FROM daily WHERE ret IS NOT NULL GROUP BY 1)
 SELECT symbol, n, round(least, 6) AS least, round(most, 6) AS most, round(q[1], 6) AS q05, round(q[3], 6) AS median, round(q[5], 6) AS q95, round(q[4] - q[2], 6) AS iqr FROM q""")
def agg05_return_quantiles(spark, sf):
    q = daily(spark, sf).where("ret is not null").groupBy("symbol").agg(n_rows().alias("n"), F.min("ret").alias("least"), F.max("ret").alias("most"), F.percentile("ret", F.array(*map(F.lit, _SHARES))).alias("q"))
    at = lambda i: F.get("q", i)
    return q.select("symbol", "n", *_each("least", "most"), *[r(c).alias(n) for n, c in (("q05", at(0)), ("median", at(2)), ("q95", at(4)), ("iqr", at(3) - at(1)))])


@query(f"""{DAILY}, c AS (SELECT *, CASE WHEN regime = lag(regime) {S} THEN 0 ELSE 1 END AS ch FROM daily), s AS (SELECT *, sum(ch) {S} AS spell FROM c), e AS (SELECT symbol, spell, regime, count(*) AS n FROM s GROUP BY 1, 2, 3)
 SELECT symbol, regime, round(stddev_pop(n), 6) AS std_days, min(n) AS shortest, sum(n)::BIGINT AS total_days FROM e GROUP BY 1, 2""")
def win17_duration_spread(spark, sf):
    e = W.spells(daily(spark, sf)).groupBy("symbol", "spell", "regime").agg(n_rows().alias("n"))
    return e.groupBy("symbol", "regime").agg(r(F.stddev_pop("n")).alias("std_days"), F.min("n").alias("shortest"), F.sum("n").alias("total_days"))


@query(f"""{DAILY}, e AS (SELECT symbol, regime, (pk - min(pk) OVER p) / nullif(max(pk) OVER p - min(pk) OVER p, 0) AS whole, min(pk) {over(252)} AS lo, max(pk) {over(252)} AS hi, count(pk) {over(252)} AS n, pk FROM daily WINDOW p AS (PARTITION BY symbol)),
 x AS (SELECT symbol, regime, whole, CASE WHEN hi > lo THEN (pk - lo) / (hi - lo) ELSE 0.5 END AS rolling FROM e WHERE n >= 30 AND pk IS NOT NULL)
 SELECT symbol, regime, count(*) AS n, round(avg(whole), 6) AS mean_whole, round(avg(rolling), 6) AS mean_rolling, round(max(c), 6) AS agreement FROM x JOIN (SELECT symbol AS s, corr(whole, rolling) AS c FROM x GROUP BY 1) ON symbol = s GROUP BY 1, 2""")
def win14_method_agreement(spark, sf):
    """Means by regime under whole-sample and rolling scaling, and the correlation of the two."""
    p = Window.partitionBy("symbol")
    d = daily(spark, sf).withColumn("whole", F.try_divide(F.col("pk") - F.min("pk").over(p), F.max("pk").over(p) - F.min("pk").over(p)))
    d = W.rolling_min_max(d, "pk", 252, 30, "rolling").where("pk is not null and rolling is not null")
    both = d.groupBy("symbol").agg(F.corr("whole", "rolling").alias("c"))
    g = d.groupBy("symbol", "regime").agg(n_rows().alias("n"), F.avg("whole").alias("mean_whole"), F.avg("rolling").alias("mean_rolling"))
    return g.join(both, "symbol").select("symbol", "regime", "n", *_each("mean_whole", "mean_rolling"), r("c").alias("agreement"))


@query(f"""{BARS.replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT symbol, date, fg, row_number() {S} AS n FROM bars JOIN idx USING (date)), e AS (SELECT DISTINCT symbol, NULL::DATE AS date, 0::BIGINT AS n, 0.0::DOUBLE AS x FROM s UNION ALL SELECT s.symbol, s.date, s.n, 0.1 * s.fg + 0.9 * e.x FROM e JOIN s ON s.symbol = e.symbol AND s.n = e.n + 1)
 SELECT symbol, date, round(x, 6) AS x FROM e WHERE n > 0""")
def win19_ewma_from_zero(spark, sf):
    d = V.bars(spark, sf).join(V.index_daily(spark, sf), "date").select("symbol", "date", "fg")
    return scans.ewma(d, "fg", 0.1, first=0.0).select("symbol", "date", r("ewma").alias("x"))


@query("""WITH p AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS mark FROM lineitem GROUP BY 1), g AS (SELECT agent, day, sum(sum(cash)) OVER w AS cash, sum(sum(pos)) OVER w AS position, sum(count(*)) OVER w AS fills FROM (
 SELECT 'b' || (l_partkey % 20) AS agent, CAST(l_shipdate AS DATE) AS day, -l_extendedprice AS cash, l_quantity AS pos FROM lineitem UNION ALL SELECT 's' || (l_suppkey % 20), CAST(l_shipdate AS DATE), l_extendedprice, -l_quantity FROM lineitem) GROUP BY 1, 2 WINDOW w AS (PARTITION BY agent ORDER BY day))
 SELECT agent, day, fills::BIGINT AS fills, round(mark, 9) AS mark, round((cash + position * mark) / 1000, 1) AS worth_thousands FROM g JOIN p USING (day)""")
def win27_marked(spark, sf):
    """Fills so far and cash with the position at the day's average price, by agent and day."""
    fills = V.table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    leg = lambda side, key, sign: F.struct(F.concat(F.lit(side), (F.col(key) % 20).cast("string")).alias("agent"), (-sign * F.col("l_extendedprice")).alias("cash"), (sign * F.col("l_quantity")).cast("double").alias("pos"))
    g = fills.select("day", F.explode(F.array(leg("b", "l_partkey", 1), leg("s", "l_suppkey", -1))).alias("x")).groupBy("x.agent", "day").agg(F.sum("x.cash").alias("cash"), F.sum("x.pos").alias("pos"), n_rows().alias("n"))
    marks = fills.groupBy("day").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("mark"))
    w = Window.partitionBy("agent").orderBy("day")
    g = g.select("agent", "day", F.sum("cash").over(w).alias("cash"), F.sum("pos").over(w).alias("position"), F.sum("n").over(w).alias("fills"))
    return g.join(marks, "day").select("agent", "day", "fills", r("mark", 9).alias("mark"), r((F.col("cash") + F.col("position") * F.col("mark")) / 1000, 1).alias("worth_thousands"))


@query("""WITH t AS (SELECT user_id AS symbol, ts, value, CAST(ts AS DATE) AS day, (row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1) // 5 AS bar, event_id FROM events)
 SELECT symbol, day, bar::BIGINT AS bar, count(*) AS n, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, round(avg(value), 6) AS mean FROM t GROUP BY 1, 2, 3""")
def agg13_session_bars(spark, sf):
    """A bar for every five ticks of a session, which is a day."""
    n = F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts", "event_id")) - 1
    t = V.ticks(spark, sf).withColumn("day", F.col("ts").cast("date")).withColumn("bar", F.floor(n / 5))
    at = F.struct("ts", "event_id")
    return t.groupBy("symbol", "day", "bar").agg(n_rows().alias("n"), *[r(c).alias(k) for k, c in (("open", F.min_by("price", at)), ("high", F.max("price")), ("low", F.min("price")), ("close", F.max_by("price", at)), ("mean", F.avg("price")))])


@query("SELECT event_type AS source, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS start_us, round(avg(value), 6) AS avg_value, round(stddev_samp(value), 6) AS std_value, count(*) AS n FROM events GROUP BY 1, 2")
def agg15_minutes_by_source(spark, sf):
    t = V.ticks(spark, sf).groupBy("source", F.window("ts", "1 minute").alias("w")).agg(F.avg("price").alias("a"), F.stddev_samp("price").alias("s"), n_rows().alias("n"))
    return t.select("source", F.unix_micros("w.start").alias("start_us"), r("a").alias("avg_value"), r("s").alias("std_value"), "n")


@query(f"""{DAILY}, x AS (SELECT *, CASE WHEN cs BETWEEN 0 AND 1000 THEN cs END AS valid, stddev_samp(ret) OVER (PARTITION BY symbol) AS s FROM daily)
 SELECT symbol, count(*) AS days, count(valid) AS valid, round(avg(valid), 4) AS mean_valid, sum((abs(ret) < 5 * s)::INT)::BIGINT AS calm FROM x GROUP BY 1""")
def flt03_range_rules(spark, sf):
    """Spreads outside 0 to 1000 bps become null; returns count while under five standard deviations."""
    d = daily(spark, sf).withColumns({"valid": F.when(F.col("cs").between(0, 1000), F.col("cs")), "s": F.stddev_samp("ret").over(Window.partitionBy("symbol"))})
    return d.groupBy("symbol").agg(n_rows().alias("days"), F.count("valid").alias("valid"), r(F.avg("valid"), 4).alias("mean_valid"), F.sum((F.abs("ret") < 5 * F.col("s")).cast("int")).alias("calm"))


# ---- two-sided replay


_SIDE = "SELECT user_id AS symbol, ts, value FROM events WHERE event_type = '{0}'"


@query(f"""WITH p AS ({_SIDE.format("view")}), q AS ({_SIDE.format("click")}), b AS (SELECT symbol, greatest(p.lo, q.lo) AS lo, least(p.hi, q.hi) AS hi FROM (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY 1) p JOIN (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM q GROUP BY 1) q USING (symbol)),
 g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 12 HOUR)) AS ts FROM b WHERE lo <= hi), x AS (SELECT g.symbol, g.ts, p.ts AS p_ts, p.value AS p FROM g ASOF LEFT JOIN p ON g.symbol = p.symbol AND g.ts >= p.ts), y AS (SELECT x.*, q.ts AS q_ts, q.value AS q FROM x ASOF LEFT JOIN q ON x.symbol = q.symbol AND x.ts >= q.ts)
 SELECT symbol, epoch_us(ts) AS at_us, round(p, 6) AS price, round(coalesce(q, 0), 6) AS signal, epoch_us(ts) - epoch_us(p_ts) AS price_age_us, epoch_us(ts) - epoch_us(q_ts) AS signal_age_us, coalesce(ts <> p_ts, true) OR coalesce(ts <> q_ts, true) AS is_interpolated FROM y""")
def join07_two_sided_replay(spark, sf):
    """A grid over the range that both series share, with the last value, its age and whether it is not of that very time."""
    t = V.ticks(spark, sf)
    price, signal = t.where("source = 'view'"), t.where("source = 'click'").withColumnRenamed("price", "signal")
    ends = lambda d, a, b: d.groupBy("symbol").agg(F.min("ts").alias(a), F.max("ts").alias(b))
    bounds = ends(price, "a", "b").join(ends(signal, "c", "d"), "symbol").select("symbol", F.greatest("a", "c").alias("lo"), F.least("b", "d").alias("hi"))
    out = J.asof_join(J.grid(bounds, "symbol", "lo", "hi", "12 hours"), price, "symbol", "ts", ["price"], "event_id", "p_")
    out = J.asof_join(out, signal, "symbol", "ts", ["signal"], "event_id", "q_")
    age = lambda c: F.unix_micros("ts") - F.unix_micros(c)
    apart = lambda c: F.coalesce(F.col("ts") != F.col(c), F.lit(True))
    return out.select("symbol", F.unix_micros("ts").alias("at_us"), r("p_price").alias("price"), r(F.coalesce("q_signal", F.lit(0.0))).alias("signal"), age("p_ts").alias("price_age_us"), age("q_ts").alias("signal_age_us"), (apart("p_ts") | apart("q_ts")).alias("is_interpolated"))


# ---- tests, regressions, resampling


@query(f"""{DAILY}, f AS (SELECT symbol, count(*) AS n, regr_r2(cs, rv) AS r2, corr(cs, rv) AS c FROM daily WHERE cs IS NOT NULL AND rv IS NOT NULL GROUP BY 1)
 SELECT symbol, n, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adjusted_r2, round(r2 / nullif(1 - r2, 0) * (n - 2), 3) AS f, round(c * sqrt((n - 2) / nullif(1 - c * c, 0)), 4) AS t_of_correlation FROM f WHERE n > 2""")
def reg01_fit(spark, sf):
    """Adjusted R2 and F of the single regression, t of the correlation."""
    f = daily(spark, sf).where("cs is not null and rv is not null").groupBy("symbol").agg(n_rows().alias("n"), F.regr_r2("cs", "rv").alias("r2"), F.corr("cs", "rv").alias("c")).where("n > 2")
    n, r2, c = F.col("n"), F.col("r2"), F.col("c")
    return f.select("symbol", "n", r(1 - (1 - r2) * (n - 1) / (n - 2)).alias("adjusted_r2"), r(F.try_divide(r2, 1 - r2) * (n - 2), 3).alias("f"), r(c * F.sqrt(F.try_divide(n - 2, 1 - c * c)), 4).alias("t_of_correlation"))


@query(f"""{_ROWS}, x AS (SELECT symbol, regime, rep, cs, {_HASH} AS h FROM n, range(200) t(rep)), g AS (SELECT symbol, regime, rep, sum(w * cs) / nullif(sum(w), 0) AS m FROM (SELECT *, {_WEIGHT} AS w FROM x) GROUP BY 1, 2, 3)
 SELECT symbol, regime, round(quantile_cont(m, 0.025), 4) AS low, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.975), 4) AS high FROM g GROUP BY 1, 2""")
def rsp01_mean_by_regime(spark, sf):
    m = R.bootstrap_sums(_numbered(spark, sf), "n", {"m": (F.col("cs"), F.lit(1.0))}, 200, ["symbol", "regime"])
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return m.groupBy("symbol", "regime").agg(r(F.get(q, 0), 4).alias("low"), r(F.avg("m"), 4).alias("mean"), r(F.get(q, 1), 4).alias("high"))


@query(f"""{_ROWS}, x AS (SELECT symbol, rep, cs AS y, 100 * rv AS x, {_HASH} AS h FROM n, range(200) t(rep) WHERE rv IS NOT NULL), g AS (SELECT symbol, rep, (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) / nullif(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2), 0) AS b FROM (SELECT *, {_WEIGHT} AS w FROM x) GROUP BY 1, 2)
 SELECT symbol, round(quantile_cont(b, 0.025), 3) AS low, round(avg(b), 3) AS mean, round(quantile_cont(b, 0.975), 3) AS high FROM g GROUP BY 1""")
def rsp01_slope(spark, sf):
    d = _numbered(spark, sf).where("rv is not null").withColumn("x", 100 * F.col("rv"))
    x, y, one = F.col("x"), F.col("cs"), F.lit(1.0)
    g = R.bootstrap_sums(d, "n", {"xy": (x * y, one), "mx": (x, one), "my": (y, one), "xx": (x * x, one)}, 200, ["symbol"])
    g = g.withColumn("b", F.try_divide(F.col("xy") - F.col("mx") * F.col("my"), F.col("xx") - F.col("mx") * F.col("mx")))
    q = F.percentile("b", F.array(F.lit(0.025), F.lit(0.975)))
    return g.groupBy("symbol").agg(r(F.get(q, 0), 3).alias("low"), r(F.avg("b"), 3).alias("mean"), r(F.get(q, 1), 3).alias("high"))


@query(f"""{_ROWS}, x AS (SELECT symbol, rep, n, cs, (strength = 'extreme')::INT AS e, {_HASH} AS h FROM n, range(100) t(rep)), k AS (SELECT symbol, rep, cs, row_number() OVER (PARTITION BY symbol, rep ORDER BY h, n) <= sum(e) OVER (PARTITION BY symbol, rep) AS pick FROM x),
 g AS (SELECT symbol, rep, avg(CASE WHEN pick THEN cs END) - avg(CASE WHEN NOT pick THEN cs END) AS gap FROM k GROUP BY 1, 2), o AS (SELECT symbol, avg(CASE WHEN strength = 'extreme' THEN cs END) - avg(CASE WHEN strength <> 'extreme' THEN cs END) AS seen FROM n GROUP BY 1)
 SELECT symbol, count(*) AS replicates, round(any_value(seen), 4) AS gap, round(avg((abs(gap) >= abs(seen))::INT), 6) AS p FROM g JOIN o USING (symbol) GROUP BY 1""")
def rsp02_permutation_p(spark, sf):
    """The share of relabellings whose gap is at least as wide as the seen one."""
    d = _numbered(spark, sf)
    extreme = F.col("strength") == "extreme"
    seen = d.groupBy("symbol").agg((F.avg(F.when(extreme, F.col("cs"))) - F.avg(F.when(~extreme, F.col("cs")))).alias("seen"))
    g = R.permuted_gap(d, "n", "cs", 100).join(seen, "symbol")
    return g.groupBy("symbol").agg(n_rows().alias("replicates"), r(F.first("seen"), 4).alias("gap"), r(F.avg((F.abs("gap") >= F.abs("seen")).cast("int"))).alias("p"))


_MANY = 10_000


@query(f"""{_ROWS}, x AS (SELECT symbol, rep, cs, strength, {_HASH} AS h FROM n, range({_MANY}) t(rep) WHERE strength IN ('extreme', 'neutral')), g AS (SELECT symbol, rep, sum(CASE WHEN strength = 'extreme' THEN w * cs END) / nullif(sum(CASE WHEN strength = 'extreme' THEN w END), 0) - sum(CASE WHEN strength = 'neutral' THEN w * cs END) / nullif(sum(CASE WHEN strength = 'neutral' THEN w END), 0) AS gap FROM (SELECT *, {_WEIGHT} AS w FROM x) GROUP BY 1, 2)
 SELECT symbol, count(gap) AS replicates, round(quantile_cont(gap, 0.025), 4) AS low, round(avg(gap), 4) AS mean, round(quantile_cont(gap, 0.975), 4) AS high, round(stddev_samp(gap), 4) AS se FROM g GROUP BY 1""")
def rsp01_gap_interval(spark, sf):
    """Ten thousand replicates."""
    g = R.bootstrap_gap(_numbered(spark, sf), "n", "cs", _MANY)
    q = F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975)))
    return g.groupBy("symbol").agg(F.count("gap").alias("replicates"), r(F.get(q, 0), 4).alias("low"), r(F.avg("gap"), 4).alias("mean"), r(F.get(q, 1), 4).alias("high"), r(F.stddev_samp("gap"), 4).alias("se"))


@query(f"""{_ROWS}, x AS (SELECT symbol, rep, cs, {_HASH} AS h FROM n, range(1000) t(rep)), g AS (SELECT symbol, rep, sqrt(sum(w * cs * cs) / nullif(sum(w), 0) - pow(sum(w * cs) / nullif(sum(w), 0), 2)) / nullif(sum(w * cs) / nullif(sum(w), 0), 0) AS v FROM (SELECT *, {_WEIGHT} AS w FROM x) GROUP BY 1, 2)
 SELECT symbol, round(quantile_cont(v, 0.025), 5) AS low, round(median(v), 5) AS median, round(quantile_cont(v, 0.975), 5) AS high FROM g GROUP BY 1""")
def rsp01_any_statistic(spark, sf):
    """The interval of a statistic that the caller gives, here the coefficient of variation of spreads."""
    y, one = F.col("cs"), F.lit(1.0)
    m, m2 = F.try_divide("y", "w"), F.try_divide("yy", "w")
    g = R.resampled(_numbered(spark, sf), "n", {"w": one, "y": y, "yy": y * y}, {"v": F.try_divide(F.sqrt(m2 - m * m), m)}, 1000, ["symbol"])
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return g.groupBy("symbol").agg(*[r(F.get(q, i), 5).alias(n) for i, n in enumerate(("low", "median", "high"))])


@query()
def rsp02_permutation_many(spark, sf):
    """Ten thousand relabellings that keep the number of extreme days: two-sided p of the gap over all other days, and the spread of the null."""
    d = _numbered(spark, sf)
    extreme = F.col("strength") == "extreme"
    seen = d.groupBy("symbol").agg((F.avg(F.when(extreme, F.col("cs"))) - F.avg(F.when(F.coalesce(~extreme, F.lit(True)), F.col("cs")))).alias("seen"))
    g = R.permuted_gaps(d, "n", "cs", extreme, _MANY).join(seen, "symbol")
    return g.groupBy("symbol").agg(n_rows().alias("replicates"), r(F.first("seen"), 4).alias("gap"), r(F.avg((F.abs("gap") >= F.abs("seen")).cast("int")), 4).alias("p"), r(F.avg("gap"), 4).alias("null_mean"), r(F.stddev_samp("gap"), 4).alias("null_std"))


@query(f"""{DAILY}, b AS (SELECT symbol, regime, (cs - min(cs) OVER p) / nullif(max(cs) OVER p - min(cs) OVER p, 0) AS x, (rv - min(rv) OVER p) / nullif(max(rv) OVER p - min(rv) OVER p, 0) AS y FROM daily WHERE cs IS NOT NULL AND rv IS NOT NULL WINDOW p AS (PARTITION BY symbol)),
 m AS (SELECT symbol, s.a, s.b, avg(CASE WHEN regime = 'extreme_greed' THEN s.a * x + s.b * y END) AS g, avg(CASE WHEN regime = 'extreme_fear' THEN s.a * x + s.b * y END) AS f, avg(CASE WHEN regime = 'neutral' THEN s.a * x + s.b * y END) AS n FROM b, (VALUES {", ".join(map(str, _GRID))}) s(a, b) GROUP BY 1, 2, 3)
 SELECT symbol, count(*) AS scenarios, round(avg(coalesce(g > n AND f > n, false)::INT), 6) AS preserved FROM m GROUP BY 1""")
def rsp05_ranking_preserved(spark, sf):
    """The share of weightings under which both extremes stay above neutral."""
    p = Window.partitionBy("symbol")
    scaled = lambda c: F.try_divide(F.col(c) - F.min(c).over(p), F.max(c).over(p) - F.min(c).over(p))
    d = daily(spark, sf).where("cs is not null and rv is not null").select("symbol", "regime", scaled("cs").alias("x"), scaled("rv").alias("y"))
    sums = d.groupBy("symbol", "regime").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    u = F.col("a") * F.col("x") + F.col("b") * F.col("y")
    m = R.sweep(sums, _GRID, ["a", "b"]).groupBy("symbol", "a", "b").agg(*[F.max(F.when(F.col("regime") == k, u)).alias(n) for k, n in (("extreme_greed", "g"), ("extreme_fear", "f"), ("neutral", "n"))])
    return m.groupBy("symbol").agg(n_rows().alias("scenarios"), r(F.avg(F.coalesce((F.col("g") > F.col("n")) & (F.col("f") > F.col("n")), F.lit(False)).cast("int"))).alias("preserved"))


@query(f"""{DAILY}, g AS (SELECT symbol, year(date) AS year, avg(CASE WHEN strength = 'extreme' THEN cs END) - avg(CASE WHEN strength = 'neutral' THEN cs END) AS gap FROM daily GROUP BY 1, 2 HAVING count(CASE WHEN strength = 'extreme' THEN cs END) >= 3 AND count(CASE WHEN strength = 'neutral' THEN cs END) >= 3)
 SELECT symbol, count(*) AS years, sum((gap > 0)::INT)::BIGINT AS wider, round(min(gap), 4) AS least, round(max(gap), 4) AS most FROM g GROUP BY 1""")
def tst15_consistency(spark, sf):
    """In how many years extreme days have the wider spread."""
    g = stats.premium(daily(spark, sf).withColumn("year", F.year("date")), ["symbol", "year"], "cs")
    return g.groupBy("symbol").agg(n_rows().alias("years"), F.sum((F.col("gap") > 0).cast("int")).alias("wider"), r(F.min("gap"), 4).alias("least"), r(F.max("gap"), 4).alias("most"))


# ---- events and the back-test


_CUTS = (0.6, 0.7, 0.8)


@query(f"""{_RECURSIVE}, f AS (SELECT symbol, date, (fg - 50) / 50 AS v, row_number() {S} AS n, {", ".join(f"lead(close, {h}) {S} / close - 1 AS r{h}" for h in (1, 3, 5, 7))} FROM daily), e AS (SELECT f.*, cut::DOUBLE AS cut FROM f, (VALUES {", ".join(f"({c})" for c in _CUTS)}) t(cut) WHERE abs(v) >= cut AND r7 IS NOT NULL),
 k AS (SELECT symbol, cut, min(n) AS n FROM e GROUP BY 1, 2 UNION ALL SELECT k.symbol, k.cut, (SELECT min(e.n) FROM e WHERE e.symbol = k.symbol AND e.cut = k.cut AND e.n >= k.n + 5) FROM k WHERE k.n IS NOT NULL),
 l AS (SELECT e.symbol, e.cut, h, e.n, e.v, CASE h WHEN 1 THEN r1 WHEN 3 THEN r3 WHEN 5 THEN r5 ELSE r7 END AS x FROM e JOIN k ON e.symbol = k.symbol AND e.cut = k.cut AND e.n = k.n, (VALUES (1), (3), (5), (7)) t(h)),
 u AS (SELECT *, x - avg(x) OVER p AS u, row_number() OVER (PARTITION BY symbol, cut, h ORDER BY n) AS i, count(*) OVER p AS c, floor(4 * pow(count(*) OVER p / 100.0, 2.0 / 9)) AS lags FROM l WINDOW p AS (PARTITION BY symbol, cut, h)),
 a AS (SELECT a.symbol, a.cut, a.h, sum(2 * (1 - (a.i - b.i) / (a.lags + 1)) * a.u * b.u / a.c) AS s FROM u a JOIN u b ON a.symbol = b.symbol AND a.cut = b.cut AND a.h = b.h AND a.i - b.i BETWEEN 1 AND a.lags GROUP BY 1, 2, 3),
 m AS (SELECT symbol, cut, h, count(*) AS events, avg(x) AS mean, var_samp(x) AS var, avg(((v > 0) = (x > 0))::INT) AS hit FROM l GROUP BY 1, 2, 3)
 SELECT symbol, cut, h, events, round(mean, 6) AS mean, round(hit, 6) AS hit, round(sqrt(greatest(var + coalesce(s, 0), 0) / events), 6) AS se FROM m LEFT JOIN a USING (symbol, cut, h) WHERE events >= 5""")
def evt01_thresholds(spark, sf):
    """Events at least five days apart by threshold: mean forward return, its share in the index's direction, robust standard error."""
    ahead = [F.struct(F.lit(h).alias("h"), (F.lead("close", h).over(W.by_day()) / F.col("close") - 1).alias("x")) for h in (1, 3, 5, 7)]
    d = daily(spark, sf).select("symbol", E.sentiment_score(F.col("fg")).alias("v"), F.row_number().over(W.by_day()).alias("n"), F.array(*ahead).alias("a"))
    d = R.sweep(d.where(F.col("a")[3]["x"].isNotNull()), [(c,) for c in _CUTS], ["cut"]).where("abs(v) >= cut")
    events = scans.spaced_events(d, 5, key=["symbol", "cut"]).select("symbol", "cut", "n", "v", F.explode("a").alias("a")).select("symbol", "cut", "n", "v", "a.*")
    m = stats.mean_with_auto_lags(events.withColumn("hit", ((F.col("v") > 0) == (F.col("x") > 0)).cast("int")), "x", ["symbol", "cut", "h"], "n", F.avg("hit").alias("hit"))
    return m.where("n >= 5").select("symbol", "cut", "h", F.col("n").alias("events"), *_each("mean", "hit", "se"))


@query(f"""{_RECURSIVE}, c AS (SELECT symbol, date, close, regime, row_number() {S} AS n, count(*) OVER (PARTITION BY symbol) AS last FROM daily), t AS (SELECT symbol, 0::BIGINT AS n, NULL::BIGINT AS at, NULL::DOUBLE AS paid, NULL::BIGINT AS held, NULL::DOUBLE AS net FROM (SELECT DISTINCT symbol FROM c)
 UNION ALL SELECT c.symbol, c.n, CASE WHEN t.at IS NULL AND c.regime = 'extreme_fear' THEN c.n WHEN t.at IS NOT NULL AND (c.regime NOT IN ('extreme_fear', 'fear') OR c.n - t.at >= 10 OR c.n = c.last) THEN NULL ELSE t.at END,
 CASE WHEN t.at IS NULL AND c.regime = 'extreme_fear' THEN c.close ELSE t.paid END, CASE WHEN t.at IS NOT NULL AND (c.regime NOT IN ('extreme_fear', 'fear') OR c.n - t.at >= 10 OR c.n = c.last) THEN c.n - t.at END,
 CASE WHEN t.at IS NOT NULL AND (c.regime NOT IN ('extreme_fear', 'fear') OR c.n - t.at >= 10 OR c.n = c.last) THEN c.close / t.paid - 1 - 0.002 END FROM t JOIN c ON c.symbol = t.symbol AND c.n = t.n + 1),
 b AS (SELECT symbol, arg_max(close, date) / arg_min(close, date) - 1 AS hold FROM daily GROUP BY 1)
 SELECT symbol, count(*) AS trades, round(avg(held), 6) AS mean_held, round(avg((net > 0)::INT), 6) AS win_rate, round(sum(net), 6) AS total_net, round(avg(net) / nullif(stddev_pop(net), 0), 6) AS sharpe, round(any_value(hold), 6) AS buy_and_hold FROM t JOIN b USING (symbol) WHERE held IS NOT NULL GROUP BY 1""")
def bt01_summary(spark, sf):
    d = daily(spark, sf)
    hold = d.groupBy("symbol").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("hold"))
    t = scans.contrarian_trades(d).groupBy("symbol").agg(n_rows().alias("trades"), F.avg("held").alias("mean_held"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"), F.sum("net").alias("total_net"), F.try_divide(F.avg("net"), F.stddev_pop("net")).alias("sharpe"))
    return t.join(hold, "symbol").select("symbol", "trades", *_each("mean_held", "win_rate", "total_net", "sharpe"), r("hold").alias("buy_and_hold"))


@query(f"""{DAILY}, x AS (SELECT date, avg(fg) AS fg FROM daily GROUP BY 1), t AS (SELECT {REGIME} AS regime, lead({REGIME}) OVER (ORDER BY date) AS next FROM x), g AS (SELECT regime, count(*) AS days, sum((regime = next)::INT)::BIGINT AS stays FROM t WHERE next IS NOT NULL GROUP BY 1)
 SELECT regime, days, stays, round(stays / days, 6) AS persistence FROM g""")
def win18_persistence(spark, sf):
    """How often the index, one value a day, keeps its regime."""
    d = V.index_daily(spark, sf).join(V.bars(spark, sf).select("date").distinct(), "date").withColumn("regime", E.bin_regime(F.col("fg")))
    t = d.withColumn("next", F.lead("regime").over(Window.orderBy("date"))).where("next is not null")
    return t.groupBy("regime").agg(n_rows().alias("days"), F.sum((F.col("regime") == F.col("next")).cast("int")).alias("stays")).withColumn("persistence", r(F.col("stays") / F.col("days")))
