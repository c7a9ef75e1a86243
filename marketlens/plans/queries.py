"""Registered queries over the given tables, each beside the same query in SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import expressions as E
from marketlens.operators import joins as J
from marketlens.operators import resample as R
from marketlens.operators import scans, stats
from marketlens.operators import windows as W
from marketlens.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; days are returned as text, which every client reads alike."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

        QUERIES[f.__name__] = run
        if sql:
            day = next((c for c in ("date", "day") if re.search(rf"\b{c}\b", re.split(r"\bSELECT\b", _outer(sql))[1].split(" FROM ")[0])), None)
            ORACLE[f.__name__] = f"SELECT * REPLACE (strftime({day}, '%Y-%m-%d') AS {day}) FROM ({sql})" if day else sql
        return f

    return add


def _outer(sql: str) -> str:
    """The query without what stands in parentheses."""
    while (flat := re.sub(r"\([^()]*\)", "", sql)) != sql:
        sql = flat
    return sql


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_REGIME = "CASE WHEN fg IS NULL THEN 'unknown' WHEN fg <= {0} THEN 'extreme_fear' WHEN fg <= {1} THEN 'fear' WHEN fg <= {2} THEN 'neutral' WHEN fg <= {3} THEN 'greed' ELSE 'extreme_greed' END"
REGIME = _REGIME.format(*E.CUTS)
STRENGTH = "CASE WHEN regime IN ('extreme_fear','extreme_greed') THEN 'extreme' WHEN regime IN ('fear','greed') THEN 'moderate' WHEN regime = 'neutral' THEN 'neutral' END"
S = "OVER (PARTITION BY symbol ORDER BY date)"


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


BARS = f"""WITH bars AS (SELECT o_orderkey % {V.SYMBOLS} AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
 min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume, count(*) AS trades FROM orders GROUP BY 1, 2),
idx AS (SELECT CAST(o_orderdate AS DATE) AS date, 100 * avg(CASE WHEN o_orderpriority <= '3' THEN 1 ELSE 0 END) AS fg FROM orders GROUP BY 1)"""
CS_K = "(3 - 2 * sqrt(2))"
DAILY = f"""{BARS}, d0 AS (SELECT symbol, date, open, high, low, close, volume, trades, fg, {REGIME} AS regime, ln(close / lag(close) {S}) AS ret, pow(ln(high / low), 2) AS hl FROM bars JOIN idx USING (date)),
d1 AS (SELECT *, (sqrt(2 * sum(hl) {over(2)}) - sqrt(sum(hl) {over(2)})) / {CS_K} - sqrt(pow(ln(max(high) {over(2)} / min(low) {over(2)}), 2) / {CS_K}) AS a, count(*) {over(2)} AS n2 FROM d0),
daily AS (SELECT symbol, date, open, high, low, close, volume, trades, fg, regime, ret, {STRENGTH} AS strength,
 CASE WHEN n2 = 2 THEN greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0) * 10000 END AS cs,
 CASE WHEN count(ret) {over(7)} = 7 THEN stddev_samp(ret) {over(7)} END AS rv, sqrt(hl / (4 * ln(2))) AS pk FROM d1)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars joined with the index, features and regimes: the hand-over table of every study."""
    df = V.bars(spark, sf_dir).join(V.index_daily(spark, sf_dir), "date").withColumn("regime", E.bin_regime(F.col("fg")))
    df = W.parkinson(W.realised_volatility(W.corwin_schultz(W.log_return(df)), 7))
    return df.withColumn("strength", E.strength(F.col("regime")))


# ---- sources and filters


@query(f"{BARS} SELECT symbol, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, trades FROM bars")
def src01_bars(spark, sf):
    return V.bars(spark, sf).select("symbol", "date", *[r(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume")], "trades")


@query(f"{BARS} SELECT date, round(fg, 6) AS fg, {REGIME} AS regime FROM idx")
def src03_index(spark, sf):
    return V.index_daily(spark, sf).select("date", r("fg").alias("fg"), E.bin_regime(F.col("fg")).alias("regime"))


@query("""SELECT content_id, parent_id, kind, chars FROM (SELECT conv_id || '-' || turn AS content_id, CASE WHEN turn > 0 THEN conv_id || '-0' END AS parent_id,
 CASE WHEN turn = 0 THEN 'submission' ELSE 'comment' END AS kind, length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn) AS n FROM conversations) WHERE n <= 50""")
def src17_recent_posts(spark, sf):
    key = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    n = F.row_number().over(Window.partitionBy("role").orderBy(F.col("conv_id").desc(), "turn"))
    c = V.table(spark, sf, "conversations").withColumn("n", n).where("n <= 50")
    return c.select(key(F.col("turn")).alias("content_id"), F.when(F.col("turn") > 0, key(F.lit(0))).alias("parent_id"), F.when(F.col("turn") == 0, "submission").otherwise("comment").alias("kind"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


@query(f"{DAILY} SELECT year(date) AS year, count(*) AS days, count(DISTINCT date) AS dates FROM daily WHERE date >= DATE '1993-01-01' AND date < DATE '1997-01-01' GROUP BY 1 HAVING count(*) >= 30")
def flt02_date_range(spark, sf):
    d = daily(spark, sf).where("date >= date'1993-01-01' and date < date'1997-01-01'")
    return d.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.countDistinct("date").alias("dates")).where("days >= 30")


@query(f"{DAILY}, q AS (SELECT symbol, round(quantile_cont(round(cs, 4), 0.99), 4) AS q99 FROM daily GROUP BY 1) SELECT symbol, count(*) AS kept, round(avg(round(cs, 4)), 4) AS mean_cs FROM daily JOIN q USING (symbol) WHERE round(cs, 4) > 0 AND round(cs, 4) < q99 GROUP BY 1")
def flt03_outliers(spark, sf):
    d = daily(spark, sf).withColumn("cs", r("cs", 4))
    q = d.groupBy("symbol").agg(r(F.percentile("cs", F.lit(0.99)), 4).alias("q99"))
    return d.join(q, "symbol").where("cs > 0 and cs < q99").groupBy("symbol").agg(F.count(F.lit(1)).alias("kept"), r(F.avg("cs"), 4).alias("mean_cs"))


@query(f"{DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM daily) SELECT symbol, date, round(close, 4) AS close FROM n WHERE back <= 100")
def flt05_last_hundred(spark, sf):
    d = V.bars(spark, sf).join(V.index_daily(spark, sf), "date")
    d = d.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc())))
    return d.where("back <= 100").select("symbol", "date", r("close", 4).alias("close"))


@query(f"{DAILY}, n AS (SELECT *, row_number() {S} AS n FROM daily) SELECT symbol, date, round(close, 4) AS close FROM n WHERE n % 4 = 1")
def flt06_every_fourth(spark, sf):
    d = V.bars(spark, sf).join(V.index_daily(spark, sf), "date").withColumn("n", F.row_number().over(W.by_day()))
    return d.where("n % 4 = 1").select("symbol", "date", r("close", 4).alias("close"))


# ---- expressions


@query(f"""{BARS} SELECT date, round((fg - 50) / 50, 6) AS score, round(abs(fg - 50) / 50, 6) AS distance, {_REGIME.format(*E.PLACEBO_CUTS)} AS placebo, round(greatest(0.0, least(1.0, (fg - 30) / 120)), 6) AS scaled,
 isodow(date) - 1 AS dow, month(date) AS month, CASE WHEN day(date) >= 28 THEN 1 ELSE 0 END AS month_end FROM idx""")
def exp01_scores(spark, sf):
    fg = F.col("fg")
    return V.index_daily(spark, sf).select(
        "date", r(E.sentiment_score(fg)).alias("score"), r(E.distance_from_neutral(fg)).alias("distance"), E.bin_regime(fg, E.PLACEBO_CUTS).alias("placebo"), r(E.normalise(fg, 30, 150)).alias("scaled"),
        F.weekday("date").cast("long").alias("dow"), F.month("date").cast("long").alias("month"), F.when(F.day("date") >= 28, 1).otherwise(0).alias("month_end"),
    )


@query("""WITH b AS (SELECT event_id, value AS p FROM events), f AS (SELECT event_id, p - 1 AS bid, p + 1 AS ask, 6.0 + 3 * (event_id % 5) AS bv, 6.0 + 3 * (event_id % 7) AS av FROM b)
SELECT event_id, round((bid + ask) / 2, 6) AS mid_price, round((ask - bid) / ((bid + ask) / 2) * 10000, 4) AS spread_bps, bv AS bid_volume, av AS ask_volume, round((bv - av) / (bv + av), 6) AS imbalance FROM f""")
def exp09_book_features(spark, sf):
    """Three levels a side around each event's value."""
    level = lambda sign, mod: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array(F.col("value") + sign * i, i + F.col("event_id") % mod + 0.0))
    f = E.book_features(level(-1, 5), level(1, 7), ieee=True)
    return V.table(spark, sf, "events").select("event_id", r(f["mid_price"]).alias("mid_price"), r(f["spread_bps"], 4).alias("spread_bps"), f["bid_volume"].alias("bid_volume"), f["ask_volume"].alias("ask_volume"), r(f["imbalance"]).alias("imbalance"))


@query("""WITH p AS (SELECT vec_id, label, unnest([1, 4, 7, 10]) AS i, embedding FROM embeddings), e AS (SELECT vec_id, i, exp(embedding[i]::DOUBLE) AS a, exp(embedding[i + 1]::DOUBLE) AS b, exp(embedding[i + 2]::DOUBLE) AS c FROM p),
 s AS (SELECT vec_id, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM e),
 m AS (SELECT vec_id, avg(p0) AS m0, avg(p1) AS m1, avg(p2) AS m2, (stddev_pop(p0) + stddev_pop(p1) + stddev_pop(p2)) / 3 AS epi FROM s GROUP BY 1)
 SELECT vec_id, round(m2 - m0, 6) AS score, round(epi, 6) AS epistemic, round(-(m0 * ln(m0) + m1 * ln(m1) + m2 * ln(m2)), 6) AS entropy FROM m""")
def exp14_probability_samples(spark, sf):
    """Four sampled probability triples per row from vector slices: score, epistemic spread, predictive entropy."""
    soft = lambda i: F.transform(F.slice("embedding", i, 3), lambda x: F.exp(x.cast("double")))
    share = lambda xs: F.transform(xs, lambda x: x / F.aggregate(xs, F.lit(0.0), lambda a, y: a + y))
    e = V.table(spark, sf, "embeddings").select("vec_id", F.array(*[share(soft(i)) for i in (1, 4, 7, 10)]).alias("samples"))
    part = lambda k: F.transform("samples", lambda s: F.get(s, k))
    e = e.withColumns({f"s{k}": part(k) for k in range(3)})
    mean = F.array(*[E.mean_of(F.col(f"s{k}")) for k in range(3)])
    epi = sum((E.pop_std(F.col(f"s{k}")) for k in range(3)), F.lit(0.0)) / 3
    return e.select("vec_id", r(F.get(mean, 2) - F.get(mean, 0)).alias("score"), r(epi).alias("epistemic"), r(E.entropy(mean)).alias("entropy"))


_FOUND = lambda words: "(" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in words) + ")"


@query(f"SELECT doc_id, {_FOUND(E.POSITIVE)} - {_FOUND(E.NEGATIVE)} AS score, CASE WHEN {_FOUND(E.POSITIVE)} > {_FOUND(E.NEGATIVE)} THEN 'positive' WHEN {_FOUND(E.POSITIVE)} < {_FOUND(E.NEGATIVE)} THEN 'negative' ELSE 'neutral' END AS class, {_FOUND(E.UNCERTAIN)} > 0 AS uncertain FROM documents")
def exp18_keyword_score(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", (E.found_words(t, E.POSITIVE) - E.found_words(t, E.NEGATIVE)).alias("score"), E.keyword_class(t).alias("class"), (E.found_words(t, E.UNCERTAIN) > 0).alias("uncertain"))


@query(f"""{DAILY}, x AS (SELECT symbol, date, CASE WHEN fg > 0 THEN fg / 100 END AS a, rv AS b, CASE WHEN trades > 1 THEN pk END AS c FROM daily)
 SELECT symbol, date, round(((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) / 3.0, 6) AS complete,
 round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / nullif((a IS NOT NULL)::INT * 0.5 + (b IS NOT NULL)::INT * 0.3 + (c IS NOT NULL)::INT * 0.2, 0), 6) AS risk FROM x""")
def exp21_weighted_components(spark, sf):
    d = daily(spark, sf)
    a, c = F.when(F.col("fg") > 0, F.col("fg") / 100), F.when(F.col("trades") > 1, F.col("pk"))
    return d.select("symbol", "date", r(E.completeness(a, F.col("rv"), c)).alias("complete"), r(E.weighted_mean((a, 0.5), (F.col("rv"), 0.3), (c, 0.2))).alias("risk"))


@query(f"{DAILY} SELECT symbol, date, round(coalesce(0.7 * nullif(pk, 0) + 0.3 * rv, nullif(pk, 0), rv, 0.25), 6) AS vol FROM daily")
def exp23_composite_volatility(spark, sf):
    null = F.lit(None).cast("double")
    return daily(spark, sf).select("symbol", "date", r(E.composite_volatility(F.col("pk"), F.col("rv"), null, 0.25)).alias("vol"))


# ---- joins


@query(f"{DAILY} SELECT symbol, date, round(fg, 6) AS fg, regime, strength, round(ret, 6) AS ret, round(cs, 4) AS cs, round(rv, 6) AS rv, round(pk, 6) AS pk FROM daily")
def join01_daily_features(spark, sf):
    return daily(spark, sf).select("symbol", "date", r("fg").alias("fg"), "regime", "strength", r("ret").alias("ret"), r("cs", 4).alias("cs"), r("rv").alias("rv"), r("pk").alias("pk"))


@query(f"""{BARS}, sparse AS (SELECT * FROM idx WHERE day(date) % 3 = 0) SELECT symbol, date, round(last_value(fg IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS fg FROM bars LEFT JOIN sparse USING (date)""")
def join02_forward_fill(spark, sf):
    sparse = V.index_daily(spark, sf).where(F.day("date") % 3 == 0)
    return J.forward_fill(V.bars(spark, sf), sparse, "date", "fg", "date").select("symbol", "date", r("fg").alias("fg"))


@query("""WITH l AS (SELECT event_id, user_id AS symbol, ts, value AS price FROM events WHERE event_type = 'click'), v AS (SELECT user_id AS symbol, ts, value FROM events WHERE event_type = 'view')
 SELECT l.event_id, l.symbol, round(l.price, 6) AS price, round(v.value, 6) AS r_price, epoch_us(l.ts) - epoch_us(v.ts) AS age_us FROM l ASOF LEFT JOIN v ON l.symbol = v.symbol AND l.ts >= v.ts""")
def join06_asof(spark, sf):
    t = V.ticks(spark, sf)
    out = J.asof_join(t.where("source = 'click'").select("event_id", "symbol", "ts", "price"), t.where("source = 'view'"), "symbol", "ts", ["price"], "event_id")
    return out.select("event_id", "symbol", r("price").alias("price"), r("r_price").alias("r_price"), (F.unix_micros("ts") - F.unix_micros("r_ts")).alias("age_us"))


@query("""WITH b AS (SELECT user_id AS symbol, date_trunc('day', min(ts)) AS lo, max(ts) AS hi FROM events GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS ts FROM b)
 SELECT g.symbol, epoch_us(g.ts) AS at_us, round(e.value, 6) AS price, CASE WHEN e.ts IS NULL THEN true ELSE epoch_us(g.ts) - epoch_us(e.ts) > 21600000000 END AS stale FROM g ASOF LEFT JOIN (SELECT user_id AS symbol, ts, value FROM events) e ON g.symbol = e.symbol AND g.ts >= e.ts""")
def join07_grid_replay(spark, sf):
    t = V.ticks(spark, sf)
    bounds = t.groupBy("symbol").agg(F.date_trunc("day", F.min("ts")).alias("lo"), F.max("ts").alias("hi"))
    out = J.asof_join(J.grid(bounds, "symbol", "lo", "hi", "6 hours"), t, "symbol", "ts", ["price"], "event_id")
    age = F.unix_micros("ts") - F.unix_micros("r_ts")
    return out.select("symbol", F.unix_micros("ts").alias("at_us"), r("r_price").alias("price"), F.coalesce(age > 21_600_000_000, F.lit(True)).alias("stale"))


@query(f"""{DAILY}, m AS (SELECT symbol, date, regime, lag(regime) {S} AS before, avg(cs) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, cs, avg(cs) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM daily)
 SELECT symbol, date, round(b, 4) AS before, round(cs, 4) AS at, round(a, 4) AS after FROM m WHERE regime IN ('extreme_fear','extreme_greed') AND before NOT IN ('extreme_fear','extreme_greed')""")
def join11_transition_windows(spark, sf):
    d = W.transitions(daily(spark, sf))
    return J.neighbourhood(d, F.col("enter_extreme"), 5, "cs").select("symbol", "date", r("before", 4).alias("before"), r("at", 4).alias("at"), r("after", 4).alias("after"))


@query(f"""{DAILY}, g AS (SELECT symbol, regime, avg(cs) AS m FROM daily GROUP BY 1, 2), a AS (SELECT * FROM g WHERE symbol = 0), b AS (SELECT * FROM g WHERE symbol = 1)
 SELECT coalesce(a.regime, b.regime) AS regime, round(a.m, 4) AS first, round(b.m, 4) AS second, CASE WHEN a.m IS NULL OR b.m IS NULL THEN NULL ELSE sign(a.m) = sign(b.m) END AS agree FROM a FULL JOIN b ON a.regime = b.regime""")
def join12_compare_symbols(spark, sf):
    g = daily(spark, sf).groupBy("symbol", "regime").agg(F.avg("cs").alias("m"))
    a, b = g.where("symbol = 0").select("regime", F.col("m").alias("x")), g.where("symbol = 1").select("regime", F.col("m").alias("y"))
    return a.join(b, "regime", "full").select("regime", r("x", 4).alias("first"), r("y", 4).alias("second"), (F.signum("x") == F.signum("y")).alias("agree"))


# ---- aggregations


@query(f"""{DAILY} SELECT symbol, regime, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS pct, round(avg(cs), 4) AS mean_cs, round(stddev_samp(cs), 4) AS std_cs, round(median(cs), 4) AS median_cs, round(avg(rv), 6) AS mean_rv FROM daily GROUP BY 1, 2""")
def agg01_regime_statistics(spark, sf):
    g = daily(spark, sf).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), r(F.avg("cs"), 4).alias("mean_cs"), r(F.stddev_samp("cs"), 4).alias("std_cs"), r(F.percentile("cs", F.lit(0.5)), 4).alias("median_cs"), r(F.avg("rv")).alias("mean_rv"))
    return g.withColumn("pct", r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))))


@query(f"{DAILY} SELECT regime, " + ", ".join(f"round(avg(CASE WHEN symbol = {k} THEN cs END), 4) AS s{k}" for k in range(V.SYMBOLS)) + " FROM daily GROUP BY 1")
def agg04_pivot(spark, sf):
    p = daily(spark, sf).groupBy("regime").pivot("symbol", list(range(V.SYMBOLS))).agg(F.avg("cs"))
    return p.select("regime", *[r(F.col(str(k)), 4).alias(f"s{k}") for k in range(V.SYMBOLS)])


@query(f"""{DAILY}, m AS (SELECT symbol, ret, ret - avg(ret) OVER (PARTITION BY symbol) AS u FROM daily WHERE ret IS NOT NULL)
 SELECT symbol, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, round(avg(u*u*u) / pow(avg(u*u), 1.5), 6) AS skew, round(avg(u*u*u*u) / pow(avg(u*u), 2) - 3, 6) AS kurt, round(quantile_cont(ret, 0.01), 6) AS q01, round(quantile_cont(ret, 0.99), 6) AS q99 FROM m GROUP BY 1""")
def agg05_moments(spark, sf):
    q = F.percentile("ret", F.array(F.lit(0.01), F.lit(0.99)))
    return daily(spark, sf).where("ret is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ret")).alias("mean"), r(F.stddev_samp("ret")).alias("std"), r(F.skewness("ret")).alias("skew"), r(F.kurtosis("ret")).alias("kurt"), r(F.get(q, 0)).alias("q01"), r(F.get(q, 1)).alias("q99"))


_PAIRS = [(a, b) for i, a in enumerate(("cs", "rv", "pk", "fg")) for b in ("cs", "rv", "pk", "fg")[i + 1 :]]


@query(f"{DAILY} SELECT symbol, " + ", ".join(f"round(corr({a}, {b}), 6) AS {a}_{b}" for a, b in _PAIRS) + " FROM daily GROUP BY 1")
def agg06_correlations(spark, sf):
    return daily(spark, sf).groupBy("symbol").agg(*[r(F.corr(a, b)).alias(f"{a}_{b}") for a, b in _PAIRS])


@query(f"""{DAILY}, x AS (SELECT symbol, round(cs, 4) AS cs, round(rv, 8) AS rv FROM daily WHERE cs IS NOT NULL AND rv IS NOT NULL), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY cs) + (count(*) OVER (PARTITION BY symbol, cs) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY rv) + (count(*) OVER (PARTITION BY symbol, rv) - 1) / 2.0 AS b FROM x)
 SELECT symbol, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY 1""")
def agg07_spearman(spark, sf):
    d = daily(spark, sf).where("cs is not null and rv is not null").withColumns({"cs": r("cs", 4), "rv": r("rv", 8)})
    d = d.select("symbol", stats.average_rank("cs", "symbol").alias("a"), stats.average_rank("rv", "symbol").alias("b"))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.corr("a", "b")).alias("rho"))


@query("""SELECT user_id AS symbol, epoch_us(date_trunc('hour', ts)) AS hour_us, round(min(value), 6) AS low, round(max(value), 6) AS high, round(arg_min(value, ts), 6) AS first, round(arg_max(value, ts), 6) AS last, count(*) AS n,
 round((max(value) - min(value)) / ((max(value) + min(value)) / 2) * 10000, 4) AS range_bps FROM events GROUP BY 1, 2""")
def agg13_hourly_bars(spark, sf):
    p = F.col("price")
    mid = (F.max(p) + F.min(p)) / 2
    return V.ticks(spark, sf).groupBy("symbol", F.unix_micros(F.date_trunc("hour", "ts")).alias("hour_us")).agg(r(F.min(p)).alias("low"), r(F.max(p)).alias("high"), r(F.min_by(p, "ts")).alias("first"), r(F.max_by(p, "ts")).alias("last"), F.count(F.lit(1)).alias("n"), r(F.try_divide(F.max(p) - F.min(p), mid) * 10_000, 4).alias("range_bps"))


@query(f"""SELECT l_suppkey % {V.SYMBOLS} AS symbol, CAST(l_shipdate AS DATE) AS day, count(*) AS n, round(sum(l_extendedprice) / sum(l_quantity), 9) AS vwap, round(avg(l_extendedprice / l_quantity), 9) AS mean_price, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END), 4) AS net
 FROM lineitem GROUP BY 1, 2""")
def agg12_trade_days(spark, sf):
    t = V.trades(spark, sf)
    return t.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("price") * F.col("size")) / F.sum("size"), 9).alias("vwap"), r(F.avg("price"), 9).alias("mean_price"), r(F.sum(F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))), 4).alias("net"))


@query(f"""{DAILY}, a AS (SELECT symbol, date, strength = 'extreme' AS x FROM daily), q AS (SELECT symbol, quantile_cont(rv, 0.8) AS cut FROM daily GROUP BY 1), b AS (SELECT symbol, date, rv > cut AS y FROM daily JOIN q USING (symbol) WHERE rv IS NOT NULL)
 SELECT symbol, sum((x AND y)::INT) AS both, sum((x AND NOT y)::INT) AS only_a, sum((y AND NOT x)::INT) AS only_b, sum((NOT x AND NOT y)::INT) AS neither FROM a JOIN b USING (symbol, date) GROUP BY 1""")
def agg19_concordance(spark, sf):
    d = daily(spark, sf).where("rv is not null")
    q = d.groupBy("symbol").agg(F.percentile("rv", F.lit(0.8)).alias("cut"))
    d = d.join(q, "symbol").select("symbol", (F.col("strength") == "extreme").alias("x"), (F.col("rv") > F.col("cut")).alias("y"))
    n = lambda c: F.sum(c.cast("int"))
    x, y = F.col("x"), F.col("y")
    return d.groupBy("symbol").agg(n(x & y).alias("both"), n(x & ~y).alias("only_a"), n(y & ~x).alias("only_b"), n(~x & ~y).alias("neither"))


# ---- windows


def _w(name: str, expr: str, build, digits: int = 6) -> None:
    def run(spark, sf):
        return build(daily(spark, sf)).select("symbol", "date", r("x", digits).alias("x"))

    run.__name__ = name
    query(f"{DAILY} {expr}")(run)


_w("win01_realised_volatility", f"SELECT symbol, date, round(CASE WHEN count(ret) {over(20)} = 20 THEN stddev_samp(ret) {over(20)} END * sqrt(365), 6) AS x FROM daily", lambda d: W.realised_volatility(d, 20, 365, "x"))
_w("win02_parkinson", f"SELECT symbol, date, round(sqrt(CASE WHEN count(*) {over(10)} = 10 THEN avg(pow(ln(high / low), 2)) {over(10)} END / (4 * ln(2)) * 365), 6) AS x FROM daily", lambda d: W.parkinson(d, 10, 365, "x"))
_w("win03_corwin_schultz", "SELECT symbol, date, round(cs, 4) AS x FROM daily", lambda d: d.withColumn("x", F.col("cs")), 4)
_w("win04_abdi_ranaldo", f", e AS (SELECT *, (ln(high) + ln(low)) / 2 AS eta FROM daily), f AS (SELECT *, (ln(lag(close) {S}) - lag(eta) {S}) * (ln(lag(close) {S}) - eta) AS v FROM e) SELECT symbol, date, round(CASE WHEN count(v) {over(20)} = 20 THEN 2 * sqrt(greatest(avg(v) {over(20)}, 0)) END, 6) AS x FROM f", lambda d: W.abdi_ranaldo(d, 20, "x"))
_w("win05_roll", f", e AS (SELECT *, lag(ret) {S} AS l FROM daily) SELECT symbol, date, round(2 * sqrt(greatest(-(CASE WHEN count(l) {over(20)} = 20 THEN covar_samp(ret, l) {over(20)} END), CASE WHEN count(l) {over(20)} = 20 THEN 0 END)), 6) AS x FROM e", lambda d: W.roll_measure(d, 20, "x").withColumn("x", F.when(F.count("ret").over(W.by_day()) >= 21, F.col("x"))))
_w("win06_amihud", f", e AS (SELECT *, abs(ret) / nullif(volume, 0) AS i FROM daily) SELECT symbol, date, round(CASE WHEN count(i) {over(20)} = 20 THEN avg(i) {over(20)} END * 1e6, 6) AS x FROM e", lambda d: W.amihud(d, 20, "x"))
_w("win09_rolling_correlation", f"SELECT symbol, date, round(CASE WHEN count(ret) {over(60)} = 60 THEN corr(ret, fg) {over(60)} END, 6) AS x FROM daily", lambda d: W.rolling_correlation(d, "ret", "fg", 60, "x"))
_w("win13_expanding_min_max", f", e AS (SELECT *, min(cs) OVER w AS lo, max(cs) OVER w AS hi, count(cs) OVER w AS n FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT symbol, date, round(CASE WHEN n >= 30 THEN CASE WHEN hi > lo THEN (cs - lo) / (hi - lo) ELSE 0.5 END END, 6) AS x FROM e", lambda d: W.expanding_min_max(d, "cs", 30, "x"))
_w("win14_rolling_min_max", f", e AS (SELECT *, min(cs) {over(252)} AS lo, max(cs) {over(252)} AS hi, count(cs) {over(252)} AS n FROM daily) SELECT symbol, date, round(CASE WHEN n >= 30 THEN CASE WHEN hi > lo THEN (cs - lo) / (hi - lo) ELSE 0.5 END END, 6) AS x FROM e", lambda d: W.rolling_min_max(d, "cs", 252, 30, "x"))
_w("exp06_forward_return", f"SELECT symbol, date, round(lead(close, 5) {S} / close - 1, 6) AS x FROM daily", lambda d: d.withColumn("x", F.lead("close", 5).over(W.by_day()) / F.col("close") - 1))


@query(f"""{DAILY}, c AS (SELECT *, CASE WHEN regime = lag(regime) {S} THEN 0 ELSE 1 END AS ch FROM daily), s AS (SELECT *, sum(ch) {S} AS spell FROM c), e AS (SELECT symbol, spell, regime, count(*) AS n FROM s GROUP BY 1, 2, 3)
 SELECT symbol, regime, count(*) AS spells, round(avg(n), 6) AS mean_days, max(n) AS longest, round(median(n), 6) AS median_days FROM e GROUP BY 1, 2""")
def win17_durations(spark, sf):
    e = W.spells(daily(spark, sf)).groupBy("symbol", "spell", "regime").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("spells"), r(F.avg("n")).alias("mean_days"), F.max("n").alias("longest"), r(F.percentile("n", F.lit(0.5))).alias("median_days"))


@query(f"""{DAILY}, t AS (SELECT symbol, regime AS a, lead(regime) {S} AS b FROM daily), g AS (SELECT symbol, a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2, 3) SELECT symbol, a AS from_regime, b AS to_regime, n, round(n / sum(n) OVER (PARTITION BY symbol, a), 6) AS p FROM g""")
def win18_transition_matrix(spark, sf):
    t = daily(spark, sf).select("symbol", F.col("regime").alias("from_regime"), F.lead("regime").over(W.by_day()).alias("to_regime")).where("to_regime is not null")
    g = t.groupBy("symbol", "from_regime", "to_regime").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("p", r(F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "from_regime"))))


@query(f"""{BARS.replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT symbol, date, fg, row_number() {S} AS n FROM bars JOIN idx USING (date)), e AS (SELECT symbol, date, n, fg AS x FROM s WHERE n = 1 UNION ALL SELECT s.symbol, s.date, s.n, 0.25 * s.fg + 0.75 * e.x FROM e JOIN s ON s.symbol = e.symbol AND s.n = e.n + 1)
 SELECT symbol, date, round(x, 6) AS x FROM e""")
def win19_ewma(spark, sf):
    d = V.bars(spark, sf).join(V.index_daily(spark, sf), "date").select("symbol", "date", "fg")
    return scans.ewma(d, "fg", 0.25).select("symbol", "date", r("ewma").alias("x"))


_RECURSIVE = DAILY.replace("WITH", "WITH RECURSIVE", 1)


@query(f"""{_RECURSIVE}, c AS (SELECT symbol, date, row_number() {S} AS n, CASE WHEN abs(coalesce(ret, 0)) > 1 THEN 'crisis' WHEN avg((fg - 50) / 50) {over(5)} > 0.25 THEN 'bullish' WHEN avg((fg - 50) / 50) {over(5)} < -0.25 THEN 'bearish' ELSE 'neutral' END AS candidate FROM daily),
 h AS (SELECT symbol, 0::BIGINT AS n, NULL::DATE AS date, 'neutral' AS state, 0 AS steps FROM (SELECT DISTINCT symbol FROM c) UNION ALL SELECT c.symbol, c.n, c.date, CASE WHEN c.candidate = 'crisis' OR h.steps >= 3 THEN c.candidate ELSE h.state END,
 CASE WHEN (CASE WHEN c.candidate = 'crisis' OR h.steps >= 3 THEN c.candidate ELSE h.state END) = h.state THEN h.steps + 1 ELSE 1 END FROM h JOIN c ON c.symbol = h.symbol AND c.n = h.n + 1) SELECT symbol, date, state FROM h WHERE n > 0""")
def win21_hysteresis(spark, sf):
    """A day that moves by over 100 % is a crisis, which is taken at once."""
    d = daily(spark, sf).withColumn("m", F.avg(E.sentiment_score(F.col("fg"))).over(W.frame(5)))
    candidate = F.when(F.abs(F.coalesce("ret", F.lit(0.0))) > 1, "crisis").when(F.col("m") > 0.25, "bullish").when(F.col("m") < -0.25, "bearish").otherwise("neutral")
    return scans.hysteresis(d.select("symbol", "date", candidate.alias("candidate")), "candidate").select("symbol", "date", "state")


@query(f"""{DAILY}, p AS (SELECT *, (fg - 50) / 50 AS v, row_number() {S} AS n, ln(close / lag(close) {S}) AS lr FROM daily), e AS (SELECT symbol, date, v, count(*) OVER w AS c, stddev_pop(lr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 FOLLOWING AND 24 FOLLOWING) AS fv, last_value(close) OVER w / close - 1 AS fc,
 min(CASE WHEN abs(v) < 0.8 THEN n END) OVER w - n AS st FROM p WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING))
 SELECT symbol, date, round(CASE WHEN c = 24 THEN fv END, 6) AS forward_vol, round(CASE WHEN c = 24 THEN fc END, 6) AS forward_change, CASE WHEN c = 24 THEN st END AS steps_to_converge FROM e WHERE abs(v) >= 0.8""")
def win22_divergence_log(spark, sf):
    d = daily(spark, sf).withColumn("v", E.sentiment_score(F.col("fg")))
    return W.divergence_log(d, "v", "close", 0.8).select("symbol", "date", r("forward_vol").alias("forward_vol"), r("forward_change").alias("forward_change"), "steps_to_converge")


@query(f"""{_RECURSIVE}, n AS (SELECT symbol, date, fg, row_number() {S} AS n FROM daily), e AS (SELECT * FROM n WHERE abs(fg - 50) / 50 >= 0.8), k AS (SELECT symbol, min(n) AS n FROM e GROUP BY 1 UNION ALL SELECT k.symbol, (SELECT min(e.n) FROM e WHERE e.symbol = k.symbol AND e.n >= k.n + 5) FROM k WHERE k.n IS NOT NULL)
 SELECT e.symbol, e.date, e.n, round(e.fg, 6) AS fg FROM e JOIN k ON e.symbol = k.symbol AND e.n = k.n""")
def win23_spaced_events(spark, sf):
    d = daily(spark, sf).withColumn("n", F.row_number().over(W.by_day())).where("abs(fg - 50) / 50 >= 0.8").select("symbol", "date", "n", "fg")
    return scans.spaced_events(d, 5).select("symbol", "date", "n", r("fg").alias("fg"))


@query(f"""{DAILY}, q AS (SELECT symbol, quantile_cont(rv, [0.2, 0.4, 0.6, 0.8]) AS e FROM daily GROUP BY 1), b AS (SELECT d.symbol, CASE WHEN rv <= e[1] THEN 1 WHEN rv <= e[2] THEN 2 WHEN rv <= e[3] THEN 3 WHEN rv <= e[4] THEN 4 ELSE 5 END AS bin, cs, strength FROM daily d JOIN q ON d.symbol = q.symbol WHERE rv IS NOT NULL)
 SELECT symbol, bin, strength, count(*) AS n, round(avg(cs), 4) AS mean_cs FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def win29_volatility_quintiles(spark, sf):
    d = W.quantile_bins(daily(spark, sf).where("rv is not null"), "rv", 5)
    return d.groupBy("symbol", "bin", "strength").agg(F.count(F.lit(1)).alias("n"), r(F.avg("cs"), 4).alias("mean_cs")).where("n >= 3")


@query(f"""SELECT agent, day, round(sum(sum(cash)) OVER (PARTITION BY agent ORDER BY day), 2) AS cash, round(sum(sum(pos)) OVER (PARTITION BY agent ORDER BY day), 4) AS position FROM (
 SELECT 'b' || (l_partkey % 20) AS agent, CAST(l_shipdate AS DATE) AS day, -l_extendedprice AS cash, l_quantity AS pos FROM lineitem UNION ALL SELECT 's' || (l_suppkey % 20), CAST(l_shipdate AS DATE), l_extendedprice, -l_quantity FROM lineitem) GROUP BY 1, 2""")
def win27_ledger(spark, sf):
    """Each fill as a buyer's and a seller's leg, cumulated by agent and day."""
    li = V.table(spark, sf, "lineitem")
    leg = lambda side, key, sign: F.struct(F.concat(F.lit(side), (F.col(key) % 20).cast("string")).alias("agent"), (-sign * F.col("l_extendedprice")).alias("cash"), (sign * F.col("l_quantity")).cast("double").alias("pos"))
    legs = li.select(F.col("l_shipdate").cast("date").alias("day"), F.explode(F.array(leg("b", "l_partkey", 1), leg("s", "l_suppkey", -1))).alias("x"))
    g = legs.groupBy("x.agent", "day").agg(F.sum("x.cash").alias("cash"), F.sum("x.pos").alias("pos"))
    w = Window.partitionBy("agent").orderBy("day")
    return g.select("agent", "day", r(F.sum("cash").over(w), 2).alias("cash"), r(F.sum("pos").over(w), 4).alias("position"))


# ---- top-k and sets


@query(f"{DAILY}, g AS (SELECT symbol, regime, avg(cs) AS m FROM daily GROUP BY 1, 2) SELECT symbol, regime, rank() OVER (PARTITION BY symbol ORDER BY m DESC) AS rank, round(m - max(CASE WHEN regime = 'neutral' THEN m END) OVER (PARTITION BY symbol), 4) AS gap FROM g")
def top01_regime_ranking(spark, sf):
    g = daily(spark, sf).groupBy("symbol", "regime").agg(F.avg("cs").alias("m"))
    w = Window.partitionBy("symbol")
    return g.select("symbol", "regime", F.rank().over(w.orderBy(F.col("m").desc())).alias("rank"), r(F.col("m") - F.max(F.when(F.col("regime") == "neutral", F.col("m"))).over(w), 4).alias("gap"))


@query(f"SELECT symbol, side, price, size FROM (SELECT l_suppkey % {V.SYMBOLS} AS symbol, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, round(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS size, row_number() OVER (PARTITION BY l_suppkey % {V.SYMBOLS}, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END ORDER BY CASE WHEN l_linestatus = 'O' THEN -round(l_extendedprice / l_quantity) ELSE round(l_extendedprice / l_quantity) END) AS n FROM lineitem GROUP BY l_suppkey % {V.SYMBOLS}, l_linestatus, round(l_extendedprice / l_quantity)) WHERE n <= 10")
def top03_depth(spark, sf):
    """Resting size per price level, the ten best a side."""
    g = V.trades(spark, sf).groupBy("symbol", "side", F.round("price").alias("price")).agg(F.sum("size").alias("size"))
    best = F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price"))
    return g.withColumn("n", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(best))).where("n <= 10").drop("n")


@query(f"{BARS} SELECT date, sum(a) AS in_a, sum(b) AS in_b FROM (SELECT DISTINCT date, 1 AS a, 0 AS b FROM bars WHERE symbol = 0 UNION ALL SELECT DISTINCT date, 0, 1 FROM bars WHERE symbol = 1) GROUP BY 1 HAVING sum(a) + sum(b) = 1")
def set02_unmatched_days(spark, sf):
    b = V.bars(spark, sf)
    days = lambda s: b.where(F.col("symbol") == s).select("date")
    a_only, b_only = days(0).exceptAll(days(1)), days(1).exceptAll(days(0))
    return a_only.select("date", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b_only.select("date", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))


# ---- tests, regression, resampling, events

_PREMIUM = """ g AS (SELECT {0}, count(CASE WHEN strength = 'extreme' THEN cs END) AS n_e, count(CASE WHEN strength = 'neutral' THEN cs END) AS n_n, avg(CASE WHEN strength = 'extreme' THEN cs END) AS mean_e, avg(CASE WHEN strength = 'neutral' THEN cs END) AS mean_n,
 var_samp(CASE WHEN strength = 'extreme' THEN cs END) AS ve, var_samp(CASE WHEN strength = 'neutral' THEN cs END) AS vn FROM {1} GROUP BY ALL)
 SELECT {0}, n_e, n_n, round(mean_e, 4) AS mean_e, round(mean_n, 4) AS mean_n, round(mean_e - mean_n, 4) AS gap, round((mean_e - mean_n) / nullif(sqrt(ve / n_e + vn / n_n), 0), 4) AS t,
 round(pow(ve / n_e + vn / n_n, 2) / nullif(pow(ve / n_e, 2) / (n_e - 1) + pow(vn / n_n, 2) / (n_n - 1), 0), 3) AS dof, round((mean_e - mean_n) / nullif(sqrt((ve + vn) / 2), 0), 6) AS d, round(mean_e - mean_n - 1.96 * sqrt(ve / n_e + vn / n_n), 4) AS low, round(mean_e - mean_n + 1.96 * sqrt(ve / n_e + vn / n_n), 4) AS high FROM g WHERE n_e >= 3 AND n_n >= 3"""


def _premium(df: DataFrame, strata: list[str]) -> DataFrame:
    digits = {"d": 6, "dof": 3}
    out = stats.premium(df, strata, "cs")
    return out.select(*strata, "n_e", "n_n", *[r(c, digits.get(c, 4)).alias(c) for c in ("mean_e", "mean_n", "gap", "t", "dof", "d", "low", "high")])


@query(f"{DAILY}, {_PREMIUM.format('symbol', 'daily')}")
def tst15_premium(spark, sf):
    return _premium(daily(spark, sf), ["symbol"])


@query(f"{DAILY}, y AS (SELECT *, year(date) AS year FROM daily), {_PREMIUM.format('symbol, year', 'y')}")
def tst15_premium_by_year(spark, sf):
    return _premium(daily(spark, sf).withColumn("year", F.year("date")), ["symbol", "year"])


@query(f"""{DAILY}, q AS (SELECT symbol, quantile_cont(rv, [0.2, 0.4, 0.6, 0.8]) AS e FROM daily GROUP BY 1), b AS (SELECT d.*, CASE WHEN rv <= e[1] THEN 1 WHEN rv <= e[2] THEN 2 WHEN rv <= e[3] THEN 3 WHEN rv <= e[4] THEN 4 ELSE 5 END AS bin FROM daily d JOIN q ON d.symbol = q.symbol WHERE rv IS NOT NULL), {_PREMIUM.format('symbol, bin', 'b')}""")
def tst15_premium_within_quintile(spark, sf):
    return _premium(W.quantile_bins(daily(spark, sf).where("rv is not null"), "rv", 5), ["symbol", "bin"])


@query(f"""{DAILY}, y AS (SELECT symbol, strength, round(cs, 4) AS cs FROM daily WHERE cs IS NOT NULL AND strength <> 'moderate'), x AS (SELECT symbol, strength, rank() OVER (PARTITION BY symbol ORDER BY cs) + (count(*) OVER (PARTITION BY symbol, cs) - 1) / 2.0 AS k FROM y)
 SELECT symbol, sum(CASE WHEN strength = 'extreme' THEN k END) - count(CASE WHEN strength = 'extreme' THEN 1 END) * (count(CASE WHEN strength = 'extreme' THEN 1 END) + 1) / 2.0 AS u FROM x GROUP BY 1""")
def tst04_mann_whitney(spark, sf):
    x = daily(spark, sf).where("cs is not null and strength <> 'moderate'")
    x = x.withColumn("cs", r("cs", 4)).withColumn("k", stats.average_rank("cs", "symbol"))
    e = F.col("strength") == "extreme"
    n = F.count(F.when(e, 1))
    return x.groupBy("symbol").agg((F.sum(F.when(e, F.col("k"))) - n * (n + 1) / 2).alias("u"))


@query("""WITH t AS (SELECT user_id % 10 AS family, event_id AS test, (event_id * 7919 % 100000) / 100000.0 AS p FROM events), i AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i FROM t)
 SELECT family, test, round(p::DOUBLE, 6) AS p, round(least(p * m, 1)::DOUBLE, 6) AS bonferroni, round(least(max(p * (m - i + 1)) OVER (PARTITION BY family ORDER BY p, test ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)::DOUBLE, 6) AS holm,
 round(least(min(p::DOUBLE * m / i) OVER (PARTITION BY family ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)::DOUBLE, 6) AS bh FROM i""")
def tst05_corrections(spark, sf):
    t = V.table(spark, sf, "events").select((F.col("user_id") % 10).alias("family"), F.col("event_id").alias("test"), (F.col("event_id") * 7919 % 100_000 / 100_000).alias("p"))
    return stats.adjusted_p(t, "family").select("family", "test", *[r(c).alias(c) for c in ("p", "bonferroni", "holm", "bh")])


@query(f"""{DAILY}, m AS (SELECT symbol, ret - avg(ret) OVER (PARTITION BY symbol) AS u FROM daily WHERE ret IS NOT NULL), g AS (SELECT symbol, count(*) AS n, avg(u*u*u) / pow(avg(u*u), 1.5) AS s, avg(u*u*u*u) / pow(avg(u*u), 2) - 3 AS k FROM m GROUP BY 1)
 SELECT symbol, n, round(n / 6.0 * (s * s + k * k / 4), 4) AS jb, round(exp(-(n / 6.0 * (s * s + k * k / 4)) / 2), 6) AS p FROM g""")
def tst06_jarque_bera(spark, sf):
    g = daily(spark, sf).where("ret is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.skewness("ret").alias("s"), F.kurtosis("ret").alias("k"))
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    return g.select("symbol", "n", r(jb, 4).alias("jb"), r(F.exp(-jb / 2)).alias("p"))


@query(f"""{DAILY}, m AS (SELECT symbol, date, abs(ret) - avg(abs(ret)) OVER (PARTITION BY symbol) AS u FROM daily WHERE ret IS NOT NULL), k AS (SELECT symbol, date, u, unnest([1, 2, 5, 10]) AS lag FROM m), l AS (SELECT symbol, lag, u, CASE lag WHEN 1 THEN lag(u, 1) OVER w WHEN 2 THEN lag(u, 2) OVER w WHEN 5 THEN lag(u, 5) OVER w ELSE lag(u, 10) OVER w END AS v FROM k WINDOW w AS (PARTITION BY symbol, lag ORDER BY date))
 SELECT symbol, count(*) AS n, lag, round(sum(u * v) / sum(u * u), 6) AS acf FROM l GROUP BY symbol, lag""")
def tst07_autocorrelation(spark, sf):
    d = daily(spark, sf).withColumn("a", F.abs("ret"))
    return stats.autocorrelation(d, "a", [1, 2, 5, 10]).withColumn("acf", r("acf"))


@query(f"{DAILY}, g AS (SELECT symbol, count(*) AS n, avg((ret > 0)::INT) AS p FROM daily WHERE ret IS NOT NULL GROUP BY 1) SELECT symbol, n, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high FROM g")
def tst13_wilson(spark, sf):
    g = daily(spark, sf).where("ret is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ret") > 0).cast("int")).alias("p"))
    p, n, z = F.col("p"), F.col("n"), 1.96
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    at = lambda s: r((p + z * z / (2 * n) + s * half) / (1 + z * z / n))
    return g.select("symbol", "n", at(-1).alias("low"), at(1).alias("high"))


@query(f"""{DAILY}, m AS (SELECT symbol, date, ret, ret - avg(ret) OVER (PARTITION BY symbol) AS u FROM daily WHERE ret IS NOT NULL), l AS (SELECT *, lag(u, 1) {S} AS a, lag(u, 2) {S} AS b, lag(u, 3) {S} AS c FROM m)
 SELECT symbol, count(*) AS n, round(avg(ret), 6) AS mean, round(sqrt(greatest(sum(u*u) + 2 * 0.75 * sum(u*a) + 2 * 0.5 * sum(u*b) + 2 * 0.25 * sum(u*c), 0)) / count(*), 6) AS se FROM l GROUP BY 1""")
def tst14_newey_west(spark, sf):
    return stats.newey_west_mean(daily(spark, sf), "ret", 3).select("symbol", "n", r("mean").alias("mean"), r("se").alias("se"))


@query(f"{DAILY} SELECT symbol, count(*) AS n, round(regr_slope(cs, rv), 3) AS slope, round(regr_intercept(cs, rv), 3) AS intercept, round(regr_r2(cs, rv), 6) AS r2 FROM daily WHERE cs IS NOT NULL AND rv IS NOT NULL GROUP BY 1")
def reg01_single(spark, sf):
    ls = stats.least_squares(daily(spark, sf), "cs", ["rv"], ["symbol"])
    return ls.groupBy("symbol").agg(F.max("n").alias("n"), r(F.max(F.when(F.col("term") == "rv", F.col("coef"))), 3).alias("slope"), r(F.max(F.when(F.col("term") == "const", F.col("coef"))), 3).alias("intercept"), r(F.max("r2")).alias("r2"))


@query()
def reg04_regime_dummies(spark, sf):
    d = daily(spark, sf)
    d = d.withColumns({f"is_{n}": (F.col("regime") == n).cast("double") for n in E.REGIMES if n != "neutral"})
    return stats.least_squares(d, "cs", ["rv", *[f"is_{n}" for n in E.REGIMES if n != "neutral"]], ["symbol"])


@query(f"""{DAILY}, l AS (SELECT symbol, regr_slope(cs, rv) AS s, regr_intercept(cs, rv) AS i FROM daily WHERE cs IS NOT NULL AND rv IS NOT NULL GROUP BY 1) SELECT d.symbol, strength, round(avg(cs - i - s * rv), 4) AS resid FROM daily d JOIN l ON d.symbol = l.symbol GROUP BY 1, 2""")
def reg08_residual_gaps(spark, sf):
    return stats.residuals(daily(spark, sf), "cs", "rv").groupBy("symbol", "strength").agg(r(F.avg("resid"), 4).alias("resid"))


@query(f"{DAILY}, l AS (SELECT symbol, fg, lag(fg) {S} AS b FROM daily) SELECT symbol, round(regr_slope(fg, b), 6) AS phi, round(regr_intercept(fg, b), 6) AS c FROM l GROUP BY 1")
def reg13_ar1(spark, sf):
    d = daily(spark, sf).withColumn("b", F.lag("fg").over(W.by_day()))
    return d.groupBy("symbol").agg(r(F.regr_slope("fg", "b")).alias("phi"), r(F.regr_intercept("fg", "b")).alias("c"))


_HASH = "(((((n * 7919 + rep * 104729 + 12345) % 2147483647) * 48271) % 2147483647) * 48271) % 2147483647 % 10000"
_ROWS = f"{DAILY}, n AS (SELECT *, row_number() {S} AS n FROM daily WHERE cs IS NOT NULL)"


def _numbered(spark, sf):
    return daily(spark, sf).where("cs is not null").withColumn("n", F.row_number().over(W.by_day()).cast("long"))


@query(f"""{_ROWS}, x AS (SELECT symbol, rep, cs, strength, {_HASH} AS h FROM n, range(200) t(rep) WHERE strength IN ('extreme', 'neutral')), w AS (SELECT *, CASE WHEN h < 3679 THEN 0 WHEN h < 7358 THEN 1 WHEN h < 9197 THEN 2 WHEN h < 9810 THEN 3 WHEN h < 9963 THEN 4 WHEN h < 9994 THEN 5 ELSE 6 END AS w FROM x),
 g AS (SELECT symbol, rep, sum(CASE WHEN strength = 'extreme' THEN w * cs END) / nullif(sum(CASE WHEN strength = 'extreme' THEN w END), 0) - sum(CASE WHEN strength = 'neutral' THEN w * cs END) / nullif(sum(CASE WHEN strength = 'neutral' THEN w END), 0) AS gap FROM w GROUP BY 1, 2)
 SELECT symbol, round(quantile_cont(gap, 0.025), 4) AS low, round(avg(gap), 4) AS mean, round(quantile_cont(gap, 0.975), 4) AS high FROM g GROUP BY 1""")
def rsp01_bootstrap(spark, sf):
    g = R.bootstrap_gap(_numbered(spark, sf), "n", "cs", 200)
    q = F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975)))
    return g.groupBy("symbol").agg(r(F.get(q, 0), 4).alias("low"), r(F.avg("gap"), 4).alias("mean"), r(F.get(q, 1), 4).alias("high"))


@query(f"""{_ROWS}, x AS (SELECT symbol, rep, n, cs, (strength = 'extreme')::INT AS e, {_HASH} AS h FROM n, range(100) t(rep)), k AS (SELECT symbol, rep, cs, row_number() OVER (PARTITION BY symbol, rep ORDER BY h, n) <= sum(e) OVER (PARTITION BY symbol, rep) AS pick FROM x)
 SELECT symbol, rep, round(avg(CASE WHEN pick THEN cs END) - avg(CASE WHEN NOT pick THEN cs END), 4) AS gap FROM k GROUP BY 1, 2""")
def rsp02_permutation(spark, sf):
    return R.permuted_gap(_numbered(spark, sf), "n", "cs", 100).withColumn("gap", r("gap", 4))


_SWEEP = [(15, 85), (20, 80), (25, 75), (30, 70)]


@query(f"""{DAILY}, s AS (SELECT * FROM (VALUES {", ".join(map(str, _SWEEP))}) t(lo, hi)) SELECT symbol, lo, hi, count(CASE WHEN fg <= lo OR fg >= hi THEN cs END) AS n_extreme, round(avg(CASE WHEN fg <= lo OR fg >= hi THEN cs END) - avg(CASE WHEN fg > 45 AND fg <= 55 THEN cs END), 4) AS gap FROM daily, s GROUP BY 1, 2, 3""")
def rsp07_threshold_sweep(spark, sf):
    d = R.sweep(daily(spark, sf), _SWEEP, ["lo", "hi"])
    x = (F.col("fg") <= F.col("lo")) | (F.col("fg") >= F.col("hi"))
    mid = (F.col("fg") > 45) & (F.col("fg") <= 55)
    return d.groupBy("symbol", "lo", "hi").agg(F.count(F.when(x, F.col("cs"))).alias("n_extreme"), r(F.avg(F.when(x, F.col("cs"))) - F.avg(F.when(mid, F.col("cs"))), 4).alias("gap"))


_GRID = [(round(0.1 * i, 1), round(1 - 0.1 * i, 1)) for i in range(1, 10)]


@query(f"""{DAILY}, b AS (SELECT *, min(cs) OVER p AS lo, max(cs) OVER p AS hi, min(rv) OVER p AS l2, max(rv) OVER p AS h2 FROM daily WHERE cs IS NOT NULL AND rv IS NOT NULL WINDOW p AS (PARTITION BY symbol)), s AS (SELECT * FROM (VALUES {", ".join(map(str, _GRID))}) t(a, b))
 SELECT symbol, s.a::DOUBLE AS a, s.b::DOUBLE AS b, round(avg(CASE WHEN strength = 'extreme' THEN s.a * (cs - lo) / (hi - lo) + s.b * (rv - l2) / (h2 - l2) END) - avg(CASE WHEN strength = 'neutral' THEN s.a * (cs - lo) / (hi - lo) + s.b * (rv - l2) / (h2 - l2) END), 6) AS gap FROM b, s GROUP BY ALL""")
def rsp05_weight_grid(spark, sf):
    d = daily(spark, sf).where("cs is not null and rv is not null")
    p = Window.partitionBy("symbol")
    scaled = lambda c: F.try_divide(F.col(c) - F.min(c).over(p), F.max(c).over(p) - F.min(c).over(p))
    d = R.sweep(d.select("symbol", "strength", scaled("cs").alias("x"), scaled("rv").alias("y")), _GRID, ["a", "b"])
    u = F.col("a") * F.col("x") + F.col("b") * F.col("y")
    return d.groupBy("symbol", "a", "b").agg(r(F.avg(F.when(F.col("strength") == "extreme", u)) - F.avg(F.when(F.col("strength") == "neutral", u))).alias("gap"))


@query(f"""{DAILY}, f AS (SELECT symbol, fg, close, lead(close, 1) {S} / close - 1 AS r1, lead(close, 3) {S} / close - 1 AS r3, lead(close, 5) {S} / close - 1 AS r5, lead(close, 7) {S} / close - 1 AS r7 FROM daily),
 l AS (SELECT symbol, h, CASE h WHEN 1 THEN r1 WHEN 3 THEN r3 WHEN 5 THEN r5 ELSE r7 END AS x FROM f, (VALUES (1), (3), (5), (7)) t(h) WHERE abs(fg - 50) / 50 >= 0.8) SELECT symbol, h, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(avg((x > 0)::INT), 6) AS hit FROM l GROUP BY 1, 2""")
def evt01_event_study(spark, sf):
    ahead = {h: F.lead("close", h).over(W.by_day()) / F.col("close") - 1 for h in (1, 3, 5, 7)}
    d = daily(spark, sf).select("symbol", "fg", F.array(*[F.struct(F.lit(h).alias("h"), x.alias("x")) for h, x in ahead.items()]).alias("e"))
    e = d.where("abs(fg - 50) / 50 >= 0.8").select("symbol", F.explode("e").alias("e")).select("symbol", "e.*")
    return e.groupBy("symbol", "h").agg(F.count("x").alias("n"), r(F.avg("x")).alias("mean"), r(F.stddev_samp("x")).alias("std"), r(F.avg((F.col("x") > 0).cast("int"))).alias("hit"))


@query(f"""{_RECURSIVE}, c AS (SELECT symbol, date, close, regime, row_number() {S} AS n, count(*) OVER (PARTITION BY symbol) AS last FROM daily), t AS (SELECT symbol, 0::BIGINT AS n, NULL::BIGINT AS at, NULL::DOUBLE AS paid, NULL::DATE AS entered, NULL::DATE AS closed, NULL::BIGINT AS held, NULL::DOUBLE AS net FROM (SELECT DISTINCT symbol FROM c)
 UNION ALL SELECT c.symbol, c.n, CASE WHEN t.at IS NULL AND c.regime = 'extreme_fear' THEN c.n WHEN t.at IS NOT NULL AND (c.regime NOT IN ('extreme_fear', 'fear') OR c.n - t.at >= 10 OR c.n = c.last) THEN NULL ELSE t.at END,
 CASE WHEN t.at IS NULL AND c.regime = 'extreme_fear' THEN c.close ELSE t.paid END, CASE WHEN t.at IS NULL AND c.regime = 'extreme_fear' THEN c.date ELSE t.entered END, c.date,
 CASE WHEN t.at IS NOT NULL AND (c.regime NOT IN ('extreme_fear', 'fear') OR c.n - t.at >= 10 OR c.n = c.last) THEN c.n - t.at END, CASE WHEN t.at IS NOT NULL AND (c.regime NOT IN ('extreme_fear', 'fear') OR c.n - t.at >= 10 OR c.n = c.last) THEN c.close / t.paid - 1 - 0.002 END FROM t JOIN c ON c.symbol = t.symbol AND c.n = t.n + 1)
 SELECT symbol, strftime(entered, '%Y-%m-%d') AS entered, strftime(closed, '%Y-%m-%d') AS exited, held, round(net, 6) AS net FROM t WHERE held IS NOT NULL""")
def bt01_contrarian(spark, sf):
    return scans.contrarian_trades(daily(spark, sf)).withColumn("net", r("net"))


@query("SELECT user_id AS symbol, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS start_us, round(avg(value), 6) AS avg_price, count(*) AS n FROM events GROUP BY 1, 2")
def str01_minute_rollup(spark, sf):
    from marketlens.streaming.streams import minute_rollup

    return minute_rollup(V.ticks(spark, sf)).select("symbol", F.unix_micros("start").alias("start_us"), r("avg_price").alias("avg_price"), "n")
