"""Registered time-series models and placebos; SQL stands beside those it can express, the others are tested against NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import expressions as E
from marketlens.operators import resample as R
from marketlens.operators import scans, stats
from marketlens.operators import series as TS
from marketlens.operators import windows as W
from marketlens.plans.queries import BARS, DAILY, S, daily, over, query, r
from marketlens.plans.studies import _MACRO, _macro
from marketlens.sources import views as V

# ---- unit roots, causality, vector autoregressions


@query(f"""{DAILY}, e AS (SELECT symbol, date, cs - avg(cs) OVER (PARTITION BY symbol) AS e FROM daily WHERE cs IS NOT NULL), l AS (SELECT symbol, e, sum(e) {S} AS s, {", ".join(f"lag(e, {k}) {S} AS e{k}" for k in range(1, 9))} FROM e)
 SELECT symbol, count(*) AS n, round(sum(s * s) / count(*) / (sum(e * e) + {" + ".join(f"2 * {1 - k / 9} * sum(e * e{k})" for k in range(1, 9))}), 5) AS eta FROM l GROUP BY 1""")
def tst09_kpss(spark, sf):
    return TS.kpss(daily(spark, sf), "cs", 8).select("symbol", "n", r("eta", 5).alias("eta"))


@query()
def tst09_unit_roots(spark, sf):
    """Dickey-Fuller with the number of lags by AIC beside KPSS with Hobijn's lags."""
    d = daily(spark, sf).select("symbol", "date", "cs")
    adf = TS.dickey_fuller(d, "cs").withColumnRenamed("n", "adf_n").withColumnRenamed("lags", "adf_lags").withColumnRenamed("p", "adf_p")
    return adf.join(TS.kpss(d, "cs").select("symbol", F.col("lags").alias("kpss_lags"), "eta", F.col("p").alias("kpss_p")), "symbol")


def _both_ways(spark, sf, lags: list[int]):
    d = daily(spark, sf)
    out = [TS.granger(d, y, x, lags).withColumn("cause", F.lit(x)) for y, x in (("cs", "pk"), ("pk", "cs"))]
    return out[0].unionByName(out[1])


_ONE_WAY = """SELECT symbol, '{x}' AS cause, syy - sya * sya / saa AS small, syy - (sya * sya * sbb + syb * syb * saa - 2 * sya * syb * sab) / (saa * sbb - sab * sab) AS big, n FROM (SELECT symbol, count(*) AS n, count(*) * var_pop(y) AS syy, count(*) * var_pop(a) AS saa, count(*) * var_pop(b) AS sbb,
 count(*) * covar_pop(y, a) AS sya, count(*) * covar_pop(y, b) AS syb, count(*) * covar_pop(a, b) AS sab FROM (SELECT symbol, {y} AS y, lag({y}) OVER (PARTITION BY symbol ORDER BY date) AS a, lag({x}) OVER (PARTITION BY symbol ORDER BY date) AS b FROM daily WHERE cs IS NOT NULL AND pk IS NOT NULL) WHERE a IS NOT NULL GROUP BY 1)"""


@query(f"{DAILY}, g AS ({_ONE_WAY.format(y='cs', x='pk')} UNION ALL {_ONE_WAY.format(y='pk', x='cs')}) SELECT symbol, cause, n, round((small - big) / (big / (n - 3)), 3) AS f FROM g")
def tst10_granger_first(spark, sf):
    return _both_ways(spark, sf, [1]).select("symbol", "cause", "n", r("f", 3).alias("f"))


@query()
def tst10_granger(spark, sf):
    """One to five lags, both directions, with p."""
    return _both_ways(spark, sf, [1, 2, 3, 4, 5])


@query()
def tst11_var_orders(spark, sf):
    return TS.var_orders(daily(spark, sf), "cs", "rv")


@query()
def tst11_var_stability(spark, sf):
    return TS.var_stability(daily(spark, sf), "cs", "rv")


@query()
def tst11_johansen(spark, sf):
    return TS.johansen(daily(spark, sf), "cs", "rv")


# ---- instruments and splines


def _instruments(spark, sf):
    s = W.by_day()
    d = daily(spark, sf).withColumns({"before": F.lag("rv").over(s), "monday": (F.weekday("date") == 0).cast("int")})
    return d.withColumn("extreme", (F.col("strength") == "extreme").cast("int"))


@query(f"""{DAILY}, z AS (SELECT * FROM (SELECT symbol, cs AS y, rv AS x, lag(rv) {S} AS z FROM daily) WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL),
 m AS (SELECT symbol, count(*) AS n, pow(corr(x, z), 2) AS r2, covar_pop(y, z) / covar_pop(x, z) AS b, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, covar_pop(x, z) AS sxz, regr_slope(y, x) AS ols FROM z GROUP BY 1)
 SELECT symbol, max(n) AS n, round(max(r2 * (n - 2) / (1 - r2)), 3) AS f, round(max(b), 3) AS coef, round(sqrt(sum(pow((z - mz) * (y - my - b * (x - mx)), 2))) / abs(max(n) * max(sxz)), 3) AS se, round(max(ols), 3) AS coef_ols FROM z JOIN m USING (symbol) GROUP BY 1""")
def reg11_one_instrument(spark, sf):
    return TS.two_stage(_instruments(spark, sf), "cs", "rv", ["before"]).select("symbol", "n", *[r(c, 3).alias(c) for c in ("f", "coef", "se", "coef_ols")])


@query()
def reg11_two_stage(spark, sf):
    """Three instruments (a jump of volatility, Mondays, the day before) and a control."""
    d = _instruments(spark, sf)
    change = F.col("rv") - F.col("before")
    jump = (change > 1.5 * W.full(F.stddev_samp("change").over(W.frame(60)), F.col("change"), 60)).cast("int")
    return TS.two_stage(d.withColumn("change", change).withColumn("jump", jump), "cs", "rv", ["jump", "monday", "before"], ["extreme"])


@query()
def reg10_spline(spark, sf):
    """Extreme days' coefficient under natural splines of volatility of 3 to 7 degrees, HAC errors."""
    d = _instruments(spark, sf).where("cs is not null and rv is not null").withColumn("size_of_move", F.abs("ret"))
    parts = []
    for size in (3, 5, 7):
        basis, names = TS.natural_spline(d, "rv", size)
        fit = stats.robust(basis, "cs", ["extreme", *names, "size_of_move"], "symbol", "HAC", lags=10).where("term = 'extreme'")
        parts.append(fit.withColumn("size", F.lit(size)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- placebos that keep the order of days

_HASH_BLOCK = "(((((block * 7919 + rep * 104729 + 12345) % 2147483647) * 48271) % 2147483647) * 48271) % 2147483647 % 10000"
_SPELLS = f"""c AS (SELECT symbol, date, cs, regime, row_number() {S} AS pos, CASE WHEN regime = lag(regime) {S} THEN 0 ELSE 1 END AS ch FROM daily), s AS (SELECT *, sum(ch) {S} AS block FROM c),
 b AS (SELECT symbol, block, count(*) AS len, min(regime) AS label, sum(cs) AS s, count(cs) AS c FROM s GROUP BY 1, 2), m AS (SELECT *, {_HASH_BLOCK} AS h FROM b, range(50) t(rep))"""
_GAP = "round(sum(s) FILTER (given LIKE 'extreme%') / nullif(sum(c) FILTER (given LIKE 'extreme%'), 0) - sum(s) FILTER (given = 'neutral') / nullif(sum(c) FILTER (given = 'neutral'), 0), 3) AS gap"


@query(f"{DAILY}, {_SPELLS}, d AS (SELECT symbol, rep, row_number() OVER (PARTITION BY symbol, rep ORDER BY h, block) AS block, label AS given FROM m), p AS (SELECT m.symbol, m.rep, d.given, s, c FROM m JOIN d ON m.symbol = d.symbol AND m.rep = d.rep AND m.block = d.block) SELECT symbol, rep, {_GAP} FROM p GROUP BY 1, 2")
def rsp03_blocks_in_place(spark, sf):
    return TS.block_shuffled_gap(daily(spark, sf), "cs", 50, True, R.hashed).withColumn("gap", r("gap", 3))


@query(f"""{DAILY}, {_SPELLS}, d AS (SELECT symbol, rep, label AS given, len, sum(len) OVER (PARTITION BY symbol, rep ORDER BY h, block) AS e FROM m), p AS (SELECT s.symbol, d.rep, d.given, cs AS s, (cs IS NOT NULL)::INT AS c FROM s JOIN d ON s.symbol = d.symbol AND s.pos > d.e - d.len AND s.pos <= d.e)
 SELECT symbol, rep, {_GAP} FROM p GROUP BY 1, 2""")
def rsp03_blocks_end_to_end(spark, sf):
    return TS.block_shuffled_gap(daily(spark, sf), "cs", 50, False, R.hashed).withColumn("gap", r("gap", 3))


def _extreme_or_neutral(v: np.ndarray) -> np.ndarray:
    a, b, c, d = E.CUTS
    return np.where((v <= a) | (v > d), 1, np.where((v > b) & (v <= c), 0, -1))


@query()
def rsp04_autoregressive(spark, sf):
    """Null mean, spread and p of made-up index series against the gap that was found."""
    d = daily(spark, sf)
    gaps = TS.autoregressive_gap(d, "fg", "cs", 200, _extreme_or_neutral).where("gap is not null")
    mean = lambda s: F.avg(F.when(F.col("strength") == s, F.col("cs")))
    found = d.groupBy("symbol").agg((mean("extreme") - mean("neutral")).alias("found"))
    share = lambda test: F.avg(test.cast("int"))
    return gaps.join(found, "symbol").groupBy("symbol", "found").agg(
        F.count("gap").alias("n"), F.avg("gap").alias("null_mean"), F.stddev_pop("gap").alias("null_std"), share(F.col("gap") >= F.col("found")).alias("p_one"), share(F.abs("gap") >= F.abs("found")).alias("p_two"),
    )


# ---- institutional sentiment


@query(f"""{DAILY.replace("WITH", "WITH RECURSIVE", 1)}, k AS (SELECT symbol, date, (fg - 50) / 50 AS v, rv, CASE WHEN count(ret) {over(30)} = 30 THEN covar_pop(ret, CASE WHEN ret IS NOT NULL THEN (fg - 50) / 50 END) {over(30)} / nullif(stddev_pop(ret) {over(30)} * stddev_pop(CASE WHEN ret IS NOT NULL THEN (fg - 50) / 50 END) {over(30)}, 0) END AS c, row_number() {S} AS n FROM daily),
 e AS (SELECT symbol, n, v AS x FROM k WHERE n = 1 UNION ALL SELECT k.symbol, k.n, 0.25 * k.v + 0.75 * e.x FROM e JOIN k ON k.symbol = e.symbol AND k.n = e.n + 1),
 b AS (SELECT k.*, 0.5 * x + 0.5 * CASE WHEN rv IS NULL THEN 0 ELSE 1 - 2 * (greatest(0.005, least(0.065, rv)) - 0.005) / 0.06 END AS base FROM k JOIN e ON k.symbol = e.symbol AND k.n = e.n),
 i AS (SELECT symbol, date, v, greatest(-1, least(1, base + 0.3 * greatest(0, least(1, -coalesce(c, 0))) * (-v - base))) AS inst FROM b) SELECT symbol, date, round(inst, 5) AS institutional, round(v - inst, 5) AS divergence FROM i""")
def win24_institutional(spark, sf):
    """A slow, volatility-minded, contrarian counterpart of the index and the distance to it."""
    d = W.rolling_correlation(daily(spark, sf).withColumn("v", E.sentiment_score(F.col("fg"))), "ret", "v", 30, "c").select("symbol", "date", "v", "rv", "c")
    d = W.institutional(scans.ewma(d, "v", 0.25, out="slow"), "v", "slow", "rv", "c")
    return d.select("symbol", "date", r("institutional", 5).alias("institutional"), r(F.col("v") - F.col("institutional"), 5).alias("divergence"))


@query(f"""{DAILY}, {_MACRO}, p AS (SELECT symbol, date, CASE WHEN news IS NULL THEN 0 ELSE (news - 50) / 50 END AS r, CASE WHEN news IS NULL THEN 0.3 WHEN trades = 0 THEN 0.5 ELSE least(1, trades / 20.0) END AS rc,
 CASE WHEN peg IS NULL THEN 0 ELSE greatest(-1, least(1, 1 - least(peg * 100, 2))) END AS f, CASE WHEN peg IS NULL THEN 0.2 ELSE 0.9 END AS fc,
 CASE WHEN vix IS NULL AND dvol IS NULL THEN 0 ELSE greatest(-1, least(1, (0.9 * CASE WHEN vix IS NULL THEN 0 ELSE greatest(-1, least(1, 0.5 - (vix - 15) / 30)) END + 0.7 * CASE WHEN dvol IS NULL THEN 0 ELSE greatest(-1, least(1, dvol / 2)) END) / (0.9 * (vix IS NOT NULL)::INT + 0.7 * (dvol IS NOT NULL)::INT))) END AS t,
 CASE WHEN vix IS NULL AND dvol IS NULL THEN 0.2 ELSE (0.9 * (vix IS NOT NULL)::INT + 0.7 * (dvol IS NOT NULL)::INT) / ((vix IS NOT NULL)::INT + (dvol IS NOT NULL)::INT) END AS tc FROM x)
 SELECT symbol, date, round(greatest(-1, least(1, (0.4 * rc * r + 0.35 * fc * f + 0.25 * tc * t) / (0.4 * rc + 0.35 * fc + 0.25 * tc))), 6) AS sentiment, round(0.4 * rc + 0.35 * fc + 0.25 * tc, 6) AS confidence FROM p""")
def exp21_institutional_sentiment(spark, sf):
    """News, on-chain and market components, each with the confidence of what is there; the day's volatility stands in for the yield spread."""
    d = _macro(spark, sf)
    parts = E.institutional_sentiment({"regulatory": (F.col("news") - 50) / 50, "articles": F.col("trades"), "peg": F.col("peg"), "vix": F.col("vix"), "yield_spread": F.col("dvol")})
    return d.select("symbol", "date", r(parts["sentiment"]).alias("sentiment"), r(parts["confidence"]).alias("confidence"))


@query("""SELECT conv_id || '-' || turn AS content_id, CASE WHEN turn = 0 THEN 'submission' ELSE 'comment' END AS content_type, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN '' ELSE coalesce(text, '') END AS text,
 CASE WHEN turn = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'post/' || conv_id ELSE '' END END AS url, CASE WHEN conv_id % 7 = 0 THEN '[deleted]' ELSE role END AS author, CASE WHEN turn > 0 THEN conv_id || '-0' END AS parent_id FROM conversations""")
def src16_posts(spark, sf):
    """Submissions and comments as one record; every third submission is a link, every seventh conversation has lost its authors."""
    c = V.table(spark, sf, "conversations")
    key = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    c = c.withColumns({"id": key(F.col("turn")), "author": F.when(F.col("conv_id") % 7 != 0, F.col("role"))})
    posts = c.where("turn = 0").select("id", "text", "author", (F.col("conv_id") % 3 != 0).alias("is_self"), F.concat(F.lit("post/"), F.col("conv_id").cast("string")).alias("url"))
    replies = c.where("turn > 0").select("id", F.col("text").alias("body"), "author", key(F.lit(0)).alias("parent_id"))
    return V.posts(posts, replies)


@query(f"{BARS}, n AS (SELECT b.symbol, b.date, close, row_number() OVER (PARTITION BY b.symbol ORDER BY b.date) AS i, count(*) OVER (PARTITION BY b.symbol) AS n FROM bars b) SELECT symbol, date, round(close, 4) AS close, CASE WHEN i <= 0.7 * n THEN 'train' ELSE 'test' END AS part FROM n")
def flt02_train_test(spark, sf):
    """The first seven tenths of a series and the rest."""
    s = Window.partitionBy("symbol")
    d = V.bars(spark, sf).select("symbol", "date", r("close", 4).alias("close"), F.row_number().over(W.by_day()).alias("i"), F.count(F.lit(1)).over(s).alias("n"))
    return d.select("symbol", "date", "close", F.when(F.col("i") <= 0.7 * F.col("n"), "train").otherwise("test").alias("part"))
