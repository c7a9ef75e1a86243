"""Registered sweeps of regression specifications, interactions, robust joint tests and effect labels; beside their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import expressions as E
from marketlens.operators import resample as R
from marketlens.operators import specs, stats
from marketlens.operators import windows as W
from marketlens.plans.details import _WEIGHT
from marketlens.plans.queries import _HASH, DAILY, S, daily, query, r
from marketlens.plans.studies import _WITHIN, _each, _line

REGIMES = [n for n in E.REGIMES if n != "neutral"]
CONTROLS = ["rv", "rv_sq", "abs_ret", "log_volume"]
DAYS = [f"dow_{i}" for i in range(6)]
MONTHS = [f"month_{i}" for i in range(1, 12)]
YEARS = [f"year_{y}" for y in range(1995, 2001)]
# The seven specifications, and with which one each R2 is compared.
SPECS = {
    "M1": REGIMES, "M2": [*REGIMES, "rv", "rv_sq"], "M3": [*REGIMES, *CONTROLS], "M4": [*REGIMES, *CONTROLS, *DAYS], "M5": [*REGIMES, *CONTROLS, *DAYS, *MONTHS, *YEARS],
    "M6": ["distance", *CONTROLS, *DAYS], "M7": ["is_extreme", *CONTROLS, *DAYS],
}
NESTED = {"M2": "M1", "M3": "M2", "M4": "M3", "M5": "M4"}


def prepared(spark, sf):
    """Days with a positive spread and every column of every specification."""
    d = daily(spark, sf).where("cs > 0")
    flag = lambda test: test.cast("double")
    return d.withColumns({
        **{n: flag(F.col("regime") == n) for n in REGIMES}, "rv_sq": F.col("rv") * F.col("rv"), "abs_ret": F.abs("ret"), "log_volume": F.ln("volume"), "distance": E.distance_from_neutral(F.col("fg")),
        "is_extreme": flag(F.col("strength") == "extreme"), **{n: flag(F.weekday("date") == i) for i, n in enumerate(DAYS)}, **{n: flag(F.month("date") == i) for i, n in enumerate(MONTHS, 1)},
        **{n: flag(F.year("date") == int(n[5:])) for n in YEARS},
    })


@query()
def reg04_specifications(spark, sf):
    """Seven specifications from one Gram matrix a symbol: fit, joint F and what each adds to the one before."""
    found = specs.specifications(prepared(spark, sf), "cs", SPECS, nested=NESTED)
    return found.select("symbol", "spec", "n", "rank", *_each("r2", "adj_r2", "f", "p", "delta_r2"))


@query(f"""{DAILY}, {_WITHIN} SELECT symbol, unnest(['regimes', 'regimes_vol']) AS spec, unnest([n, n])::BIGINT AS n, round(unnest([1 - wyy / tyy, 1 - rss / tyy]), 6) AS r2, round(unnest([NULL, (wyy - rss) / tyy]), 6) AS delta_r2, round(unnest([(tyy - wyy) / q / (wyy / (n - q - 1)), (tyy - rss) / (q + 1) / (rss / (n - q - 2))]), 4) AS f FROM w JOIN t USING (symbol)""")
def reg04_two_specifications(spark, sf):
    """Regimes alone and beside volatility, by the same sweep."""
    d = _line(spark, sf).withColumns({n: (F.col("regime") == n).cast("double") for n in REGIMES})
    found = specs.specifications(d, "cs", {"regimes": REGIMES, "regimes_vol": [*REGIMES, "x"]}, nested={"regimes_vol": "regimes"})
    return found.select("symbol", "spec", "n", *_each("r2", "delta_r2"), r("f", 4).alias("f"))


_INTERACTIONS = [f"vol_{n}" for n in REGIMES]


def _interacted(spark, sf):
    d = _line(spark, sf).withColumns({n: (F.col("regime") == n).cast("double") for n in REGIMES})
    return d.withColumns({f"vol_{n}": F.col(n) * F.col("x") for n in REGIMES})


@query(f"""{DAILY}, {_WITHIN}, z AS (SELECT symbol, sxy / sxx AS b FROM g WHERE regime = 'neutral'), c AS (SELECT symbol FROM g GROUP BY 1 HAVING count(*) = 5 AND min(n) > 2) SELECT g.symbol, 'vol_' || regime AS term, round(sxy / sxx - b, 3) AS coef FROM g JOIN z USING (symbol) JOIN c USING (symbol) WHERE regime <> 'neutral'""")
def reg06_interactions(spark, sf):
    """How much steeper than on neutral days spreads rise with volatility in each regime."""
    found = specs.specifications(_interacted(spark, sf), "cs", {"all": ["x", *REGIMES, *_INTERACTIONS]}).where("rank = 10")
    return found.select("symbol", F.explode("coefs").alias("term", "coef")).where(F.col("term").isin(_INTERACTIONS)).select("symbol", "term", r("coef", 3).alias("coef"))


@query(f"""{DAILY}, {_WITHIN}, i AS (SELECT symbol, count(*) AS k, sum(syy - sxy * sxy / sxx) AS rss_i FROM g GROUP BY 1 HAVING count(*) = 5 AND min(n) > 2) SELECT symbol, k - 1 AS q, (n - 2 * k)::BIGINT AS dof, round((rss - rss_i) / (k - 1) / (rss_i / (n - 2 * k)), 4) AS f FROM w JOIN i USING (symbol)""")
def reg06_joint_interactions(spark, sf):
    """Do slopes differ between regimes at all?"""
    found = specs.block_f(_interacted(spark, sf), "cs", ["x", *REGIMES], ["x", *REGIMES, *_INTERACTIONS]).where("q = 4")
    return found.select("symbol", F.col("q").cast("long").alias("q"), "dof", r("f", 4).alias("f"))


@query()
def reg05_robust_wald(spark, sf):
    """Joint test of the regime dummies under HAC errors of ten lags, in the specifications that have them."""
    _, joint = specs.robust_tests(prepared(spark, sf), "cs", SPECS, {m: REGIMES for m in ("M1", "M2", "M3", "M4", "M5")})
    return joint.select("symbol", "spec", "q", *_each("wald", "f", "p", digits=5))


@query(f"""{DAILY}, x AS (SELECT symbol, cs AS y, (strength = 'extreme')::INT AS e FROM daily WHERE cs IS NOT NULL AND strength IS NOT NULL), m AS (SELECT symbol, count(*) AS n, avg(e) AS me, regr_slope(y, e) AS b, regr_intercept(y, e) AS a FROM x GROUP BY 1),
 s AS (SELECT symbol, any_value(n) AS n, any_value(b) AS b, sum(pow((e - me) * (y - a - b * e), 2)) / pow(any_value(n) * any_value(me) * (1 - any_value(me)), 2) AS v FROM x JOIN m USING (symbol) GROUP BY 1) SELECT symbol, round(b, 4) AS coef, round(sqrt(v * n / (n - 2)), 4) AS se, round(b * b / (v * n / (n - 2)), 4) AS wald FROM s""")
def reg05_wald_of_extremes(spark, sf):
    """The robust test of one dummy, HC1, by the same operator; every symbol with a spread has its row.

    Where all days are alike the coefficient is 0 / 0 (NaN) without error and test (null); a line through two days has an error of 0 / 0."""
    d = daily(spark, sf).where("cs is not null and strength is not null").withColumn("e", (F.col("strength") == "extreme").cast("double"))
    terms, joint = specs.robust_tests(d, "cs", {"one": ["e"]}, {"one": ["e"]}, "HC1")
    line = d.groupBy("symbol").agg((F.min("e") < F.max("e")).alias("told"), F.regr_slope("cs", "e").alias("slope"))
    terms, joint = terms.where("term = 'e'").select("symbol", F.col("coef").alias("b"), F.col("se").alias("s")), joint.select("symbol", F.col("wald").alias("w"))
    found = line.join(terms, "symbol", "left").join(joint, "symbol", "left")
    nan = F.lit(float("nan"))
    found = found.withColumns({"coef": F.when(F.col("told"), F.coalesce("b", "slope")).otherwise(nan), "se": F.when(F.col("told"), F.coalesce("s", nan))})
    found = found.withColumn("wald", F.when(F.col("told"), F.coalesce("w", E.divided(F.col("coef") * F.col("coef"), F.col("se") * F.col("se")))))
    return found.select("symbol", *_each("coef", "se", "wald", digits=4))


@query(f"""{DAILY}, l AS (SELECT symbol, regr_slope(cs, rv) AS s, regr_intercept(cs, rv) AS i FROM daily WHERE cs IS NOT NULL AND rv IS NOT NULL GROUP BY 1), q AS (SELECT d.symbol, date, cs - i - s * rv AS e, strength FROM daily d JOIN l ON d.symbol = l.symbol), k AS (SELECT symbol, e, row_number() {S} AS n, {", ".join(f"lead(strength, {k}) {S} AS s{k}" for k in (1, 3, 5, 7))} FROM q),
 u AS (SELECT symbol, n, e, unnest([1, 3, 5, 7]) AS ahead, unnest([s1, s3, s5, s7]) AS s FROM k WHERE e IS NOT NULL), x AS (SELECT symbol, ahead, rep, e, s, {_HASH} AS h FROM u, range(200) t(rep) WHERE s IS NOT NULL),
 g AS (SELECT symbol, ahead, rep, sum(CASE WHEN s = 'extreme' THEN w * e END) / nullif(sum(CASE WHEN s = 'extreme' THEN w END), 0) - sum(CASE WHEN s <> 'extreme' THEN w * e END) / nullif(sum(CASE WHEN s <> 'extreme' THEN w END), 0) AS b FROM (SELECT *, {_WEIGHT} AS w FROM x) GROUP BY 1, 2, 3),
 o AS (SELECT symbol, ahead, regr_slope(e, (s = 'extreme')::INT) AS slope FROM u WHERE s IS NOT NULL GROUP BY 1, 2)
 SELECT symbol, ahead, round(any_value(slope), 4) AS slope, round(quantile_cont(b, 0.025), 4) AS low, round(quantile_cont(b, 0.975), 4) AS high, (quantile_cont(b, 0.025) <= 0 AND quantile_cont(b, 0.975) >= 0) AS holds FROM g JOIN o USING (symbol, ahead) GROUP BY 1, 2""")
def reg12_reversed_slope(spark, sf):
    """Slope of today's residual spread on the flag of an extreme day to come, with its bootstrap interval; it should hold zero."""
    d = stats.residuals(daily(spark, sf), "cs", "rv").withColumn("n", F.row_number().over(W.by_day()).cast("long"))
    later = F.array(*[F.struct(F.lit(k).alias("ahead"), F.lead("strength", k).over(W.by_day()).alias("s")) for k in (1, 3, 5, 7)])
    d = d.withColumn("l", later).select("symbol", "n", "resid", F.explode("l").alias("l")).select("symbol", "n", "resid", "l.*").where("resid is not null and s is not null")
    extreme = F.col("s") == "extreme"
    sums = {f"{k}_{a}": F.when(test, c) for k, test in (("e", extreme), ("o", ~extreme)) for a, c in (("sum", F.col("resid")), ("n", F.lit(1.0)))}
    draws = R.resampled(d, "n", sums, {"b": F.try_divide("e_sum", "e_n") - F.try_divide("o_sum", "o_n")}, 200, ["symbol", "ahead"])
    slope = d.groupBy("symbol", "ahead").agg(F.regr_slope("resid", extreme.cast("int")).alias("slope"))
    q = F.percentile("b", F.array(F.lit(0.025), F.lit(0.975)))
    g = draws.groupBy("symbol", "ahead").agg(F.get(q, 0).alias("low"), F.get(q, 1).alias("high")).join(slope, ["symbol", "ahead"])
    return g.select("symbol", "ahead", *_each("slope", "low", "high", digits=4), ((F.col("low") <= 0) & (F.col("high") >= 0)).alias("holds"))
