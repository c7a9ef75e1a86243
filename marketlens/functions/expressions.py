"""Column expressions shared by batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut-offs of the five regimes, of the variants, and the words of the keyword score.
REGIMES = ("extreme_fear", "fear", "neutral", "greed", "extreme_greed")
CUTS = (25, 45, 55, 75)
PLACEBO_CUTS = (25, 40, 60, 75)
POSITIVE = ("approved", "huge", "moon", "great", "success", "bought", "stronger")
NEGATIVE = ("collapse", "scam", "lost", "hack", "suing", "winter")
UNCERTAIN = ("not sure", "cautious", "either way", "conflicting")
# Share of the macro signal by state.
MACRO_WEIGHTS = {"crisis": 0.60, "regulatory": 0.70, "bearish": 0.45, "bullish": 0.25, "neutral": 0.30}


def sentiment_score(v: Column) -> Column:
    return (v - 50) / 50


def bin_regime(v: Column, cuts: tuple = CUTS, closed: bool = True) -> Column:
    """Five levels; a null value is 'unknown'.  ``closed``: a cut-off belongs to the lower level."""
    out = F.when(v.isNull(), "unknown")
    for name, cut in zip(REGIMES, cuts):
        out = out.when((v <= cut) if closed else (v < cut), name)
    return out.otherwise(REGIMES[-1])


def is_extreme(regime: Column) -> Column:
    return regime.isin("extreme_fear", "extreme_greed")


def strength(regime: Column) -> Column:
    """Null for a null or unknown regime, which joins no group."""
    return F.when(is_extreme(regime), "extreme").when(regime.isin("fear", "greed"), "moderate").when(regime == "neutral", "neutral")


def direction(regime: Column) -> Column:
    return F.when(regime.isin("fear", "extreme_fear"), "bearish").when(regime.isin("greed", "extreme_greed"), "bullish").when(regime == "neutral", "neutral")


def distance_from_neutral(v: Column) -> Column:
    return F.abs(v - 50) / 50


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalise(x: Column, low: float, high: float) -> Column:
    """Linear to [0, 1], clamped."""
    return clamp((x - low) / (high - low), 0.0, 1.0)


def entropy(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda a, p: a - F.greatest(p, F.lit(1e-10)) * F.ln(F.greatest(p, F.lit(1e-10))))


def mean_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def pop_std(xs: Column) -> Column:
    mean = mean_of(xs)
    return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(xs))


def divided(a: Column, b: Column) -> Column:
    """a / b of floating-point numbers as IEEE 754 has it: infinite over a zero (by its sign), NaN for 0 / 0; null only if a part is null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def book_features(bids: Column, asks: Column, depth: int = 10, ieee: bool = False) -> dict[str, Column]:
    """Best prices, mid, spread, side volumes and imbalance of nested levels [price, quantity]; null-safe on an empty side.

    Over a mid of zero the spread in basis points is null, over no volume the imbalance 0; with ``ieee`` both are as ``divided`` has them."""
    bid, ask = F.get(F.get(bids, 0), 0), F.get(F.get(asks, 0), 0)
    volume = lambda side: F.aggregate(side, F.lit(0.0), lambda a, level: a + F.get(level, 1))
    mid, b, a = (bid + ask) / 2, volume(bids), volume(asks)
    ratio = divided if ieee else F.try_divide
    imbalance = ratio(b - a, b + a)
    return {
        "best_bid": bid, "best_ask": ask, "mid_price": mid, "spread": ask - bid, "spread_bps": ratio(ask - bid, mid) * 10_000, "bid_volume": b, "ask_volume": a,
        "imbalance": imbalance if ieee else F.coalesce(imbalance, F.lit(0.0)), "bids": F.slice(bids, 1, depth), "asks": F.slice(asks, 1, depth),
    }


def found_words(text: Column, words: tuple) -> Column:
    """How many of the words or phrases occur in the text, whatever their case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def keyword_class(text: Column) -> Column:
    """positive, negative or neutral by the majority of its words."""
    up, down = found_words(text, POSITIVE), found_words(text, NEGATIVE)
    return F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")


def completeness(*fields: Column) -> Column:
    return sum((F.when(f.isNotNull(), 1).otherwise(0) for f in fields), F.lit(0)) / len(fields)


def weighted_mean(*pairs: tuple[Column, float]) -> Column:
    """Weighted mean of the values that are there; null if none is."""
    total = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    return F.try_divide(total, weight)


def _component(parts: list[tuple[Column, float]], confidence: float) -> tuple[Column, Column]:
    """(weighted mean of the parts that are there within -1 to 1, their mean weight); 0 and ``confidence`` without any."""
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v, _ in parts), F.lit(0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    value = F.coalesce(weighted_mean(*parts), F.lit(0.0))
    return clamp(value, -1.0, 1.0), F.coalesce(F.try_divide(weight, n), F.lit(confidence))


def institutional_sentiment(fields: dict[str, Column]) -> dict[str, Column]:
    """Regulatory, on-chain and market components blended by weight times confidence; risks run from 0 to 100, stress from 0 to 1.

    Fields that may be given: regulatory, articles, opacity, tvl_stress, peg, stablecoin_risk, liquidity_risk, vix, yield_spread, contagion.
    """
    none = F.lit(None).cast("double")
    f = lambda name: fields.get(name, none)
    risk = lambda c: 1 - 2 * c / 100
    within = lambda c: F.when(c.isNotNull(), clamp(c, -1.0, 1.0))
    opaque = f("opacity").isNotNull()
    articles = F.when(f("articles") > 0, F.least(F.lit(1.0), f("articles") / 20)).otherwise(0.5)
    regulatory = F.coalesce(f("regulatory"), risk(f("opacity")), F.lit(0.0)), F.when(f("regulatory").isNotNull(), articles).when(opaque, 0.8).otherwise(0.3)
    peg = F.when(f("peg").isNotNull(), 1 - F.least(f("peg") * 100, F.lit(2.0)))
    chain = _component([(1 - 2 * f("tvl_stress"), 0.8), (peg, 0.9), (risk(f("stablecoin_risk")), 0.9), (risk(f("liquidity_risk")), 0.9)], 0.2)
    market = _component([(within(0.5 - (f("vix") - 15) / 30), 0.9), (within(f("yield_spread") / 2), 0.7), (risk(f("contagion")), 0.85)], 0.2)
    weights = {"regulatory": (0.40, regulatory), "chain": (0.35, chain), "market": (0.25, market)}
    total = sum((w * conf for w, (_, conf) in weights.values()), F.lit(0.0))
    shares = {f"{name}_contribution": w * conf * value / F.greatest(total, F.lit(0.01)) for name, (w, (value, conf)) in weights.items()}
    blend_ = sum((w * conf * value for w, (value, conf) in weights.values()), F.lit(0.0))
    return {"sentiment": clamp(F.coalesce(F.try_divide(blend_, total), F.lit(0.0)), -1.0, 1.0), "confidence": total, **shares}


def mean_risk(news: Column, vix: Column, peg: Column) -> Column:
    """Mean of the risk terms that are there, 0 to 100; null if none is."""
    return weighted_mean((news, 1.0), (F.when(vix.isNotNull(), clamp((vix - 15) / 35 * 100, 0.0, 100.0)), 1.0), (F.when(peg.isNotNull(), F.least(peg * 1000, F.lit(100.0))), 1.0))


def alert_level(risk: Column) -> Column:
    out = F.when(risk.isNull(), "unknown")
    for name, cut in (("critical", 80), ("high", 65), ("elevated", 50), ("moderate", 35)):
        out = out.when(risk >= cut, name)
    return out.otherwise("low")


def decompose_uncertainty(opacity, news, complete, micro_epistemic, dvol, realised, vix, peg, micro_aleatoric, regime) -> dict[str, Column]:
    """Epistemic and aleatoric uncertainty, both 0 to 1, as weighted terms with defaults for what is missing."""
    part = lambda x, low, width: F.when(x.isNotNull(), clamp((x - low) / width, 0.0, 1.0))
    epistemic = 0.35 * F.coalesce(opacity / 100, part(news, 30, 50), F.lit(0.3)) + 0.25 * (1 - complete) + 0.40 * clamp(micro_epistemic / 0.3, 0.0, 1.0)
    aleatoric = 0.35 * F.coalesce(part(dvol, 30, 120), part(realised, 30, 120), F.lit(0.25)) + 0.15 * F.coalesce(part(vix, 10, 40), F.lit(0.2))
    aleatoric = aleatoric + 0.25 * F.coalesce(part(peg, 0, 0.05), F.lit(0.1)) + 0.25 * clamp(micro_aleatoric / 1.1, 0.0, 1.0)
    more = F.when(regime == "crisis", 0.2).when(regime == "regulatory", 0.15).otherwise(0.0)
    return {"epistemic": clamp(epistemic + more, 0.0, 1.0), "aleatoric": clamp(aleatoric + F.when(regime == "crisis", 0.3).otherwise(0.0), 0.0, 1.0)}


def blend(macro: Column, micro: Column, state: Column, confidence: Column) -> tuple[Column, Column]:
    """(weight of the macro signal by state and confidence, blended signal within -1 and 1)."""
    weight = F.lit(MACRO_WEIGHTS["neutral"])
    for name, w in MACRO_WEIGHTS.items():
        weight = F.when(state == name, w).otherwise(weight)
    weight = weight * confidence
    return weight, clamp(weight * macro + (1 - weight) * micro, -1.0, 1.0)


def sign_class(x: Column, cut: float, above: str, below: str, between: str) -> Column:
    return F.when(x > cut, above).when(x < -cut, below).otherwise(between)


def probability_sentiment(p: Column) -> Column:
    return 2 * (p - 0.5)


def bayesian_split(samples: Column, classes: int) -> dict[str, Column]:
    """Epistemic, aleatoric and total uncertainty and mutual information of sampled class probabilities."""
    import math

    part = lambda k: F.transform(samples, lambda s: F.get(s, k))
    epistemic = F.least(sum((F.pow(pop_std(part(k)), 2) for k in range(classes)), F.lit(0.0)) / (0.25 * classes), F.lit(1.0))
    aleatoric = mean_of(F.transform(samples, entropy)) / math.log(classes)
    total = entropy(F.array(*[mean_of(part(k)) for k in range(classes)])) / math.log(classes)
    return {"epistemic": epistemic, "aleatoric": aleatoric, "entropy": total, "mutual_info": F.greatest(total - aleatoric, F.lit(0.0)), "total": F.least(epistemic + aleatoric, F.lit(1.0))}


def valid_book(bid: Column, ask: Column) -> Column:
    """A positive mid and a spread that is not negative."""
    return (bid + ask > 0) & (ask >= bid)


def market_book(bids: Column, asks: Column, depth: int = 10) -> dict[str, Column]:
    """Best prices, depth and imbalance over the first levels (price, size), in whatever order they come."""
    price = lambda side: F.transform(F.slice(side, 1, depth), lambda x: x["price"])
    total = lambda side: F.aggregate(F.slice(side, 1, depth), F.lit(0.0), lambda a, x: a + x["size"])
    b, a = total(bids), total(asks)
    return {"best_bid": F.array_max(price(bids)), "best_ask": F.array_min(price(asks)), "bid_depth": b, "ask_depth": a, "imbalance": F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0))}


def effect_label(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def composite_volatility(implied: Column, vix: Column, realised: Column, default: float) -> Column:
    """0.7 implied + 0.3 VIX with fallbacks; a zero implied volatility counts as missing."""
    implied = F.nullif(implied, F.lit(0.0))
    return F.coalesce(0.7 * implied + 0.3 * vix, implied, vix, realised, F.lit(default))


def stars(p: Column) -> Column:
    """Marks of significance: below 0.1 %, 1 %, 5 % and 10 %."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, "†").otherwise("")


# Coefficients of the rational approximation of the inverse normal distribution (error below 1.15e-9), middle and tails.
NORMAL_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
NORMAL_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
NORMAL_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
NORMAL_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
NORMAL_TAIL = 0.02425


def _polynomial(x: Column, coefficients: tuple) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which lies the share ``p`` (between 0 and 1, both excluded)."""
    q, low = p - 0.5, F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _polynomial(low, NORMAL_C) / _polynomial(low, NORMAL_D)
    middle = q * _polynomial(q * q, NORMAL_A) / _polynomial(q * q, NORMAL_B)
    return F.when(p < NORMAL_TAIL, tail).when(p > 1 - NORMAL_TAIL, -tail).otherwise(middle)


# Weights of the terms of both uncertainties, and what stands for the macro terms where a row has no macro data at all.
EPISTEMIC_WEIGHTS = {"regulatory": 0.35, "missing": 0.25, "samples": 0.40}
ALEATORIC_WEIGHTS = {"implied": 0.35, "vix": 0.15, "peg": 0.25, "entropy": 0.25}
WITHOUT_MACRO = {"regulatory": 0.5, "missing": 1.0, "implied": 0.25, "vix": 0.25, "peg": 0.1}


def uncertainty_breakdown(macro: Column, regime: Column, boosted: bool = True, **f: Column) -> dict[str, Column]:
    """Each term of both uncertainties, their source and the totals; ``macro`` tells whether a row has macro data at all.

    Fields: opacity, news, completeness, implied, implied_normal, realised, vix, vix_normal, peg, samples (spread) and entropy; absent ones may
    be left out.  The 0.15 for a regulatory regime is left out where ``boosted`` is false.
    """
    none = F.lit(None).cast("double")
    at = lambda n: f.get(n, none)
    part = lambda x, low, width: F.when(x.isNotNull(), clamp((x - low) / width, 0.0, 1.0))
    implied, realised = F.coalesce(at("implied_normal"), part(at("implied"), 30, 120)), part(at("realised"), 30, 120)
    terms = {
        "regulatory": F.coalesce(at("opacity") / 100, part(at("news"), 30, 50), F.lit(0.3)), "missing": 1 - F.coalesce(at("completeness"), F.lit(0.0)),
        "implied": F.coalesce(implied, realised, F.lit(0.25)), "vix": F.coalesce(at("vix_normal"), part(at("vix"), 10, 40), F.lit(0.2)), "peg": F.coalesce(part(at("peg"), 0, 0.05), F.lit(0.1)),
    }
    terms = {n: F.when(macro, c).otherwise(WITHOUT_MACRO[n]) for n, c in terms.items()}
    terms |= {"samples": clamp(at("samples") / 0.3, 0.0, 1.0), "entropy": clamp(at("entropy") / 1.1, 0.0, 1.0)}
    source = F.when(macro & implied.isNotNull(), "implied").when(macro & realised.isNotNull(), "realised").otherwise("unavailable")
    epistemic = sum((w * terms[n] for n, w in EPISTEMIC_WEIGHTS.items()), F.lit(0.0))
    aleatoric = sum((w * terms[n] for n, w in ALEATORIC_WEIGHTS.items()), F.lit(0.0))
    more = F.when(regime == "crisis", 0.2).when((regime == "regulatory") & F.lit(boosted), 0.15).otherwise(0.0)
    totals = {"epistemic": clamp(epistemic + more, 0.0, 1.0), "aleatoric": clamp(aleatoric + F.when(regime == "crisis", 0.3).otherwise(0.0), 0.0, 1.0)}
    return {**totals, **{f"{n}_term": c for n, c in terms.items()}, "source": source}


# Share of prediction markets in the three-source blend.
PREDICTION_WEIGHT = 0.2


def third_source(sentiment: Column, epistemic: Column, market_sentiment: Column, market_uncertainty: Column, weight: float = PREDICTION_WEIGHT) -> dict[str, Column]:
    """A tick blended with prediction markets, as it is where there are none: weighted sentiment, the greater epistemic uncertainty."""
    there = market_sentiment.isNotNull()
    return {"sentiment": F.when(there, weight * market_sentiment + (1 - weight) * sentiment).otherwise(sentiment), "epistemic": F.when(there, F.greatest(epistemic, market_uncertainty)).otherwise(epistemic)}


# Weights of the composite index.
COMPOSITE = {"pk": 0.35, "rv": 0.25, "cs": 0.20, "extreme": 0.20}


def composite_index(z: dict[str, Column], extreme: Column, as_written: bool) -> Column:
    """Weighted z values (cut at 2, over 4) and half the extreme flag, within 0 and 1.

    ``as_written`` keeps a slip of precedence by which a half is added once per term, which puts most values at 1."""
    parts = [F.when(c.isNotNull(), COMPOSITE[n] * clamp(c, -2.0, 2.0) / 4) for n, c in z.items()]
    total = sum(parts, F.lit(0.5 * len(parts) if as_written else 0.5)) + COMPOSITE["extreme"] * 0.5 * extreme.cast("double")
    return F.when(sum(parts, F.lit(0.0)).isNotNull(), clamp(total, 0.0, 1.0))


# Limits and confidences of the regime detector.
BULLISH, BEARISH, REGULATORY_BELOW, LEAST_ARTICLES = 0.25, -0.25, -0.35, 3


def regime_candidate(smoothed: Column, alert: Column, regulatory: Column, articles: Column) -> dict[str, Column]:
    """The regime that a day speaks for and how clearly: alerts first, then bad regulatory news in number, then the smoothed signal."""
    crisis = F.coalesce(alert.isin("high", "critical"), F.lit(False))
    news = F.coalesce((regulatory < REGULATORY_BELOW) & (articles >= LEAST_ARTICLES), F.lit(False))
    above = lambda x: F.least(0.5 + x * 2, F.lit(0.95))
    name = F.when(crisis, "crisis").when(news, "regulatory").when(smoothed > BULLISH, "bullish").when(smoothed < BEARISH, "bearish").otherwise("neutral")
    clear = F.when(crisis, 0.9).when(news, 0.85).when(smoothed > BULLISH, above(smoothed - BULLISH)).when(smoothed < BEARISH, above(BEARISH - smoothed)).otherwise(0.5 + 0.3 * (1 - F.abs(smoothed) / BULLISH))
    return {"candidate": name, "confidence": clear}
