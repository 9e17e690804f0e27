"""Features of the slow frame and between the frames. Slow features are made on the slow bars, before the join, so that
their lags are slow bars; regimes rank a bar in its trailing window only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import windows as w

from . import asof, features
from .features import beyond, over, regime_of, sign

c, flag = F.col, w.flag


def slow_features(slow: DataFrame) -> DataFrame:
    out = features.add(slow, "base", "adx", "streaks")
    ma10, ma20 = w.mean("close", 10), w.mean("close", 20)
    rank = w.percent_rank("atr_pct", 50)
    down = c("close") < c("open")
    out = out.withColumns({
        "touched_upper_bb": flag(c("high") >= c("upper_band")), "rsi_overbought": flag(c("rsi_value") >= 70), "rsi_extreme": flag(c("rsi_value") >= 80), "rsi_oversold": flag(c("rsi_value") <= 30), "bearish_candle": flag(down), "bullish_candle": flag(c("close") > c("open")), "strong_bearish": flag(down & (c("candle_body_pct") > 0.6)), "bb_very_high": flag(c("bb_position") > 0.95), "bb_high": flag(c("bb_position") >= 0.8), "bb_low": flag(c("bb_position") <= 0.2),
        "rsi_slope_3": w.slope("rsi_value", 3), "rsi_slope_5": w.slope("rsi_value", 5), **{f"price_roc_{k}": w.change("close", k) for k in (3, 5, 10)}, "bb_position_slope_3": w.slope("bb_position", 3), "volume_slope_3": w.slope("volume_ratio", 3), "dist_from_ma10": w.safe_div(c("close") - ma10, ma10), "dist_from_ma20": w.safe_div(c("close") - ma20, ma20), "overextension": w.safe_div(c("close") - c("middle_band"), "middle_band"),
        "atr_percentile": rank, "bb_squeeze": flag(c("bb_width_pct") < w.quantile("bb_width_pct", 0.2, 20)), "volatility_regime": regime_of(rank), "trend_direction": sign(beyond("close", ma20)), "near_d1_high": flag(c("close") > w.high("close", 20) * 0.98), "shooting_star": flag((c("candle_rejection") > 0.6) & (c("candle_body_pct") < 0.3) & down),
        "bearish_divergence": flag((c("close") > w.lag("close", 5)) & (c("rsi_value") < w.lag("rsi_value", 5))), "price_zscore": w.zscore("close", 20), "rsi_zscore": w.zscore("rsi_value", 20),
    })
    return out.withColumns({"is_trending_up": flag(c("trend_direction") > 0), "is_trending_down": flag(c("trend_direction") < 0)})


def cross_features(joined: DataFrame, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """mtf_ and h4_vs_d1_ columns of a joined frame that has rsi_value, bb_position, trend_direction_h4, price_slope_3 and
    their d1_ counterparts. weights: of RSI, bands, trend and bearish alignment in the confluence score."""
    both = lambda x, v: (c(x) >= v) & (c(f"d1_{x}") >= v)
    out = joined.withColumns({
        "mtf_rsi_aligned": flag(both("rsi_value", 65)), "mtf_overbought_aligned": flag(both("rsi_value", 70)), "mtf_bb_aligned": flag((c("bb_position") > 0.8) & (c("d1_bb_position") > 0.8)), "mtf_trend_aligned": flag(c("trend_direction_h4") == c("d1_trend_direction")), "mtf_bearish_aligned": flag((c("close") < c("open")) & (c("d1_close") < c("d1_open"))),
        "mtf_rsi_divergence": flag((c("rsi_value") > 70) & (c("d1_rsi_value") < 50)), "mtf_bb_divergence": flag((c("bb_position") > 0.8) & (c("d1_bb_position") < 0.5)), "mtf_trend_divergence": flag((c("trend_direction_h4") > 0) & (c("d1_trend_direction") < 0)), "mtf_momentum_divergence": flag((c("price_slope_3") > 0) & (c("d1_price_roc_3") < 0)),
        "h4_position_in_d1_range": over(c("close") - c("d1_low"), c("d1_high") - c("d1_low")), "h4_vs_d1_bb_position": c("bb_position") - c("d1_bb_position"), "h4_vs_d1_rsi": c("rsi_value") - c("d1_rsi_value"), "h4_vs_d1_trend": c("trend_strength") - c("d1_trend_strength"), "h4_vs_d1_atr_ratio": w.safe_div("atr_pct", "d1_atr_pct"), "h4_vs_d1_range_ratio": over(c("high") - c("low"), c("d1_high") - c("d1_low")),
        "d1_supports_short": flag((c("d1_rsi_value") > 65) & (c("d1_bb_position") > 0.7)), "d1_supports_long": flag((c("d1_rsi_value") < 35) & (c("d1_bb_position") < 0.3)), "d1_opposes_short": flag((c("d1_rsi_value") < 40) & (c("d1_trend_direction") > 0.5)), "d1_opposes_long": flag((c("d1_rsi_value") > 60) & (c("d1_trend_direction") < -0.5)),
        "mtf_long_signal": flag((c("trend_strength") > 0.3) & (c("d1_trend_strength") > 0.3)), "mtf_short_signal": flag((c("trend_strength") < -0.3) & (c("d1_trend_strength") < -0.3)),
    })
    score = sum((c(x) * v for x, v in zip(("mtf_rsi_aligned", "mtf_bb_aligned", "mtf_trend_aligned", "mtf_bearish_aligned"), weights)), F.lit(0.0))
    return out.withColumns({"mtf_confluence_score": score, "d1_neutral": flag((c("d1_supports_short") == 0) & (c("d1_opposes_short") == 0)), "mtf_strong_short_setup": flag((c("rsi_value") >= 70) & (c("d1_rsi_value") >= 70) & (score >= 0.5))})


#: What cross_features reads of a fast row and of its slow one.
CROSS_FAST = ["open", "high", "low", "close", "rsi_value", "bb_position", "trend_strength", "atr_pct", "trend_direction_h4", "price_slope_3"]
CROSS_SLOW = ["open", "high", "low", "close", "rsi_value", "bb_position", "trend_strength", "atr_pct", "trend_direction", "price_roc_3"]


def joined(fast: DataFrame, slow: DataFrame, fast_names: list[str], slow_names: list[str], *families: str) -> DataFrame:
    """Only the fast features named and the previous day's slow ones (as d1_...): the join packs rows, so that Spark can't leave out unread
    columns by itself, and tasks would sort all of them."""
    ready = features.add(fast, *dict.fromkeys(("base", *families))).select("key", "ts", *fast_names)
    return asof.previous_day(ready, slow_features(slow).select("key", "ts", *slow_names))


def merged(fast: DataFrame, slow: DataFrame, *families: str) -> DataFrame:
    """Fast features, the previous day's slow features and the cross features in one frame."""
    ready = features.add(fast, *dict.fromkeys(("base", "adx", "slopes", *families)))
    return cross_features(asof.previous_day(ready, slow_features(slow)))


def slow_ema_features(slow: DataFrame) -> DataFrame:
    """Averages of 21 and 50 slow bars and the trend against the first: 1 above it, else -1; strength is the relative distance."""
    out = w.emas(slow, {"ema_21": ("close", 21), "ema_50": ("close", 50)})
    return out.withColumns({
        "trend": F.when(c("close") > c("ema_21"), 1).otherwise(-1),
        "trend_strength": F.abs(F.try_divide(c("close") - c("ema_21"), "ema_21")),
        "rsi_overbought": flag(c("rsi_value") > 70), "rsi_oversold": flag(c("rsi_value") < 30), "rsi_momentum": w.diff("rsi_value"),
        "bb_extreme_high": flag(c("bb_position") > 0.9), "bb_extreme_low": flag(c("bb_position") < 0.1),
    })


def early_pairs(joined: DataFrame) -> DataFrame:
    """The early set's columns of a fast row and its slow one: the mean of d1_rsi_value runs over fast rows."""
    up, down = c("trend_strength") > 0.3, c("trend_strength") < -0.3
    return joined.withColumns({
        "d1_rsi_ma3": w.mean("d1_rsi_value", 3), "mtf_trend_alignment": c("trend_strength") * c("d1_trend_strength"),
        "mtf_long_signal": flag(up & (c("d1_trend_strength") > 0.3)), "mtf_short_signal": flag(down & (c("d1_trend_strength") < -0.3)),
    })


def pair_features(joined: DataFrame) -> DataFrame:
    """Differences, ratios and common states of a fast row and its slow one (columns d1_...)."""
    ratio = lambda a, b: F.try_divide(c(a), F.nullif(c(b), F.lit(0.0)))
    return joined.withColumns({
        "h4_d1_rsi_diff": c("rsi_value") - c("d1_rsi_value"), "h4_d1_rsi_ratio": ratio("rsi_value", "d1_rsi_value"),
        "d1_bb_extreme": flag(c("d1_bb_position") >= 0.95), "h4_d1_bb_diff": c("bb_position") - c("d1_bb_position"),
        "d1_uptrend": flag(c("d1_trend_strength") > 0.3), "d1_downtrend": flag(c("d1_trend_strength") < -0.3),
        "d1_strong_trend": flag(F.abs("d1_trend_strength") > 0.7), "h4_d1_trend_diff": c("trend_strength") - c("d1_trend_strength"),
        "h4_d1_trend_aligned": flag(F.signum("trend_strength") == F.signum("d1_trend_strength")),
        "mtf_trend_conflict": flag(F.signum("trend_strength") * F.signum("d1_trend_strength") < 0),
        "h4_d1_vol_ratio": ratio("atr_pct", "d1_atr_pct"), "d1_vol_high": flag(c("d1_atr_pct") > w.quantile("d1_atr_pct", 0.8, 20)),
        "mtf_rsi_both_overbought": flag((c("rsi_value") > 65) & (c("d1_rsi_value") > 65)), "mtf_rsi_both_oversold": flag((c("rsi_value") < 35) & (c("d1_rsi_value") < 35)),
        "mtf_bb_both_high": flag((c("bb_position") > 0.8) & (c("d1_bb_position") > 0.8)), "mtf_bb_both_low": flag((c("bb_position") < 0.2) & (c("d1_bb_position") < 0.2)),
    })
