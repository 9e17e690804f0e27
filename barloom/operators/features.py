"""Features of one frame of bars, family by family.

A family is a list of layers; a layer maps names to expressions over the bars and over earlier layers. All expressions of
a layer share one window order, so that Spark sorts once and runs one window step for each layer. Families name what they
read, and add() puts the ones they rest on first. Formulas with presets differ in cut-offs: `v1`, `combined`, `expanded`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import pieces
from barloom.functions import windows as w

c = F.col
flag, lag, diff, mean, std, safe = w.flag, w.lag, w.diff, w.mean, w.std, w.safe_div


class Since(NamedTuple):
    """In a layer: rows since the condition last held. It looks back without bound."""

    condition: Column


Layer = dict[str, Column | Since]
#: Rows that the windows of one layer look back, at most.
REACH = 100


def over(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(w.col(a), w.col(b))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def exporter() -> list[Layer]:
    """Base columns of the bar exporter. Defined here, as the blueprint only names them: momentum is the change over 5 bars,
    a touch is a bar whose high reaches the upper band, counted in the 10 bars before, and resistance is the highest high of 20 bars."""
    touched = c("high") >= c("upper_band")
    return [
        {
            "bb_touch_strength": over("high", "upper_band"), "prev_candle_body_pct": lag("candle_body_pct"), "prev_volume_ratio": lag("volume_ratio"),
            "gap_from_prev_close": over(c("open") - lag("close"), lag("close")), "price_momentum": w.change("close", 5),
            "resistance_distance_pct": over(w.high("high", 20) - c("close"), "close"), "__touched": flag(touched), "__since": Since(touched),
        },
        {"__n": w.total("__touched", 10)},
        {"previous_touches": lag("__n").cast("int"), "time_since_last_touch": (lag("__since") + 1).cast("int")},
    ]


def early() -> list[Layer]:
    """The early feature set: means of 5 bars, changes over 3, a mean range of 14 bars and its ratio to the last 50, sessions."""
    hour, day = F.hour("ts"), F.weekday("ts")
    return [
        {
            "atr_14": mean(c("high") - c("low"), 14),
            "bb_position_ma5": mean("bb_position", 5), "bb_trend": diff("bb_position", 3),
            "rsi_ma5": mean("rsi_value", 5), "rsi_trend": diff("rsi_value", 3), "rsi_momentum": diff("rsi_value", 5),
            "trend_strength_ma5": mean("trend_strength", 5), "trend_acceleration": diff("trend_strength", 3),
            "h4_uptrend": flag(c("trend_strength") > 0.3), "h4_downtrend": flag(c("trend_strength") < -0.3),
            "is_london": flag(hour.between(8, 11)), "is_ny": flag(hour.between(13, 16)), "is_overlap": flag(hour.between(13, 16)),
            "is_monday": flag(day == 0), "is_friday": flag(day == 4),
        },
        {"atr_14_pct": over("atr_14", "close"), "volatility_ratio": over("atr_14", mean("atr_14", 50))},
    ]


def sign(x: Column) -> Column:
    return F.coalesce(F.signum(x), F.lit(0.0))


def beyond(x: str, level: Column) -> Column:
    """x less a mean of prices, 0 where they differ by the rounding of the mean's sum only: a price may well be the mean of its window."""
    away = c(x) - level
    return F.when(F.abs(away) <= 1e-12 * (F.abs(c(x)) + F.abs(level)), 0.0).otherwise(away)


def base() -> list[Layer]:
    """Indicators that bars may lack: RSI and ATR (14, simple means), bands (20, 2), volume ratio, trend strength, candles."""
    gain, loss = F.greatest(c("__d"), F.lit(0.0)), F.greatest(-c("__d"), F.lit(0.0))
    body = F.abs(c("close") - c("open"))
    span = c("high") - c("low")
    true_range = F.greatest(span, F.abs(c("high") - lag("close")), F.abs(c("low") - lag("close")))
    return [
        {"__d": diff("close"), "__tr": true_range, "middle_band": mean("close", 20), "__sd": std("close", 20), "volume_ratio": over(c("volume").cast("double"), mean(c("volume").cast("double"), 20)), "candle_body_pct": body / (span + 0.00001), "candle_rejection": (c("high") - F.greatest("open", "close")) / (span + 0.00001)},
        {"__gain": mean(F.when(c("__d").isNotNull(), gain), 14), "__loss": mean(F.when(c("__d").isNotNull(), loss), 14), "atr": mean("__tr", 14), "upper_band": c("middle_band") + 2 * c("__sd"), "lower_band": c("middle_band") - 2 * c("__sd")},
        {"rsi_value": 100 - 100 / (1 + c("__gain") / (c("__loss") + 0.0001)), "atr_pct": over("atr", "close"), "bb_position": over(c("close") - c("lower_band"), c("upper_band") - c("lower_band")), "bb_width_pct": over(c("upper_band") - c("lower_band"), "middle_band"), "trend_strength": clip(over(c("close") - c("middle_band"), 2 * c("__sd")), -1.0, 1.0)},
    ]


def changes() -> list[Layer]:
    return [{**{f"price_change_{k}": w.change("close", k) for k in (1, 3, 5, 10)}, **{f"high_change_{k}": w.change("high", k) for k in (1, 3)}, "range_pct": over(c("high") - c("low"), "close")}]


LAGS = {"rsi_value": ("rsi_lag", range(1, 6)), "bb_position": ("bb_position_lag", range(1, 4)), "price_change_1": ("price_change_lag", range(1, 4)), "volume_ratio": ("volume_ratio_lag", range(1, 4)), "bb_width_pct": ("bb_width_lag", range(1, 3)), "trend_strength": ("trend_strength_lag", range(1, 3))}
EXTENDED_LAGS = {"rsi_value": ("rsi_lag", range(1, 21)), "bb_position": ("bb_position_lag", range(1, 21)), "atr_pct": ("atr_lag", (1, 3, 5, 10, 20)), "volume_ratio": ("volume_ratio_lag", (1, 3, 5, 10, 20)), "macd_histogram": ("macd_hist_lag", (1, 3, 5, 10)), "macd_line": ("macd_line_lag", (1, 3, 5, 10)), "stoch_k": ("stoch_k_lag", (1, 3, 5, 10)), "adx": ("adx_lag", (1, 3, 5, 10)), "price_vs_ema_21": ("price_vs_ema_21_lag", (1, 3, 5, 10)), "price_vs_ema_50": ("price_vs_ema_50_lag", (1, 3, 5, 10)), "cci": ("cci_lag", (1, 3, 5, 10)), "williams_r": ("williams_r_lag", (1, 3, 5, 10)), "tenkan_vs_kijun": ("tenkan_vs_kijun_lag", (1, 3, 5))}


def lags() -> list[Layer]:
    return [{f"{n}{k}": lag(x, k) for x, (n, ks) in LAGS.items() for k in ks}]


def extended_lags() -> list[Layer]:
    return [{f"{n}{k}": lag(x, k) for x, (n, ks) in EXTENDED_LAGS.items() for k in ks} | {f"close_pct_lag{k}": w.change("close", k) for k in (1, 2, 3, 5, 10, 15, 20)}]


def slopes() -> list[Layer]:
    return [
        {f"rsi_slope_{k}": w.slope("rsi_value", k) for k in (3, 5, 10)}
        | {f"price_slope_{k}": w.change("close", k) / k for k in (3, 5, 10)}
        | {f"bb_position_slope_{k}": w.slope("bb_position", k) for k in (3, 5)}
        | {f"bb_width_slope_{k}": w.slope("bb_width_pct", k) for k in (3, 5)}
        | {"volume_slope_3": w.slope("volume_ratio", 3), "trend_slope_3": w.slope("trend_strength", 3)}
    ]


def zscores(n: int = 20) -> list[Layer]:
    names = {"price": "close", "rsi": "rsi_value", "volume": "volume_ratio", "bb_position": "bb_position", "atr": "atr_pct", "high": "high"}
    return [{f"{k}_zscore": w.zscore(x, n) for k, x in names.items()}]


def long_zscores() -> list[Layer]:
    return [{f"{x}_zscore50": w.zscore(x, 50, 0.0001) for x in ("rsi_value", "bb_position", "close", "cci", "stoch_k")}]


def rolling() -> list[Layer]:
    return [
        {"price_rolling_std": std("close", 20), "rsi_rolling_std": std("rsi_value", 10), "rsi_rolling_max": w.high("rsi_value", 10), "rsi_rolling_min": w.low("rsi_value", 10), "bb_position_rolling_std": std("bb_position", 10), "bb_position_rolling_max": w.high("bb_position", 10), "volume_rolling_std": std("volume_ratio", 10)},
        {"rsi_range": c("rsi_rolling_max") - c("rsi_rolling_min")},
    ]


def shape() -> list[Layer]:
    return [{"price_skew_20": w.skew("close", 20), "price_kurtosis_20": w.kurt("close", 20)}]


def rolling_expanded() -> list[Layer]:
    out: Layer = {}
    for n in (10, 20, 50):
        out |= {f"close_std_{n}": over(std("close", n), "close"), f"rsi_std_{n}": std("rsi_value", n), f"rsi_max_{n}": w.high("rsi_value", n), f"rsi_min_{n}": w.low("rsi_value", n), f"rsi_range_{n}": w.high("rsi_value", n) - w.low("rsi_value", n)}
    return [out]


def percentiles() -> list[Layer]:
    return [{f"{k}_percentile": w.percent_rank(x, 50) for k, x in {"price": "close", "rsi": "rsi_value", "volume": "volume_ratio", "atr": "atr_pct", "bb_position": "bb_position", "high": "high"}.items()}]


def long_percentiles() -> list[Layer]:
    return [{f"{x}_percentile100": w.percent_rank(x, 100) for x in ("rsi_value", "bb_position", "atr_pct", "adx")}]


def flags() -> list[Layer]:
    down = c("close") < c("open")
    return [{"touched_upper_bb": flag(c("high") >= c("upper_band")), "rsi_overbought": flag(c("rsi_value") >= 70), "rsi_extreme_overbought": flag(c("rsi_value") >= 75), "rsi_very_extreme": flag(c("rsi_value") >= 80), "bearish_candle": flag(down), "strong_bearish": flag(down & (c("candle_body_pct") > 0.6)), "bb_very_high": flag(c("bb_position") > 0.95), "bb_above_upper": flag(c("close") > c("upper_band")), "high_volume": flag(c("volume_ratio") > 1.5), "extreme_volume": flag(c("volume_ratio") > 2.0), "strong_uptrend": flag(c("trend_strength") > 0.7)}]


def momentum() -> list[Layer]:
    return [
        {"rsi_momentum": diff("rsi_value", 3), "price_momentum_3": w.change("close", 3), "price_acceleration": diff("price_change_1"), "rsi_acceleration": diff("rsi_slope_3", 3), "volume_momentum": diff("volume_ratio", 3), "bb_position_momentum": diff("bb_position", 5), "trend_exhaustion": flag((c("rsi_value") > 70) & (c("rsi_slope_3") < 0) & (c("price_slope_3") > 0))}
    ]


def rates() -> list[Layer]:
    return [
        {**{f"price_roc_{k}": w.change("close", k) for k in (3, 5, 10)}, **{f"rsi_roc_{k}": diff("rsi_value", k) for k in (3, 5)}, "volume_roc_3": w.change("volume_ratio", 3), "bb_width_roc_5": w.change("bb_width_pct", 5), "price_velocity": w.change("close"), "rsi_velocity": diff("rsi_value")},
        {"momentum_deceleration": flag(lag("price_velocity") > c("price_velocity")), "rsi_acceleration_1": diff("rsi_velocity"), "price_accel_norm": over(diff("price_velocity"), "atr_pct"), "price_accel_smooth": mean(c("price_velocity"), 3)},
    ]


def momentum_expanded() -> list[Layer]:
    return [
        {**{f"price_momentum_{k}": w.change("close", k) for k in (3, 5, 10, 20)}, **{f"rsi_momentum_{k}": diff("rsi_value", k) for k in (3, 5, 10)}, "__macd_3": diff("macd_histogram", 3)},
        {"price_accel_5": diff("price_momentum_5", 5), "price_accel_10": diff("price_momentum_10", 10), "rsi_accel": diff("rsi_momentum_3", 3), "macd_accel": diff("__macd_3", 3), "momentum_consistency": mean(F.when(c("price_momentum_3").isNotNull(), flag(c("price_momentum_3") > 0).cast("double")), 10)},
    ]


def counts() -> list[Layer]:
    up = lambda x: flag(c(x) > lag(x))
    return [{"__hh": up("high"), "__hc": up("close"), "__bull": flag(c("close") > c("open")), "__bear": flag(c("close") < c("open"))}, {"consecutive_higher_highs": w.total("__hh", 5), "consecutive_higher_closes": w.total("__hc", 5), "bullish_count_5": w.total("__bull", 5), "bearish_count_5": w.total("__bear", 5)}]


def patterns() -> list[Layer]:
    span = c("high") - c("low")
    return [
        {"doji": flag(c("candle_body_pct") < 0.1), "shooting_star": flag((c("candle_rejection") > 0.6) & (c("candle_body_pct") < 0.3) & (c("close") < c("open"))), "upper_wick_ratio": safe(c("high") - F.greatest("open", "close"), span), "lower_wick_ratio": safe(F.least("open", "close") - c("low"), span), "near_double_top": flag(c("high") >= w.high("high", 20) * 0.99)},
        {"exhaustion_score": c("rsi_overbought") * 0.3 + c("bb_very_high") * 0.3 + c("shooting_star") * 0.2 + c("high_volume") * 0.2, "bullish_exhaustion": flag((c("consecutive_bullish") >= 3) & (c("rsi_value") >= 70))},
    ]


def candles() -> list[Layer]:
    o, h, lo, cl = map(c, ("open", "high", "low", "close"))
    span = h - lo + 0.00001
    return [
        {
            "candle_body": cl - o, "candle_range": h - lo, "upper_wick": h - F.greatest(o, cl), "lower_wick": F.least(o, cl) - lo, "upper_wick_pct": (h - F.greatest(o, cl)) / span, "lower_wick_pct": (F.least(o, cl) - lo) / span,
            "bullish_candle": flag(cl > o), "higher_high": flag(h > lag("high")), "lower_low": flag(lo < lag("low")), "higher_close": flag(cl > lag("close")), "lower_close": flag(cl < lag("close")),
            "bullish_engulfing": flag((cl > o) & (lag("close") < lag("open")) & (cl > lag("open")) & (o < lag("close"))),
            "bearish_engulfing": flag((cl < o) & (lag("close") > lag("open")) & (cl < lag("open")) & (o > lag("close"))), "is_doji": flag(c("candle_body_pct") < 0.1),
        },
        {"bullish_pin": flag((c("lower_wick_pct") > 0.6) & (c("candle_body_pct") < 0.3)), "bearish_pin": flag((c("upper_wick_pct") > 0.6) & (c("candle_body_pct") < 0.3))},
    ]


def session(preset: str = "v1") -> list[Layer]:
    hour, day = F.hour("ts"), F.weekday("ts")
    cycle = {"hour_sin": F.sin(hour * (2 * math.pi / 24)), "hour_cos": F.cos(hour * (2 * math.pi / 24))}
    week = 7 if preset == "v1" else 5
    cycle |= {"dow_sin": F.sin(day * (2 * math.pi / week)), "dow_cos": F.cos(day * (2 * math.pi / week))}
    days = {"is_monday": flag(day == 0), "is_friday": flag(day == 4)}
    if preset == "expanded":
        return [cycle | days | {"is_midweek": flag(day.between(1, 3)), "is_asian": flag(hour.isin(0, 4, 8)), "is_london": flag(hour.isin(8, 12)), "is_ny": flag(hour.isin(12, 16)), "is_overlap": flag(hour.isin(12, 16))}]
    if preset == "combined":
        return [cycle | days | {"is_asian_session": flag(hour.between(0, 7)), "is_london_session": flag(hour.between(8, 15)), "is_ny_session": flag(hour.between(13, 20)), "is_overlap_session": flag(hour.between(13, 16))}]
    london, ny = (hour >= 8) & (hour < 16), (hour >= 13) & (hour < 22)
    return [cycle | {"is_london": flag(london), "is_ny": flag(ny), "is_asian": flag(hour < 8), "is_london_ny_overlap": flag(london & (hour >= 13)), "is_high_activity": flag(london | ny)}]


def adx(n: int = 14) -> list[Layer]:
    up, down = diff("high"), lag("low") - c("low")
    return [
        {"__tr": F.greatest(c("high") - c("low"), F.abs(c("high") - lag("close")), F.abs(c("low") - lag("close"))), "__up": F.when((up > down) & (up > 0), up).otherwise(0.0), "__dn": F.when((down > up) & (down > 0), down).otherwise(0.0)},
        {"__atr": mean("__tr", n), "__pu": mean("__up", n), "__pd": mean("__dn", n)},
        {"plus_di": over(100 * c("__pu"), "__atr"), "minus_di": over(100 * c("__pd"), "__atr")},
        {"__dx": over(100 * F.abs(c("plus_di") - c("minus_di")), c("plus_di") + c("minus_di")), "di_diff": c("plus_di") - c("minus_di"), "di_ratio": c("plus_di") / (c("minus_di") + 0.001)},
        {"adx": mean("__dx", n)},
        {"adx_slope": diff("adx", 3), "is_trending": flag(c("adx") > 25), "is_ranging": flag(c("adx") < 20), "trend_direction_h4": sign(beyond("close", mean("close", 20)))},
    ]


def regime_of(percentile: Column) -> Column:
    """0, 1 or 2 by thirds, right-closed."""
    return F.when(percentile <= 0.33, 0.0).when(percentile <= 0.66, 1.0).when(percentile <= 1, 2.0)


def volatility() -> list[Layer]:
    return [
        {"__ret": w.change("close"), "atr_change": w.change("atr_pct", 3), "bb_squeeze": flag(c("bb_width_pct") < w.quantile("bb_width_pct", 0.2, 20)), "bb_expansion": flag(c("bb_width_pct") > w.quantile("bb_width_pct", 0.8, 20)), "volatility_spike": flag(c("atr_pct") > mean("atr_pct", 20) * 1.5), "volatility_ratio": safe("atr_pct", mean("atr_pct", 50)), "intrabar_vol": over(c("high") - c("low"), "close"), "__p": w.percent_rank("atr_pct", 50)},
        {"historical_vol": std("__ret", 20) * math.sqrt(252), "volatility_regime": regime_of(c("__p"))},
    ]


def volatility_expanded() -> list[Layer]:
    return [
        {"__ret": w.change("close"), "atr_ratio_5_20": over(mean("atr_pct", 5), mean("atr_pct", 20)), "atr_expansion": flag(c("atr_pct") > mean("atr_pct", 20)), "atr_contraction": flag(c("atr_pct") < mean("atr_pct", 20) * 0.7), "bb_squeeze_50": flag(c("bb_width_pct") < w.quantile("bb_width_pct", 0.2, 50)), "bb_expansion_50": flag(c("bb_width_pct") > w.quantile("bb_width_pct", 0.8, 50)), "daily_range_pct": over(c("high") - c("low"), "close")},
        {"range_vs_atr": over("daily_range_pct", "atr_pct"), "hist_vol_10": std("__ret", 10) * math.sqrt(1512), "hist_vol_20": std("__ret", 20) * math.sqrt(1512)},
        {"vol_ratio": over("hist_vol_10", "hist_vol_20")},
    ]


def reversion() -> list[Layer]:
    return [
        {f"ma_{n}": mean("close", n) for n in (10, 20, 50)},
        {**{f"dist_from_ma{n}": safe(c("close") - c(f"ma_{n}"), f"ma_{n}") for n in (10, 20, 50)}, "overextension": safe(c("close") - c("middle_band"), "middle_band"), "reversion_probability": clip(1 - c("bb_position"), 0.0, 1.0), "price_above_ma20": flag(c("close") > c("ma_20")), "price_above_ma50": flag(c("close") > c("ma_50")), "all_ma_bullish": flag((c("close") > c("ma_20")) & (c("ma_20") > c("ma_50"))), "ma20_slope": w.change("ma_20", 5), "ma50_slope": w.change("ma_50", 10), "is_volatile": flag(c("atr_pct") > mean("atr_pct", 50) * 1.5), "trend_direction": F.signum(beyond("close", c("ma_50")))},
        {"mean_reversion_score": c("dist_from_ma20") * c("rsi_value") / 100, "overextension_20": F.greatest(c("dist_from_ma20"), F.lit(0.0)), "extreme_overextension": flag(c("dist_from_ma20") > w.quantile("dist_from_ma20", 0.95, 100))},
    ]


def oscillators() -> list[Layer]:
    h14, l14 = w.high("high", 14), w.low("low", 14)
    return [
        {"stoch_k": over(100 * (c("close") - l14), h14 - l14), "williams_r": over(-100 * (h14 - c("close")), h14 - l14), **{f"roc_{k}": w.change("close", k) * 100 for k in (5, 10, 20, 50)}, **{f"momentum_{k}": diff("close", k) for k in (10, 20)}, "__tp": (c("high") + c("low") + c("close")) / 3},
        {"stoch_d": mean("stoch_k", 3), "stoch_k_slope": diff("stoch_k", 3), "williams_r_slope": diff("williams_r", 3), "__tpm": mean("__tp", 20), "__mad": w.mean_deviation("__tp", 20)},
        {"stoch_d_slope": diff("stoch_d", 3), "cci": over(c("__tp") - c("__tpm"), 0.015 * c("__mad"))},
        {"cci_slope": diff("cci", 3)},
    ]


def channels() -> list[Layer]:
    middle = lambda n: (w.high("high", n) + w.low("low", n)) / 2
    return [
        {"ichimoku_tenkan": middle(9), "ichimoku_kijun": middle(26), "ichimoku_senkou_b": middle(52), "donchian_high": w.high("high", 20), "donchian_low": w.low("low", 20)},
        {"ichimoku_senkou_a": (c("ichimoku_tenkan") + c("ichimoku_kijun")) / 2, "donchian_mid": (c("donchian_high") + c("donchian_low")) / 2, "donchian_width": over(c("donchian_high") - c("donchian_low"), "close"), "donchian_position": over(c("close") - c("donchian_low"), c("donchian_high") - c("donchian_low")), "donchian_breakout_up": flag(c("high") >= lag("donchian_high")), "donchian_breakout_down": flag(c("low") <= lag("donchian_low")), "price_vs_tenkan": over(c("close") - c("ichimoku_tenkan"), "ichimoku_tenkan"), "price_vs_kijun": over(c("close") - c("ichimoku_kijun"), "ichimoku_kijun"), "tenkan_vs_kijun": over(c("ichimoku_tenkan") - c("ichimoku_kijun"), "ichimoku_kijun")},
        {"ichimoku_cloud_top": F.greatest("ichimoku_senkou_a", "ichimoku_senkou_b"), "ichimoku_cloud_bottom": F.least("ichimoku_senkou_a", "ichimoku_senkou_b")},
        {"ichimoku_cloud_width": over(c("ichimoku_cloud_top") - c("ichimoku_cloud_bottom"), "close"), "price_vs_cloud": F.when(c("close") > c("ichimoku_cloud_top"), 1).when(c("close") < c("ichimoku_cloud_bottom"), -1).otherwise(0)},
    ]


def add_emas(df: DataFrame) -> DataFrame:
    """EMA 8, 21, 50 and 200 and MACD (12, 26, 9)."""
    out = w.emas(df, {f"ema_{n}": ("close", n) for n in (8, 21, 50, 200)} | {"__e12": ("close", 12), "__e26": ("close", 26)})
    out = w.emas(out.withColumn("macd_line", c("__e12") - c("__e26")), {"macd_signal": ("macd_line", 9)})
    return out.withColumn("macd_histogram", c("macd_line") - c("macd_signal"))


def ema_changes() -> list[Layer]:
    more = {f"ema_{n}_slope": w.change(f"ema_{n}", 3) for n in (8, 21, 50, 200)} | {f"price_vs_ema_{n}": over(c("close") - c(f"ema_{n}"), f"ema_{n}") for n in (8, 21, 50, 200)}
    more |= {f"ema_{a}_{b}_dist": over(c(f"ema_{a}") - c(f"ema_{b}"), f"ema_{b}") for a, b in ((8, 21), (21, 50), (50, 200))}
    more |= {"macd_hist_slope": diff("macd_histogram", 3), "macd_line_slope": diff("macd_line", 3), "macd_normalized": over("macd_line", "close") * 1000, "macd_hist_normalized": over("macd_histogram", "close") * 1000}
    return [more]


def _cross(a: Column, b: Column, before_a: Column, before_b: Column) -> tuple[Column, Column]:
    return flag((a > b) & (before_a <= before_b)), flag((a < b) & (before_a >= before_b))


def crossovers() -> list[Layer]:
    pairs = {"ema_8_21": ("ema_8", "ema_21"), "ema_21_50": ("ema_21", "ema_50"), "ema_50_200": ("ema_50", "ema_200"), "macd": ("macd_line", "macd_signal"), "stoch": ("stoch_k", "stoch_d"), "ichimoku_tk": ("ichimoku_tenkan", "ichimoku_kijun")}
    out: Layer = {}
    for name, (a, b) in pairs.items():
        out[f"{name}_cross_up"], out[f"{name}_cross_down"] = _cross(c(a), c(b), lag(a), lag(b))
    out["macd_zero_cross_up"], out["macd_zero_cross_down"] = _cross(c("macd_line"), F.lit(0.0), lag("macd_line"), F.lit(0.0))
    e = [c(f"ema_{n}") for n in (8, 21, 50, 200)]
    out["ema_bullish_alignment"] = flag((e[0] > e[1]) & (e[1] > e[2]) & (e[2] > e[3]))
    out["ema_bearish_alignment"] = flag((e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3]))
    since = lambda n: Since((c(f"{n}_cross_up") == 1) | (c(f"{n}_cross_down") == 1))
    return [out, {"bars_since_ema_8_21_cross": since("ema_8_21"), "bars_since_macd_cross": since("macd")}]


def regime_expanded() -> list[Layer]:
    p = w.percent_rank("atr_pct", 100)
    return [{"is_uptrend": flag(c("ema_21") > c("ema_50")), "is_downtrend": flag(c("ema_21") < c("ema_50")), "is_strong_trend": flag(c("adx") > 25), "is_weak_trend": flag(c("adx") < 20), "trend_regime_score": c("adx") * F.signum("di_diff"), "volatility_regime_score": p, "high_volatility": flag(p > 0.7), "low_volatility": flag(p < 0.3)}]


def reversion_expanded() -> list[Layer]:
    third = lambda x: clip(c(x), -3.0, 3.0) / 3
    return [{**{f"dist_from_ema_{n}": over(c("close") - c(f"ema_{n}"), f"ema_{n}") for n in (8, 21, 50, 200)}, "price_overextended_up": flag(c("close") > c("upper_band")), "price_overextended_down": flag(c("close") < c("lower_band")), "rsi_overextended_up": flag(c("rsi_value") > 70), "rsi_overextended_down": flag(c("rsi_value") < 30), "reversion_blend": (third("rsi_value_zscore50") + third("bb_position_zscore50")) / 2}]


def combinations() -> list[Layer]:
    rsi, macd, k, close = c("rsi_value"), c("macd_histogram"), c("stoch_k"), c("close")
    out = {
        "rsi_macd_bullish": (rsi > 50) & (macd > 0), "rsi_macd_bearish": (rsi < 50) & (macd < 0), "stoch_rsi_oversold": (k < 20) & (rsi < 30), "stoch_rsi_overbought": (k > 80) & (rsi > 70), "trend_confluence": (c("adx") > 25) & (c("ema_bullish_alignment") == 1),
        "cci_bb_extreme_up": (c("cci") > 100) & (c("bb_position") > 0.9), "cci_bb_extreme_down": (c("cci") < -100) & (c("bb_position") < 0.1), "ichimoku_ema_bullish": (c("price_vs_cloud") == 1) & (close > c("ema_50")), "ichimoku_ema_bearish": (c("price_vs_cloud") == -1) & (close < c("ema_50")),
        "macd_bearish_div": (close > lag("close", 5)) & (macd < lag("macd_histogram", 5)), "macd_bullish_div": (close < lag("close", 5)) & (macd > lag("macd_histogram", 5)),
    }
    for n in (5, 10):
        out[f"bearish_divergence_{n}"] = (close > lag("close", n)) & (rsi < lag("rsi_value", n))
        out[f"bullish_divergence_{n}"] = (close < lag("close", n)) & (rsi > lag("rsi_value", n))
    up = [rsi > 50, macd > 0, k > 50, c("di_diff") > 0, c("price_vs_cloud") == 1, close > c("ema_50")]
    down = [rsi < 50, macd < 0, k < 50, c("di_diff") < 0, c("price_vs_cloud") == -1, close < c("ema_50")]
    first = {n: flag(x) for n, x in out.items()} | {"bullish_indicator_count": sum(map(flag, up), F.lit(0)), "bearish_indicator_count": sum(map(flag, down), F.lit(0))}
    return [first, {"indicator_consensus": c("bullish_indicator_count") - c("bearish_indicator_count")}]


def add_streaks(df: DataFrame) -> DataFrame:
    return _streaks(df, consecutive_bullish=c("close") > c("open"), consecutive_bearish=c("close") < c("open"))


def _streaks(df: DataFrame, **conditions: Column) -> DataFrame:
    return (pieces.streaks if pieces.RANK in df.columns else w.streaks)(df, **conditions)


def runs() -> list[Layer]:
    return [{"__higher": flag(c("high") > lag("high")), "__lower": flag(c("low") < lag("low"))}]


def add_run_streaks(df: DataFrame) -> DataFrame:
    return _streaks(df, higher_high_run=c("__higher") == 1, lower_low_run=c("__lower") == 1)


Family = tuple[tuple[str, ...], Callable[[], list[Layer]] | None, Callable[[DataFrame], DataFrame] | None]
#: Each family: what it rests on, its layers, and a function that comes before them.
FAMILIES: dict[str, Family] = {
    "base": ((), base, None), "changes": (("base",), changes, None), "lags": (("changes",), lags, None), "slopes": (("base",), slopes, None), "zscores": (("base",), zscores, None), "rolling": (("base",), rolling, None), "shape": ((), shape, None), "rolling_expanded": (("base",), rolling_expanded, None),
    "percentiles": (("base",), percentiles, None), "flags": (("base",), flags, None), "momentum": (("changes", "slopes"), momentum, None), "rates": (("base",), rates, None), "streaks": ((), None, add_streaks), "runs": ((), runs, None), "run_streaks": (("runs",), None, add_run_streaks), "counts": ((), counts, None), "patterns": (("flags", "streaks"), patterns, None), "candles": (("base",), candles, None),
    "session": ((), session, None), "session_combined": ((), lambda: session("combined"), None), "session_expanded": ((), lambda: session("expanded"), None), "adx": ((), adx, None), "volatility": (("base",), volatility, None), "volatility_expanded": (("base",), volatility_expanded, None), "reversion": (("base",), reversion, None),
    "oscillators": ((), oscillators, None), "channels": ((), channels, None), "emas": ((), ema_changes, add_emas), "momentum_expanded": (("base", "emas"), momentum_expanded, None), "crossovers": (("emas", "oscillators", "channels"), crossovers, None), "long_zscores": (("base", "oscillators"), long_zscores, None), "long_percentiles": (("base", "adx"), long_percentiles, None),
    "regime_expanded": (("base", "emas", "adx"), regime_expanded, None), "reversion_expanded": (("emas", "long_zscores"), reversion_expanded, None), "combinations": (("base", "adx", "crossovers"), combinations, None), "extended_lags": (("base", "emas", "oscillators", "channels", "adx"), extended_lags, None),
    "exporter": (("base",), exporter, None), "early": (("base",), early, None),
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The families and all that they rest on, in order."""
    out: list[str] = []
    for n in names:
        out += [x for x in (*needed(FAMILIES[n][0]), n) if x not in out]
    return list(dict.fromkeys(out))


def _layered(df: DataFrame, layers: list[Layer]) -> DataFrame:
    for layer in layers:
        df = df.withColumns({k: v for k, v in layer.items() if k not in df.columns or k.startswith("__")})
    return df


def add(df: DataFrame, *names: str, size: int | None = None) -> DataFrame:
    """Add families of features, and those that they rest on.

    size: rows of the pieces that windows run over, for series too long for a task each. By default a key is one window, which
    shuffles less where there are many keys.
    """
    waiting: list[Layer] = []
    if size is not None:
        df = pieces.in_pieces(df, size=size).drop(pieces.PIECE)

    def made(df: DataFrame) -> DataFrame:
        own = list(waiting)
        waiting.clear()
        if not own or size is None:
            return _layered(df, own)
        return pieces.by_pieces(df, lambda part: _layered(part, own), back=min(size, REACH * len(own)), size=size)

    for n in needed(names):
        _, layers, function = FAMILIES[n]
        if function:
            df = function(made(df))
        for layer in layers() if layers else []:
            waiting.append({k: v for k, v in layer.items() if not isinstance(v, Since)})
            since = {k: v.condition for k, v in layer.items() if isinstance(v, Since)}
            if since:
                df = made(df)
                df = df.withColumns({k: w.bars_since(x) for k, x in since.items()}) if size is None else pieces.since(df, size=size, **since)
    df = made(df)
    return df.drop(*(x for x in df.columns if x.startswith("__")))


def columns_of(name: str) -> list[str]:
    """The columns that a family of layers adds."""
    layers = FAMILIES[name][1]
    return [k for layer in (layers() if layers else []) for k in layer if not k.startswith("__")]


PREFIXES = {"price": "price", "rsi": "oscillator", "bb_": "bands", "volume": "volume", "trend": "trend", "is_": "session or regime", "ema": "average", "macd": "average", "stoch": "oscillator", "ichimoku": "channel", "donchian": "channel", "cci": "oscillator", "williams": "oscillator", "atr": "volatility", "hist": "volatility", "vol": "volatility", "consecutive": "pattern", "d1_": "slow frame", "mtf_": "cross frame", "h4_": "cross frame"}


def category(name: str) -> str:
    return next((v for k, v in PREFIXES.items() if name.startswith(k)), "other")


def category_share(selected: DataFrame, feature: str = "feature") -> DataFrame:
    """(category, n, share) of a table of selected features."""
    kind = F.lit("other")
    for k, v in reversed(PREFIXES.items()):
        kind = F.when(F.col(feature).startswith(k), v).otherwise(kind)
    by = selected.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return by.join(by.agg(F.sum("n").alias("total"))).select("category", "n", (F.col("n") / F.col("total")).alias("share"))
