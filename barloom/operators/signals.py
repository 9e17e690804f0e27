"""Entry-signal hypotheses as predicates, evaluated in one pass into a long table (key, ts, signal, direction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import windows as w

c = F.col


#: What signals read of a fast row and of its slow one.
FAST = ["high", "close", "rsi_value", "bb_position", "bb_width_pct", "upper_band", "lower_band"]
SLOW = ["trend_strength", "rsi_value", "bb_position"]


def prepare(df: DataFrame) -> DataFrame:
    """What the signals read beyond base indicators, on a merged frame."""
    hour = F.hour("ts")
    out = df.withColumns({"s_ma50": w.mean("close", 50), "s_ma20": w.mean("close", 20), "s_rsi_change_5": w.diff("rsi_value", 5), "s_change_5": w.change("close", 5), "s_width_rank": w.percent_rank("bb_width_pct", 100), "s_high_6": w.high("high", 6), "s_asian": w.flag(hour <= 7), "s_london": w.flag(hour.between(8, 11))})
    squeeze = w.flag(c("s_width_rank") <= 0.2)
    return out.withColumn("s_squeeze", squeeze).withColumns({"s_was_squeezed": w.flag((w.lag("s_squeeze") == 1) | (w.lag("s_squeeze", 2) == 1)), "s_was_asian": w.flag(w.lag("s_asian") == 1), "s_recent_high": w.lag("s_high_6"), "s_dist": F.try_divide(c("close") - c("s_ma20"), c("s_ma20"))})


def single_frame() -> dict[str, tuple[Column, str]]:
    rsi, bb, close = c("rsi_value"), c("bb_position"), c("close")
    up, down = close > c("s_ma50"), close < c("s_ma50")
    middle = bb.between(0.40, 0.60)
    return {
        "bb_rsi_overbought": ((bb >= 0.85) & (rsi >= 65), "short"),
        "bb_rsi_oversold": ((bb <= 0.15) & (rsi <= 35), "long"),
        "squeeze_breakout_up": ((c("s_was_squeezed") == 1) & (close > c("upper_band")), "long"),
        "squeeze_breakout_down": ((c("s_was_squeezed") == 1) & (close < c("lower_band")), "short"),
        "rsi_bearish_divergence": ((c("s_change_5") > 0.005) & (c("s_rsi_change_5") < -5) & (rsi >= 60), "short"),
        "rsi_bullish_divergence": ((c("s_change_5") < -0.005) & (c("s_rsi_change_5") > 5) & (rsi <= 40), "long"),
        "far_above_ma": (c("s_dist") >= 0.015, "short"),
        "far_below_ma": (c("s_dist") <= -0.015, "long"),
        "london_trend": ((c("s_london") == 1) & up, "long"),
        "london_reversal": ((c("s_london") == 1) & (bb >= 0.85), "short"),
        "asian_range_breakout": ((c("s_was_asian") == 1) & (c("s_asian") == 0) & (close > c("s_recent_high")), "long"),
        "trend_continuation_long": (up & middle & (rsi >= 40), "long"),
        "trend_continuation_short": (down & middle & (rsi <= 60), "short"),
        "momentum_burst_long": ((c("s_change_5") > 0.01) & (rsi >= 60), "long"),
        "momentum_burst_short": ((c("s_change_5") < -0.01) & (rsi <= 40), "short"),
    }


def two_frames() -> dict[str, tuple[Column, str]]:
    rsi, bb, close = c("rsi_value"), c("bb_position"), c("close")
    up, down = close > c("s_ma50"), close < c("s_ma50")
    d_up, d_down = c("d1_trend_strength") > 0.3, c("d1_trend_strength") < -0.3
    bull, bear = c("d1_rsi_value") >= 55, c("d1_rsi_value") <= 45
    pullback, london = bb.between(0.35, 0.65), c("s_london") == 1
    return {
        "mtf_trend_long": (up & d_up, "long"), "mtf_trend_short": (down & d_down, "short"), "mtf_pullback_long": (d_up & pullback, "long"), "mtf_pullback_short": (d_down & pullback, "short"),
        "d1_up_rsi_dip": (d_up & (rsi <= 35), "long"), "d1_down_rsi_rally": (d_down & (rsi >= 65), "short"), "d1_bull_breakout": (bull & (close > c("upper_band")), "long"), "d1_bear_breakdown": (bear & (close < c("lower_band")), "short"),
        "london_d1_up": (london & d_up, "long"), "london_d1_down": (london & d_down, "short"), "d1_bb_high_reversal": ((c("d1_bb_position") >= 0.7) & (bb >= 0.8) & (rsi >= 60), "short"), "d1_bb_low_reversal": ((c("d1_bb_position") <= 0.3) & (bb <= 0.2) & (rsi <= 40), "long"),
        "d1_strong_up": (c("d1_rsi_value") >= 60, "long"), "d1_strong_down": (c("d1_rsi_value") <= 40, "short"), "confluence_long": (d_up & bull & up & (rsi >= 50), "long"), "confluence_short": (d_down & bear & down & (rsi <= 50), "short"),
    }


def evaluate(df: DataFrame, signals: dict[str, tuple[Column, str]]) -> DataFrame:
    """(key, ts, signal, direction) of every row and signal that holds; one pass for all of them."""
    found = F.array(*(F.when(x, F.struct(F.lit(n).alias("signal"), F.lit(d).alias("direction"))) for n, (x, d) in signals.items()))
    return df.select("key", "ts", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s")).select("key", "ts", "s.signal", "s.direction")


def overbought(bb: float = 0.8, rsi: float = 65) -> Column:
    return (c("bb_position") >= bb) & (c("rsi_value") >= rsi)


def trade_filters(medians: dict[str, float]) -> dict[str, Column]:
    """Pre-filters of trades. medians: atr_pct's median and bb_width_pct's 20th percentile, best from training rows only."""
    hour, day = F.hour("ts"), F.weekday("ts")
    one = {"avoid_mon_fri": ~day.isin(0, 4), "london_ny_only": hour.isin(8, 12, 16), "avoid_asian": ~hour.isin(0, 4), "min_atr": c("atr_pct") >= medians["atr_pct"] * 0.7, "no_squeeze": c("bb_width_pct") >= medians["bb_width_pct"], "rsi_strong": (c("rsi_value") > 55) | (c("rsi_value") < 45), "d1_strong": c("d1_trend_strength") > 0.5}
    one["basic"] = one["avoid_mon_fri"] & one["avoid_asian"]
    one["volatility"] = one["min_atr"] & one["no_squeeze"]
    one["all"] = one["basic"] & one["volatility"] & one["d1_strong"]
    return one
