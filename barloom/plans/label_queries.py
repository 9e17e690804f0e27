"""Queries and SQL: slow and cross-frame features, signals and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.operators import chains, crossframe, features, labels, signals, stats, strategy

from . import feature_queries as fq
from . import sqltext as t
from .feature_queries import STREAKS, fast, shown, slow
from .sqltext import STAMP, L, R, W, chg, diff, flag, prank, z

QUERIES: dict[str, fq.Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_ma10, _ma20 = R("avg", "close", 10), R("avg", "close", 20)
SLOW = [
    {"touched_upper_bb": flag("high >= upper_band"), "rsi_overbought": flag("rsi_value >= 70"), "rsi_extreme": flag("rsi_value >= 80"), "rsi_oversold": flag("rsi_value <= 30"), "bearish_candle": flag("close < open"), "bullish_candle": flag("close > open"), "strong_bearish": flag("close < open AND candle_body_pct > 0.6"), "bb_very_high": flag("bb_position > 0.95"), "bb_high": flag("bb_position >= 0.8"), "bb_low": flag("bb_position <= 0.2"),
     "rsi_slope_3": f"{diff('rsi_value', 3)} / 3", "rsi_slope_5": f"{diff('rsi_value', 5)} / 5", **{f"price_roc_{k}": chg("close", k) for k in (3, 5, 10)}, "bb_position_slope_3": f"{diff('bb_position', 3)} / 3", "volume_slope_3": f"{diff('volume_ratio', 3)} / 3", "dist_from_ma10": f"coalesce((close - ({_ma10})) / nullif({_ma10}, 0), 0)", "dist_from_ma20": f"coalesce((close - ({_ma20})) / nullif({_ma20}, 0), 0)", "overextension": "coalesce((close - middle_band) / nullif(middle_band, 0), 0)",
     "atr_percentile": prank("atr_pct", 50), "bb_squeeze": flag(f"bb_width_pct < ({R('quantile_cont', 'bb_width_pct', 20, ', 0.2')})"), "trend_direction": f"coalesce(sign(close - ({_ma20}))::DOUBLE, 0)", "near_d1_high": flag(f"close > ({R('max', 'close', 20)}) * 0.98"), "shooting_star": flag("candle_rejection > 0.6 AND candle_body_pct < 0.3 AND close < open"), "bearish_divergence": flag(f"close > {L('close', 5)} AND rsi_value < {L('rsi_value', 5)}"), "price_zscore": z("close", 20), "rsi_zscore": z("rsi_value", 20)},
    {"volatility_regime": "CASE WHEN atr_percentile <= 0.33 THEN 0.0::DOUBLE WHEN atr_percentile <= 0.66 THEN 1.0 WHEN atr_percentile <= 1 THEN 2.0 END", "is_trending_up": flag("trend_direction > 0"), "is_trending_down": flag("trend_direction < 0")},
]


def _days() -> list[str]:
    out, last = [t.bars("1 day", name="days")], "days"
    for i, part in enumerate((t.BASE, t.ADX, STREAKS, SLOW)):
        more, last = t.stack(last, part, f"d{i}_")
        out += more
    return [*out, f"slow AS (SELECT * FROM {last})"]


_slow_names = [k for x in SLOW for k in x] + ["adx", "is_trending", "is_ranging", "consecutive_bullish", "consecutive_bearish"]
_slow_whole = {"adx": False} | {k: t.layers_flag(SLOW, k) or k.startswith(("is_", "consecutive")) for k in _slow_names if k != "adx"}


@query("d1_features", t.query(_days(), f"SELECT key, {STAMP} AS ts, " + ", ".join(f"CAST({k} AS INT) AS {k}" if _slow_whole[k] else t.rounded(k) for k in _slow_names) + " FROM slow"))
def d1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(crossframe.slow_features(slow(spark, sf_dir)), ["key", "ts", *_slow_names])


CROSS = [
    {"mtf_rsi_aligned": flag("rsi_value >= 65 AND d1_rsi_value >= 65"), "mtf_overbought_aligned": flag("rsi_value >= 70 AND d1_rsi_value >= 70"), "mtf_bb_aligned": flag("bb_position > 0.8 AND d1_bb_position > 0.8"), "mtf_trend_aligned": flag("trend_direction_h4 = d1_trend_direction"), "mtf_bearish_aligned": flag("close < open AND d1_close < d1_open"), "mtf_rsi_divergence": flag("rsi_value > 70 AND d1_rsi_value < 50"), "mtf_bb_divergence": flag("bb_position > 0.8 AND d1_bb_position < 0.5"), "mtf_trend_divergence": flag("trend_direction_h4 > 0 AND d1_trend_direction < 0"), "mtf_momentum_divergence": flag("price_slope_3 > 0 AND d1_price_roc_3 < 0"),
     "h4_position_in_d1_range": "(close - d1_low) / nullif(d1_high - d1_low, 0)", "h4_vs_d1_bb_position": "bb_position - d1_bb_position", "h4_vs_d1_rsi": "rsi_value - d1_rsi_value", "h4_vs_d1_trend": "trend_strength - d1_trend_strength", "h4_vs_d1_atr_ratio": "coalesce(atr_pct / nullif(d1_atr_pct, 0), 0)", "h4_vs_d1_range_ratio": "(high - low) / nullif(d1_high - d1_low, 0)",
     "d1_supports_short": flag("d1_rsi_value > 65 AND d1_bb_position > 0.7"), "d1_supports_long": flag("d1_rsi_value < 35 AND d1_bb_position < 0.3"), "d1_opposes_short": flag("d1_rsi_value < 40 AND d1_trend_direction > 0.5"), "d1_opposes_long": flag("d1_rsi_value > 60 AND d1_trend_direction < -0.5"), "mtf_long_signal": flag("trend_strength > 0.3 AND d1_trend_strength > 0.3"), "mtf_short_signal": flag("trend_strength < -0.3 AND d1_trend_strength < -0.3")},
    {"mtf_confluence_score": "0.25::DOUBLE * (mtf_rsi_aligned + mtf_bb_aligned + mtf_trend_aligned + mtf_bearish_aligned)", "d1_neutral": flag("d1_supports_short = 0 AND d1_opposes_short = 0")},
    {"mtf_strong_short_setup": flag("rsi_value >= 70 AND d1_rsi_value >= 70 AND mtf_confluence_score >= 0.5")},
]
_cross_names = [k for x in CROSS for k in x]


def _merged() -> list[str]:
    out, last = [*_days(), t.bars()], "bars"
    for i, part in enumerate((t.BASE, t.ADX, fq.SLOPES)):
        more, last = t.stack(last, part, f"m{i}_")
        out += more
    wanted = ["open", "high", "low", "close", "rsi_value", "bb_position", "trend_strength", "trend_direction", "price_roc_3", "atr_pct"]
    out.append(f"joined AS (SELECT b.*, d.ts AS d1_ts, " + ", ".join(f"d.{x} AS d1_{x}" for x in wanted) + f" FROM {last} b ASOF LEFT JOIN slow d ON b.key = d.key AND date_trunc('day', b.ts) >= d.ts + INTERVAL 1 DAY)")
    more, last = t.stack("joined", CROSS, "x")
    return [*out, *more, f"merged AS (SELECT * FROM {last})"]


@query("mtf_features", t.query(_merged(), f"SELECT key, {STAMP} AS ts, " + ", ".join(k if t.layers_flag(CROSS, k) else t.rounded(k) for k in _cross_names) + " FROM merged"))
def mtf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = crossframe.joined(fast(spark, sf_dir), slow(spark, sf_dir), crossframe.CROSS_FAST, crossframe.CROSS_SLOW, "adx", "slopes")
    return shown(crossframe.cross_features(both), ["key", "ts", *_cross_names])


_early_pairs = {
    "d1_rsi_ma3": R("avg", "d1_rsi_value", 3), "mtf_trend_alignment": "trend_strength * d1_trend_strength",
    "mtf_long_signal": flag("trend_strength > 0.3 AND d1_trend_strength > 0.3"), "mtf_short_signal": flag("trend_strength < -0.3 AND d1_trend_strength < -0.3"),
}


@query("early_pairs", t.query([*_merged(), t.layer("e", "merged", _early_pairs)], f"SELECT key, {STAMP} AS ts, " + ", ".join(k if k.endswith("signal") else t.rounded(k) for k in _early_pairs) + " FROM e"))
def early_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(crossframe.early_pairs(crossframe.merged(fast(spark, sf_dir), slow(spark, sf_dir))), ["key", "ts", *_early_pairs])


# Labels


def _barrier(tp: float, sl: float, hold: int, direction: str = "short", tie: str = "sl", timeout: str = "loss", source: str = "bars") -> list[str]:
    """Barrier labels by a self-join on row numbers: nothing in common with the arrays of the library."""
    s = -1 if direction == "short" else 1
    tp_hit = f"n.low <= b.close - {tp}" if s < 0 else f"n.high >= b.close + {tp}"
    sl_hit = f"n.high >= b.close + {sl}" if s < 0 else f"n.low <= b.close - {sl}"
    first = "a <= s" if tie == "tp" else "a < s"
    return [
        f"numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i, count(*) OVER (PARTITION BY key) AS n FROM {source})",
        f"met AS (SELECT b.key, b.ts, b.i, b.n, b.close, coalesce(min(n.i - b.i) FILTER ({tp_hit}), 9999) AS a, coalesce(min(n.i - b.i) FILTER ({sl_hit}), 9999) AS s, max(n.close) FILTER (n.i - b.i = {hold}) AS final FROM numbered b LEFT JOIN numbered n ON b.key = n.key AND n.i BETWEEN b.i + 1 AND b.i + {hold} GROUP BY ALL)",
        f"reasoned AS (SELECT *, CASE WHEN i + {hold} > n THEN 'insufficient_data' WHEN a < 9999 AND {first} THEN 'tp_hit' WHEN s < 9999 THEN 'sl_hit' ELSE 'timeout' END AS reason FROM met)",
        f"labelled AS (SELECT key, ts, reason, CASE WHEN reason = 'tp_hit' THEN 1 WHEN reason = 'timeout' AND {str(timeout == 'mark').lower()} AND (final - close) * {s} > 0 THEN 1 ELSE 0 END AS label, CASE reason WHEN 'tp_hit' THEN a WHEN 'sl_hit' THEN s WHEN 'timeout' THEN {hold} END::INT AS exit_bar, CASE reason WHEN 'tp_hit' THEN {tp}::DOUBLE WHEN 'sl_hit' THEN -{sl}::DOUBLE WHEN 'timeout' THEN (final - close) * {s} END AS pips FROM reasoned)",
    ]


_shown = f"SELECT key, {STAMP} AS ts, label, reason, exit_bar, round(pips, 6) + 0.0 AS pips FROM labelled"
for _name, _args in {"label_barrier_short": (100, 60, 12, "short"), "label_barrier_long": (100, 60, 12, "long"), "label_barrier_tp_first": (40, 40, 6, "short", "tp"), "label_barrier_mark": (400, 300, 6, "long", "sl", "mark")}.items():
    _p = dict(zip(("direction", "tie", "timeout"), _args[3:]))
    QUERIES[_name] = lambda s, d, a=_args, p=_p: shown(labels.barrier(fast(s, d), *a[:3], **p), ["key", "ts", "label", "reason", "exit_bar", "pips"])
    SQL[_name] = t.query([t.bars(), *_barrier(*_args)], _shown)

#: All 66 configurations: 11 take-profits, one stop, 6 horizons.
GRID = labels.grid(list(range(40, 260, 20)), [60], [6, 12, 18, 24, 36, 48])


def _grid() -> list[str]:
    """Labels of all configurations from one self-join on row numbers."""
    tps, sls, holds = (sorted({x[i] for x in GRID}) for i in range(3))
    most = max(holds)
    first = [f"coalesce(min(n.i - b.i) FILTER (n.low <= b.close - {x}), 9999) AS a{x}" for x in tps] + [f"coalesce(min(n.i - b.i) FILTER (n.high >= b.close + {x}), 9999) AS s{x}" for x in sls]
    each = []
    for tp, sl, h in GRID:
        reason = f"CASE WHEN i + {h} > n THEN 'insufficient_data' WHEN a{tp} <= {h} AND a{tp} < s{sl} THEN 'tp_hit' WHEN s{sl} <= {h} THEN 'sl_hit' ELSE 'timeout' END"
        each.append(f"SELECT key, ts, close, {tp}::DOUBLE AS tp, {sl}::DOUBLE AS sl, {h} AS hold, {reason} AS reason, a{tp} AS a, s{sl} AS s, f{h} AS final FROM met")
    return [
        t.bars(), "numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i, count(*) OVER (PARTITION BY key) AS n FROM bars)",
        f"met AS MATERIALIZED (SELECT b.key, b.ts, b.i, b.n, b.close, {', '.join(first)}, {', '.join(f'max(n.close) FILTER (n.i - b.i = {h}) AS f{h}' for h in holds)} FROM numbered b LEFT JOIN numbered n ON b.key = n.key AND n.i BETWEEN b.i + 1 AND b.i + {most} GROUP BY ALL)",
        "reasoned AS (" + " UNION ALL ".join(each) + ")",
        "labelled AS (SELECT key, ts, tp, sl, hold, reason, CASE WHEN reason = 'tp_hit' THEN 1 ELSE 0 END AS label, CASE reason WHEN 'tp_hit' THEN a WHEN 'sl_hit' THEN s WHEN 'timeout' THEN hold END::INT AS exit_bar, CASE reason WHEN 'tp_hit' THEN tp WHEN 'sl_hit' THEN -sl WHEN 'timeout' THEN (final - close) * -1 END AS pips FROM reasoned)",
    ]


@query("label_grid", t.query(_grid(), f"SELECT key, {STAMP} AS ts, tp, sl, hold, label, reason, exit_bar, round(pips, 6) + 0.0 AS pips FROM labelled"))
def label_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(labels.barrier_grid(fast(spark, sf_dir), GRID))


@query("label_grid_stats", t.query(_grid(), "SELECT tp, sl, hold, count(*) FILTER (reason <> 'insufficient_data') AS n, sum(label)::BIGINT AS wins, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS n_{r}" for r in ("tp_hit", "sl_hit", "timeout", "insufficient_data")) + ", round(sum(label) / count(*) FILTER (reason <> 'insufficient_data')::DOUBLE, 6) AS win_rate, round(greatest(sum(label), count(*) FILTER (reason <> 'insufficient_data') - sum(label))::DOUBLE / nullif(least(sum(label), count(*) FILTER (reason <> 'insufficient_data') - sum(label)), 0), 6) AS imbalance FROM labelled GROUP BY ALL"))
def label_grid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(labels.label_statistics(labels.barrier_grid(fast(spark, sf_dir), GRID)))


def FW(n: int) -> str:
    return f"(PARTITION BY key ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


_exc = {k: v for h in (6, 12) for k, v in {f"mfe_{h}": f"CASE WHEN count(close) OVER {FW(h)} = {h} THEN close - min(low) OVER {FW(h)} END", f"mae_{h}": f"CASE WHEN count(close) OVER {FW(h)} = {h} THEN max(high) OVER {FW(h)} - close END", f"final_{h}": f"close - lead(close, {h}) OVER (PARTITION BY key ORDER BY ts)"}.items()}


@query("excursions", t.query([t.bars(), t.layer("e", "bars", _exc)], f"SELECT key, {STAMP} AS ts, " + ", ".join(map(t.rounded, _exc)) + " FROM e"))
def excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(labels.excursions(fast(spark, sf_dir), [6, 12]), ["key", "ts", *_exc])


_BASED = [t.bars(), *t.stack("bars", t.BASE, "b")[0]]
_atr = {"mfe_short_atr": f"CASE WHEN count(close) OVER {FW(48)} = 48 THEN (close - min(low) OVER {FW(48)}) / nullif(atr, 0) END", "mfe_long_atr": f"CASE WHEN count(close) OVER {FW(48)} = 48 THEN (max(high) OVER {FW(48)} - close) / nullif(atr, 0) END"}


@query("mfe_atr", t.query([*_BASED, t.layer("e", "b2", _atr)], f"SELECT key, {STAMP} AS ts, " + ", ".join(map(t.rounded, _atr)) + " FROM e"))
def mfe_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(labels.excursion_in_atr(features.add(fast(spark, sf_dir), "base")), ["key", "ts", *_atr])


_targets = (30, 80, 150)
_multi = [
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i, count(*) OVER (PARTITION BY key) AS n FROM bars)",
    "met AS (SELECT b.key, b.ts, b.i, b.n, b.close, min(n.i - b.i) FILTER (n.high >= b.close + 60) AS stop, min(n.low) AS lo, max(n.high) AS hi, " + ", ".join(f"min(n.i - b.i) FILTER (n.low <= b.close - {x}) AS bars_to_{x}" for x in _targets) + " FROM numbered b LEFT JOIN numbered n ON b.key = n.key AND n.i BETWEEN b.i + 1 AND b.i + 12 GROUP BY ALL)",
]


@query("label_multi_target", t.query([t.bars(), *_multi], f"SELECT key, {STAMP} AS ts, " + ", ".join(f"bars_to_{x}::INT AS bars_to_{x}, CASE WHEN i + 12 <= n THEN CASE WHEN bars_to_{x} IS NOT NULL THEN 1 ELSE 0 END END AS reached_{x}, CASE WHEN i + 12 <= n THEN CASE WHEN bars_to_{x} IS NOT NULL AND (stop IS NULL OR bars_to_{x} < stop) THEN 1 ELSE 0 END END AS safe_{x}" for x in _targets) + ", round(CASE WHEN i + 12 <= n THEN (close - lo) / nullif(hi - close, 0) END, 6) + 0.0 AS mfe_mae_ratio FROM met"))
def label_multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{p}_{x}" for x in _targets for p in ("bars_to", "reached", "safe")]
    return shown(labels.multi_target(fast(spark, sf_dir), list(_targets), 12, 60), ["key", "ts", *names, "mfe_mae_ratio"])


_reach = (30, 50, 80)
_summary = [
    *_BASED,
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i, count(*) OVER (PARTITION BY key) AS n FROM b2)",
    "met AS (SELECT b.key, b.i, b.n, b.bb_position, min(n.i - b.i) FILTER (n.high >= b.close + 60) AS stop, b.close - min(n.low) AS mfe, max(n.high) - b.close AS mae, " + ", ".join(f"min(n.i - b.i) FILTER (n.low <= b.close - {x}) AS bars_to_{x}" for x in _reach) + " FROM numbered b LEFT JOIN numbered n ON b.key = n.key AND n.i BETWEEN b.i + 1 AND b.i + 24 GROUP BY b.key, b.i, b.n, b.bb_position, b.close)",
    "whole AS (SELECT *, mfe / nullif(mae, 0) AS ratio FROM met WHERE i + 24 <= n)",
]
_share = "round(avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0 END), 6)"


@query("label_summary", t.query(_summary, "SELECT (SELECT count(*) FROM met) AS n_rows, (SELECT count(*) FROM met WHERE bb_position >= 0.95) AS n_signals, " + ", ".join(f"{_share.format(f'bars_to_{x} IS NOT NULL')} AS prob_{x}" for x in _reach) + ", round(avg(mfe), 6) AS avg_mfe, round(avg(mae), 6) AS avg_mae, round(avg(ratio), 6) AS avg_mfe_mae_ratio, " + f"(SELECT round(avg(bars_to_30::DOUBLE), 6) FROM met) AS avg_bars_to_30, {_share.format('bars_to_30 < coalesce(stop, 9999)')} AS share_safe_30, {_share.format('bars_to_30 <= 12')} AS share_fast_30, {_share.format('mfe >= 30 AND ratio > 1.5')} AS share_clean_winner FROM whole"))
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.multi_target(features.add(fast(spark, sf_dir), "base"), list(_reach), 24, 60)
    return shown(labels.label_summary(rows, list(_reach)))


@query("nonoverlap_trades", t.query([t.bars(), *_barrier(100, 60, 12), "e AS (SELECT l.key, n.i AS pos, n.i + l.exit_bar AS exit_at FROM labelled l JOIN numbered n USING (key, ts) WHERE l.reason <> 'insufficient_data')", "taken AS (SELECT key, min(pos) AS pos FROM e GROUP BY key UNION ALL SELECT k.key, (SELECT min(x.pos) FROM e x WHERE x.key = k.key AND x.pos > e.exit_at) FROM taken k JOIN e ON e.key = k.key AND e.pos = k.pos WHERE k.pos IS NOT NULL)"], "SELECT e.key, e.pos::INT AS \"at\", e.exit_at::INT AS exit_at FROM taken k JOIN e ON e.key = k.key AND e.pos = k.pos"))
def nonoverlap_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.barrier(fast(spark, sf_dir), 100, 60, 12).withColumn("at", F.row_number().over(w.order()))
    rows = rows.filter("reason <> 'insufficient_data'").select("key", F.lit("TP100_SL60_H12").alias("config"), "at", (F.col("at") + F.col("exit_bar")).alias("exit_at"))
    return chains.non_overlapping(rows).drop("config")


# Signals

_sig = [
    {"_ma50": R("avg", "close", 50), "_ma20": R("avg", "close", 20), "_rc": diff("rsi_value", 5), "_pc": chg("close", 5), "_wr": prank("bb_width_pct", 100), "_h6": R("max", "high", 6), "_as": flag("hour(ts) <= 7"), "_lo": flag("hour(ts) BETWEEN 8 AND 11")},
    {"_sq": flag("_wr <= 0.2"), "_was": L("_as"), "_rh": L("_h6"), "_ds": "(close - _ma20) / nullif(_ma20, 0)"},
    {"_ws": flag(f"{L('_sq')} = 1 OR {L('_sq', 2)} = 1")},
]
_ONE = {
    "bb_rsi_overbought": ("bb_position >= 0.85 AND rsi_value >= 65", "short"), "bb_rsi_oversold": ("bb_position <= 0.15 AND rsi_value <= 35", "long"), "squeeze_breakout_up": ("_ws = 1 AND close > upper_band", "long"), "squeeze_breakout_down": ("_ws = 1 AND close < lower_band", "short"), "rsi_bearish_divergence": ("_pc > 0.005 AND _rc < -5 AND rsi_value >= 60", "short"), "rsi_bullish_divergence": ("_pc < -0.005 AND _rc > 5 AND rsi_value <= 40", "long"),
    "far_above_ma": ("_ds >= 0.015", "short"), "far_below_ma": ("_ds <= -0.015", "long"), "london_trend": ("_lo = 1 AND close > _ma50", "long"), "london_reversal": ("_lo = 1 AND bb_position >= 0.85", "short"), "asian_range_breakout": ("_was = 1 AND _as = 0 AND close > _rh", "long"), "trend_continuation_long": ("close > _ma50 AND bb_position BETWEEN 0.4 AND 0.6 AND rsi_value >= 40", "long"), "trend_continuation_short": ("close < _ma50 AND bb_position BETWEEN 0.4 AND 0.6 AND rsi_value <= 60", "short"), "momentum_burst_long": ("_pc > 0.01 AND rsi_value >= 60", "long"), "momentum_burst_short": ("_pc < -0.01 AND rsi_value <= 40", "short"),
}
_du, _dd, _bu, _be = "d1_trend_strength > 0.3", "d1_trend_strength < -0.3", "d1_rsi_value >= 55", "d1_rsi_value <= 45"
_TWO = {
    "mtf_trend_long": (f"close > _ma50 AND {_du}", "long"), "mtf_trend_short": (f"close < _ma50 AND {_dd}", "short"), "mtf_pullback_long": (f"{_du} AND bb_position BETWEEN 0.35 AND 0.65", "long"), "mtf_pullback_short": (f"{_dd} AND bb_position BETWEEN 0.35 AND 0.65", "short"), "d1_up_rsi_dip": (f"{_du} AND rsi_value <= 35", "long"), "d1_down_rsi_rally": (f"{_dd} AND rsi_value >= 65", "short"), "d1_bull_breakout": (f"{_bu} AND close > upper_band", "long"), "d1_bear_breakdown": (f"{_be} AND close < lower_band", "short"),
    "london_d1_up": (f"_lo = 1 AND {_du}", "long"), "london_d1_down": (f"_lo = 1 AND {_dd}", "short"), "d1_bb_high_reversal": ("d1_bb_position >= 0.7 AND bb_position >= 0.8 AND rsi_value >= 60", "short"), "d1_bb_low_reversal": ("d1_bb_position <= 0.3 AND bb_position <= 0.2 AND rsi_value <= 40", "long"), "d1_strong_up": ("d1_rsi_value >= 60", "long"), "d1_strong_down": ("d1_rsi_value <= 40", "short"), "confluence_long": (f"{_du} AND {_bu} AND close > _ma50 AND rsi_value >= 50", "long"), "confluence_short": (f"{_dd} AND {_be} AND close < _ma50 AND rsi_value <= 50", "short"),
}


def _fired(source: str, table: dict[str, tuple[str, str]]) -> str:
    return "fired AS (" + " UNION ALL ".join(f"SELECT key, ts, '{n}' AS signal, '{d}' AS direction FROM {source} WHERE {x}" for n, (x, d) in table.items()) + ")"


@query("signals_15", t.query([*_BASED, *t.stack("b2", _sig, "g")[0], _fired("g2", _ONE)], f"SELECT key, {STAMP} AS ts, signal, direction FROM fired"))
def signals_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(signals.evaluate(signals.prepare(features.add(fast(spark, sf_dir), "base")), signals.single_frame()))


@query("signals_31", t.query([*_merged(), *t.stack("merged", _sig, "g")[0], _fired("g2", _ONE | _TWO)], f"SELECT key, {STAMP} AS ts, signal, direction FROM fired"))
def signals_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = signals.prepare(crossframe.joined(fast(spark, sf_dir), slow(spark, sf_dir), signals.FAST, signals.SLOW))
    return shown(signals.evaluate(ready, signals.single_frame() | signals.two_frames()))


_measured = "measured AS (SELECT key, ts, mfe_12 AS v FROM (SELECT *, " + _exc["mfe_12"] + " AS mfe_12 FROM bars) WHERE mfe_12 IS NOT NULL)"


@query("signal_edges", t.query([*_BASED, *t.stack("b2", _sig, "g")[0], _fired("g2", _ONE), _measured, "m AS (SELECT f.signal, m.v, 1 AS inside FROM fired f JOIN measured m USING (key, ts))", "i AS (SELECT signal, count(*) AS n_in, avg(v) AS mean_in, sum(v) AS s, sum(v * v) AS q FROM m GROUP BY signal)", "a AS (SELECT count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM measured)"], "SELECT signal, n_in, n - n_in AS n_out, round(mean_in, 5) AS mean_in, round((a.s - i.s) / (n - n_in), 5) AS mean_out, round((mean_in - (a.s - i.s) / (n - n_in)) / sqrt(((i.q - i.s * i.s / n_in) + (a.q - i.q - (a.s - i.s) * (a.s - i.s) / (n - n_in))) / (n - 2) * (1.0 / n_in + 1.0 / (n - n_in))), 5) AS t, (n - 2)::DOUBLE AS df FROM i, a"))
def signal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars_ = fast(spark, sf_dir)
    fired = signals.evaluate(signals.prepare(features.add(bars_, "base")), signals.single_frame())
    measured = labels.excursions(bars_, [12]).filter("mfe_12 is not null").select("key", "ts", F.col("mfe_12").alias("v"))
    return shown(stats.signal_edges(measured, fired, "v"), digits=5)


# Draws for matched rows: both engines scramble time and key alike.
_draw_of = f"(({{at}} + 1009 * ascii(key) + 31 * length(key)) % {strategy.PRIME})"
_overbought = {"x": ("bb_position >= 0.8 AND rsi_value >= 65", "short")}
_regime = "CASE WHEN _p <= 0.25 THEN 'low' WHEN _p <= 0.5 THEN 'normal' WHEN _p <= 0.75 THEN 'elevated' WHEN _p <= 1 THEN 'high' END"


def _matched(name: str, stratum: str) -> str:
    return t.query(
        [
            *_BASED, t.layer("r0", "b2", {"_p": prank("atr_pct", 50)}), *t.stack("r0", _sig, "g")[0], _fired("g2", _overbought),
            f"strata AS (SELECT b.key, b.ts, {stratum} AS {name}, f.signal, {_draw_of.format(at='epoch(b.ts)::BIGINT').replace('key', 'b.key')} AS x FROM g2 b LEFT JOIN fired f USING (key, ts))",
            f"d1 AS (SELECT *, (x * 48271 + 7 * 69621 + 11) % {strategy.PRIME} AS y1 FROM strata)", f"d2 AS (SELECT *, (y1 * y1 + x) % {strategy.PRIME} AS y2 FROM d1)", f"d3 AS (SELECT *, (y2 * y2 + 7) % {strategy.PRIME} AS d FROM d2)",
            f"quota AS (SELECT {name}, count(*) AS q FROM strata WHERE signal IS NOT NULL GROUP BY 1)",
        ],
        f"SELECT key, {STAMP} AS ts, {name} FROM (SELECT s.*, q, row_number() OVER (PARTITION BY s.{name} ORDER BY d, key, ts) AS r FROM d3 s JOIN quota USING ({name}) WHERE signal IS NULL) WHERE r <= q",
    )


def _baseline(ready: DataFrame, stratum: str) -> DataFrame:
    draw = strategy.scrambled(F.expr(_draw_of.format(at="unix_seconds(cast(ts as timestamp))")), 7)
    return shown(stats.matched_baseline(ready.select("key", "ts", stratum), ready.filter(signals.overbought()), stratum, draw))


@query("matched_baseline", _matched("hour", "hour(b.ts)::INT"))
def matched_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(features.add(fast(spark, sf_dir), "base").withColumn("hour", F.hour("ts")), "hour")


@query("matched_baseline_regime", _matched("regime", _regime))
def matched_baseline_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata are volatility regimes: quartiles of the ATR's trailing rank."""
    ready = features.add(fast(spark, sf_dir), "base").withColumn("_p", w.percent_rank("atr_pct", 50))
    return _baseline(ready.withColumn("regime", F.expr(_regime)), "regime")


@query("random_baseline")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(labels.random_entries(fast(spark, sf_dir), 0.2), ["key", "ts", "close"])


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.barrier(features.add(fast(spark, sf_dir), "base"), 100, 60, 12).withColumn("at", F.row_number().over(w.order()))
    rows = rows.filter("reason <> 'insufficient_data'").withColumn("exit_at", F.col("at") + F.col("exit_bar"))
    return rows.withColumn("signal", signals.overbought()).select("key", "at", "exit_at", "label", "pips", "signal")


@query("random_trades_apart")
def random_trades_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a signal beside as many random ones; compared with a loop over rows in tests."""
    entries = _entries(spark, sf_dir)
    taken = chains.non_overlapping(entries.filter("signal").withColumn("config", F.lit("signal"))).drop("config")
    counts = taken.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    both = taken.withColumn("side", F.lit("signal")).unionByName(chains.random_trades(entries, counts).withColumn("side", F.lit("random")))
    return shown(both.groupBy("key", "side").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("label").alias("wins"), F.avg("pips").alias("avg_pips")))


@query("research_buckets", t.query([*_BASED, t.layer("e", "b2", _exc)], "SELECT bucket, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN mfe_12 >= {x} THEN 1.0 ELSE 0.0 END), 6) AS p_{x}" for x in (100, 200)) + ", round(avg(mfe_12), 6) AS mean_mfe, round(avg(mae_12), 6) AS mean_mae, round(avg(mfe_12) / avg(mae_12), 6) AS ratio, round(avg(mfe_12) - (SELECT avg(mfe_12) FROM e WHERE bb_position IS NOT NULL), 6) AS edge FROM (SELECT *, CASE WHEN bb_position >= 0.8 THEN 'high' WHEN bb_position <= 0.2 THEN 'low' WHEN bb_position IS NOT NULL THEN 'middle' END AS bucket FROM e) WHERE bucket IS NOT NULL AND mfe_12 IS NOT NULL GROUP BY bucket"))
def research_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labels.excursions(features.add(fast(spark, sf_dir), "base"), [12])
    x = F.col("bb_position")
    return shown(stats.research_buckets(df, F.when(x >= 0.8, "high").when(x <= 0.2, "low").when(x.isNotNull(), "middle"), [100, 200], 12))


SQL["research_buckets"] = SQL["research_buckets"].replace("FROM e WHERE bb_position IS NOT NULL)", "FROM e WHERE bb_position IS NOT NULL AND mfe_12 IS NOT NULL)")


@query("atr_stop_coverage", t.query([*_BASED, t.layer("e", "b2", _exc)], "SELECT multiple, count(*) AS n, round(avg(CASE WHEN mae_12 <= atr * multiple THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM e, (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0)) m(multiple) WHERE mae_12 IS NOT NULL AND atr IS NOT NULL GROUP BY multiple"))
def atr_stop_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stats.stop_coverage(labels.excursions(features.add(fast(spark, sf_dir), "base"), [12]), [0.5, 1.0, 1.5, 2.0], 12))


@query("regime_clusters", t.query([*_BASED, t.layer("r0", "b2", {"_p": prank("atr_pct", 50)}), t.layer("r1", "r0", {"regime": "CASE WHEN _p <= 0.25 THEN 'low' WHEN _p <= 0.5 THEN 'normal' WHEN _p <= 0.75 THEN 'elevated' WHEN _p <= 1 THEN 'high' END"}), t.layer("r2", "r1", {"_new": f"CASE WHEN regime IS NOT DISTINCT FROM {L('regime')} AND row_number() OVER (PARTITION BY key ORDER BY ts) > 1 OR (row_number() OVER (PARTITION BY key ORDER BY ts) = 1 AND regime IS NULL) THEN 0 ELSE 1 END"})], f"SELECT key, {STAMP} AS ts, regime, CAST(sum(_new) OVER (PARTITION BY key ORDER BY ts) AS BIGINT) AS cluster FROM r2"))
def regime_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.add(fast(spark, sf_dir), "base").withColumn("rank", w.percent_rank("atr_pct", 50))
    return shown(stats.regimes(df, "rank"), ["key", "ts", "regime", "cluster"])


@query("flagship", t.query([*_merged(), *_barrier(100, 60, 12, source="bars")], "SELECT m.key, CASE WHEN mtf_confluence_score >= 0.75 THEN 'high' WHEN mtf_confluence_score >= 0.5 THEN 'medium' ELSE 'low' END AS confluence, count(*) AS n, sum(label)::BIGINT AS wins, round(sum(label) / count(*)::DOUBLE, 6) AS win_rate, round(avg(pips), 6) AS avg_pips FROM merged m JOIN labelled l ON m.key = l.key AND m.ts = l.ts WHERE l.reason <> 'insufficient_data' AND d1_ts IS NOT NULL GROUP BY ALL"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to bars, previous-day join, cross-frame features, barrier labels, win rates by confluence."""
    df = labels.barrier(crossframe.merged(fast(spark, sf_dir), slow(spark, sf_dir)), 100, 60, 12).filter("reason <> 'insufficient_data' and d1_ts is not null")
    x = F.col("mtf_confluence_score")
    bucket = F.when(x >= 0.75, "high").when(x >= 0.5, "medium").otherwise("low")
    out = df.groupBy("key", bucket.alias("confluence")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("wins"), F.avg("pips").alias("avg_pips"))
    return shown(out.withColumn("win_rate", F.col("wins") / F.col("n")))
