"""Queries and SQL: bars, joins, checks and features."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.operators import asof, crossframe, features, quality
from barloom.sources.bars import bars

from . import sqltext as t
from .sqltext import L, R, STAMP, chg, diff, flag, prank, z

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_keys = ["event_type"]


def fast(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    return bars(read(spark, sf_dir, "events"), "4 hours", key=key or _keys[-1])


def slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(read(spark, sf_dir, "events"), "1 day", key=_keys[-1])


def by_user(query: Query) -> Query:
    """The same query over one series for each user, of which there are many, in place of one for each type of event."""

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        _keys.append("user_id")
        try:
            return query(spark, sf_dir)
        finally:
            _keys.pop()

    return made


def shown(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Times as text and doubles rounded, as both engines print them alike."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        x = F.col(c)
        out.append((F.date_format(x, "yyyy-MM-dd HH:mm:ss") if kinds[c].startswith("timestamp") else F.date_format(x, "yyyy-MM-dd") if kinds[c] == "date" else F.round(x, digits) + 0.0 if kinds[c] == "double" else x).alias(c))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# Bars

for _name, _every, _key in (("bars_4h", "4 hours", "event_type"), ("bars_1d", "1 day", "event_type"), ("bars_user_4h", "4 hours", "user_id")):
    QUERIES[_name] = lambda s, d, e=_every, k=_key: shown(bars(read(s, d, "events"), e, key=k))
    SQL[_name] = t.query([t.bars(_every, _key)], f"SELECT key, {STAMP} AS ts, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, volume FROM bars")

BOTH = [t.bars(), t.bars("1 day", name="days")]
ASOF = """joined AS (SELECT b.*, d.ts AS d1_ts, d.open AS d1_open, d.high AS d1_high, d.low AS d1_low, d.close AS d1_close, d.volume AS d1_volume
  FROM bars b ASOF LEFT JOIN days d ON b.key = d.key AND date_trunc('day', b.ts) >= d.ts + INTERVAL 1 DAY)"""
JOINED_COLUMNS = f"key, {STAMP} AS ts, close, strftime(d1_ts, '%Y-%m-%d %H:%M:%S') AS d1_ts, d1_close, d1_volume"


@query("asof_prev_day", t.query([*BOTH, ASOF], f"SELECT {JOINED_COLUMNS} FROM joined"))
def asof_prev_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(asof.previous_day(fast(spark, sf_dir), slow(spark, sf_dir)), ["key", "ts", "close", "d1_ts", "d1_close", "d1_volume"], 12)


@query("asof_prev_day_dense", t.query([*BOTH, "joined AS (SELECT b.*, d.ts AS d1_ts, d.close AS d1_close, d.volume AS d1_volume FROM bars b LEFT JOIN days d ON b.key = d.key AND CAST(b.ts AS DATE) = CAST(d.ts AS DATE) + 1)"], f"SELECT {JOINED_COLUMNS} FROM joined"))
def asof_prev_day_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(asof.previous_day_dense(fast(spark, sf_dir), slow(spark, sf_dir)), ["key", "ts", "close", "d1_ts", "d1_close", "d1_volume"], 12)


@query("asof_user_prev_day", t.query([t.bars(key="user_id"), t.bars("1 day", "user_id", "days"), ASOF], f"SELECT {JOINED_COLUMNS} FROM joined"))
def asof_user_prev_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return shown(asof.previous_day(bars(events, "4 hours", key="user_id"), bars(events, "1 day", key="user_id")), ["key", "ts", "close", "d1_ts", "d1_close", "d1_volume"], 12)


@query("leakage_check", t.query([*BOTH, ASOF], "SELECT count(*) FILTER (CAST(d1_ts AS DATE) >= CAST(ts AS DATE)) AS n_leaks, count(*) AS n_rows, count(d1_ts) AS n_matched FROM joined"))
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = asof.previous_day(fast(spark, sf_dir), slow(spark, sf_dir))
    return joined.agg(F.count_if(F.to_date("d1_ts") >= F.to_date("ts")).alias("n_leaks"), F.count(F.lit(1)).alias("n_rows"), F.count("d1_ts").alias("n_matched"))


@query("merge_statistics", t.query([*BOTH, ASOF], "SELECT (SELECT count(*) FROM bars) AS fast_rows, (SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM bars) AS fast_first, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM bars) AS fast_last, (SELECT count(*) FROM days) AS slow_rows, (SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM days) AS slow_first, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM days) AS slow_last, count(*) AS merged_rows, count(d1_ts) AS with_slow, count(*) - count(d1_ts) AS without_slow FROM joined"))
def merge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s = fast(spark, sf_dir), slow(spark, sf_dir)
    return shown(asof.merge_statistics(f, s, asof.previous_day(f, s)))


@query("drop_unmatched", t.query([*BOTH, ASOF], f"SELECT key, {STAMP} AS ts, strftime(d1_ts, '%Y-%m-%d %H:%M:%S') AS d1_ts FROM joined WHERE d1_ts IS NOT NULL"))
def drop_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(asof.drop_unmatched(asof.previous_day(fast(spark, sf_dir), slow(spark, sf_dir))), ["key", "ts", "d1_ts"])


@query("data_fingerprint", t.query([t.bars()], "SELECT key, md5(count(*) || '_' || CAST(arg_min(close, ts) AS DECIMAL(18, 4)) || '_' || CAST(arg_max(close, ts) AS DECIMAL(18, 4))) AS fingerprint FROM bars GROUP BY key"))
def data_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.fingerprint(fast(spark, sf_dir))


# Checks


@query("qc_ohlc", t.query([t.bars()], "SELECT key, count(*) FILTER (high < low OR open > high OR open < low OR close > high OR close < low) AS n_bad FROM bars GROUP BY key"))
def qc_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fast(spark, sf_dir)
    return df.select("key").distinct().join(quality.ohlc_faults(df).groupBy(F.col("key").alias("k")).count(), F.col("key") == F.col("k"), "left").select("key", F.coalesce("count", F.lit(0)).cast("long").alias("n_bad"))


@query("qc_duplicates", "SELECT CAST(user_id AS VARCHAR) AS key, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def qc_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    return shown(quality.duplicates(df))


@query("qc_out_of_order", "SELECT key, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS key, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE ts <= p GROUP BY key")
def qc_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", "event_id")
    return quality.out_of_order(df, "event_id").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


_null_columns = ["rsi_value", "atr", "bb_position", "volume_ratio", "middle_band"]


@query("qc_null_rates", t.query([t.bars(), *t.stack("bars", t.BASE, "b")[0]], "UNPIVOT (SELECT " + ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in _null_columns) + " FROM b2) ON COLUMNS(*) INTO NAME \"column\" VALUE null_rate"))
def qc_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.null_rates(features.add(fast(spark, sf_dir), "base"), _null_columns))


@query("qc_overlap", t.query(BOTH, "SELECT f.key, f.n AS fast_rows, s.n AS slow_rows, round(greatest(least(f1, s1) - greatest(f0, s0) + 1, 0)::DOUBLE / (f1 - f0 + 1), 6) AS overlap FROM (SELECT key, min(ts)::DATE f0, max(ts)::DATE f1, count(*) n FROM bars GROUP BY key) f JOIN (SELECT key, min(ts)::DATE s0, max(ts)::DATE s1, count(*) n FROM days GROUP BY key) s USING (key)"))
def qc_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.overlap(fast(spark, sf_dir), slow(spark, sf_dir)))


@query("qc_coverage", t.query([*BOTH, ASOF], "SELECT key, round(avg(CASE WHEN d1_ts IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage, 6 AS n_slow_columns FROM joined GROUP BY key"))
def qc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.coverage(asof.previous_day(fast(spark, sf_dir), slow(spark, sf_dir))))


_faults = {"price_not_positive": "low <= 0", "spike": "abs(close / nullif(_c, 0) - 1) > 0.1", "off_grid": "hour(ts) NOT IN (0, 4, 8, 12, 16, 20) OR minute(ts) <> 0", "gap": "ts - _t > INTERVAL 4 HOURS"}


@query("qc_bar_faults", t.query([t.bars(), t.layer("seen", "bars", {"_c": L("close"), "_t": L("ts")})], "UNPIVOT (SELECT key, " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _faults.items()) + ' FROM seen GROUP BY key) ON COLUMNS(* EXCLUDE key) INTO NAME "check" VALUE n_bad'))
def qc_bar_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bar_faults(fast(spark, sf_dir))


@query("qc_validate_features", t.query([t.bars(), *t.stack("bars", t.BASE, "b")[0]], " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate, CASE WHEN count({c}) = 0 THEN 'all_null' WHEN avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.1 THEN 'many_null' WHEN coalesce(stddev_samp({c}), 0) = 0 THEN 'constant' ELSE 'ok' END AS issue FROM b2" for c in _null_columns)))
def qc_validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.validate_features(features.add(fast(spark, sf_dir), "base"), _null_columns), ["feature", "null_rate", "issue"])


@query("qc_outliers", t.query([t.bars(), t.layer("zs", "bars", {"z": z("volume", 50)})], f"SELECT key, {STAMP} AS ts, volume, round(z, 6) AS z FROM zs WHERE abs(z) > 2"))
def qc_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quality.outliers(fast(spark, sf_dir), "volume", 50, 2.0), ["key", "ts", "volume", "z"])


@query("qc_report", t.query([t.bars(), t.layer("seen", "bars", {"_c": L("close"), "_t": L("ts")}), "a AS (SELECT " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _faults.items()) + " FROM seen)"], "SELECT 4::BIGINT AS n_checks, (price_not_positive > 0)::BIGINT + (off_grid > 0)::BIGINT AS n_errors, (spike > 0)::BIGINT + (gap > 0)::BIGINT AS n_warnings, CASE WHEN (price_not_positive > 0) OR (off_grid > 0) THEN 'fail' WHEN (spike > 0) OR (gap > 0) THEN 'warn' ELSE 'pass' END AS verdict FROM a"))
def qc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.bar_faults(fast(spark, sf_dir)).groupBy("check").agg(F.sum("n_bad").alias("n_bad"))
    return quality.report([found.withColumn("severity", F.when(F.col("check").isin("spike", "gap"), "warning").otherwise("error"))])


# Features


#: The columns that the query of each family shows, and their digits.
SHOWN: dict[str, tuple[list[str], int]] = {}


def family(name: str, layers: list[dict[str, str]], **more: object) -> None:
    columns = [k for x in layers for k in x if not k.startswith("_")]
    SHOWN[name] = columns, more.get("digits", 6)
    QUERIES[f"f_{name}"] = lambda s, d: shown(features.add(fast(s, d), name), ["key", "ts", *columns], more.get("digits", 6))
    SQL[f"f_{name}"] = t.feature_query(layers, **more)


family("base", t.BASE)
SQL["f_base"] = t.query([t.bars(), *t.stack("bars", t.BASE, "b")[0]], f"SELECT key, {STAMP} AS ts, " + ", ".join(t.rounded(k) for x in t.BASE for k in x if not k.startswith("_")) + " FROM b2")
CHANGES = [{**{f"price_change_{k}": chg("close", k) for k in (1, 3, 5, 10)}, **{f"high_change_{k}": chg("high", k) for k in (1, 3)}, "range_pct": "(high - low) / nullif(close, 0)"}]
family("changes", CHANGES)
family("lags", [{f"{n}{k}": L(x, k) for x, (n, ks) in {"rsi_value": ("rsi_lag", (1, 2, 3, 4, 5)), "bb_position": ("bb_position_lag", (1, 2, 3)), "price_change_1": ("price_change_lag", (1, 2, 3)), "volume_ratio": ("volume_ratio_lag", (1, 2, 3)), "bb_width_pct": ("bb_width_lag", (1, 2)), "trend_strength": ("trend_strength_lag", (1, 2))}.items() for k in ks}], extra=[CHANGES])
SLOPES = [{**{f"rsi_slope_{k}": f"{diff('rsi_value', k)} / {k}" for k in (3, 5, 10)}, **{f"price_slope_{k}": f"{chg('close', k)} / {k}" for k in (3, 5, 10)}, **{f"bb_position_slope_{k}": f"{diff('bb_position', k)} / {k}" for k in (3, 5)}, **{f"bb_width_slope_{k}": f"{diff('bb_width_pct', k)} / {k}" for k in (3, 5)}, "volume_slope_3": f"{diff('volume_ratio', 3)} / 3", "trend_slope_3": f"{diff('trend_strength', 3)} / 3"}]
family("slopes", SLOPES)
_z = {"price": "close", "rsi": "rsi_value", "volume": "volume_ratio", "bb_position": "bb_position", "atr": "atr_pct", "high": "high"}
family("zscores", [{f"{k}_zscore": z(x, 20) for k, x in _z.items()}])
family("rolling", [{"price_rolling_std": R("stddev_samp", "close", 20), "rsi_rolling_std": R("stddev_samp", "rsi_value", 10), "rsi_rolling_max": R("max", "rsi_value", 10), "rsi_rolling_min": R("min", "rsi_value", 10), "bb_position_rolling_std": R("stddev_samp", "bb_position", 10), "bb_position_rolling_max": R("max", "bb_position", 10), "volume_rolling_std": R("stddev_samp", "volume_ratio", 10)}, {"rsi_range": "rsi_rolling_max - rsi_rolling_min"}])
family("shape", [{"price_skew_20": R("skewness", "close", 20), "price_kurtosis_20": R("kurtosis", "close", 20)}], base=False, digits=5)
_rx: dict[str, str] = {}
for _n in (10, 20, 50):
    _rx |= {f"close_std_{_n}": f"({R('stddev_samp', 'close', _n)}) / nullif(close, 0)", f"rsi_std_{_n}": R("stddev_samp", "rsi_value", _n), f"rsi_max_{_n}": R("max", "rsi_value", _n), f"rsi_min_{_n}": R("min", "rsi_value", _n), f"rsi_range_{_n}": f"({R('max', 'rsi_value', _n)}) - ({R('min', 'rsi_value', _n)})"}
family("rolling_expanded", [_rx])
family("percentiles", [{f"{k}_percentile": prank(x, 50) for k, x in {"price": "close", "rsi": "rsi_value", "volume": "volume_ratio", "atr": "atr_pct", "bb_position": "bb_position", "high": "high"}.items()}])
FLAGS = [{"touched_upper_bb": flag("high >= upper_band"), "rsi_overbought": flag("rsi_value >= 70"), "rsi_extreme_overbought": flag("rsi_value >= 75"), "rsi_very_extreme": flag("rsi_value >= 80"), "bearish_candle": flag("close < open"), "strong_bearish": flag("close < open AND candle_body_pct > 0.6"), "bb_very_high": flag("bb_position > 0.95"), "bb_above_upper": flag("close > upper_band"), "high_volume": flag("volume_ratio > 1.5"), "extreme_volume": flag("volume_ratio > 2.0"), "strong_uptrend": flag("trend_strength > 0.7")}]
family("flags", FLAGS)
family("momentum", [{"rsi_momentum": diff("rsi_value", 3), "price_momentum_3": chg("close", 3), "price_acceleration": diff("price_change_1"), "rsi_acceleration": diff("rsi_slope_3", 3), "volume_momentum": diff("volume_ratio", 3), "bb_position_momentum": diff("bb_position", 5), "trend_exhaustion": flag("rsi_value > 70 AND rsi_slope_3 < 0 AND price_slope_3 > 0")}], extra=[CHANGES, SLOPES])
family("rates", [{**{f"price_roc_{k}": chg("close", k) for k in (3, 5, 10)}, **{f"rsi_roc_{k}": diff("rsi_value", k) for k in (3, 5)}, "volume_roc_3": chg("volume_ratio", 3), "bb_width_roc_5": chg("bb_width_pct", 5), "price_velocity": chg("close"), "rsi_velocity": diff("rsi_value")}, {"momentum_deceleration": flag(f"{L('price_velocity')} > price_velocity"), "rsi_acceleration_1": diff("rsi_velocity"), "price_accel_norm": f"{diff('price_velocity')} / nullif(atr_pct, 0)", "price_accel_smooth": R("avg", "price_velocity", 3)}])
STREAKS = [{"_u": flag("close > open"), "_v": flag("close < open")}, {"_ur": "sum(1 - _u) OVER (PARTITION BY key ORDER BY ts)", "_vr": "sum(1 - _v) OVER (PARTITION BY key ORDER BY ts)"}, {"consecutive_bullish": "sum(_u) OVER (PARTITION BY key, _ur ORDER BY ts)", "consecutive_bearish": "sum(_v) OVER (PARTITION BY key, _vr ORDER BY ts)"}]
family("streaks", STREAKS, base=False, whole=("consecutive_bullish", "consecutive_bearish"))
family("run_streaks", [{"_u": flag(f"high > {L('high')}"), "_v": flag(f"low < {L('low')}")}, {"_ur": "sum(1 - _u) OVER (PARTITION BY key ORDER BY ts)", "_vr": "sum(1 - _v) OVER (PARTITION BY key ORDER BY ts)"}, {"higher_high_run": "sum(_u) OVER (PARTITION BY key, _ur ORDER BY ts)", "lower_low_run": "sum(_v) OVER (PARTITION BY key, _vr ORDER BY ts)"}], base=False, whole=("higher_high_run", "lower_low_run"))
_counts = {"consecutive_higher_highs": "_hh", "consecutive_higher_closes": "_hc", "bullish_count_5": "_bu", "bearish_count_5": "_be"}
family("counts", [{"_hh": flag(f"high > {L('high')}"), "_hc": flag(f"close > {L('close')}"), "_bu": flag("close > open"), "_be": flag("close < open")}, {k: R("sum", v, 5) for k, v in _counts.items()}], base=False, whole=tuple(_counts))
family("patterns", [{"doji": flag("candle_body_pct < 0.1"), "shooting_star": flag("candle_rejection > 0.6 AND candle_body_pct < 0.3 AND close < open"), "upper_wick_ratio": "coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)", "lower_wick_ratio": "coalesce((least(open, close) - low) / nullif(high - low, 0), 0)", "near_double_top": flag(f"high >= ({R('max', 'high', 20)}) * 0.99")}, {"exhaustion_score": "rsi_overbought * 0.3::DOUBLE + bb_very_high * 0.3::DOUBLE + shooting_star * 0.2::DOUBLE + high_volume * 0.2::DOUBLE", "bullish_exhaustion": flag("consecutive_bullish >= 3 AND rsi_value >= 70")}], extra=[FLAGS, STREAKS])
family("candles", [{"candle_body": "close - open", "candle_range": "high - low", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low", "upper_wick_pct": "(high - greatest(open, close)) / (high - low + 0.00001)", "lower_wick_pct": "(least(open, close) - low) / (high - low + 0.00001)", "bullish_candle": flag("close > open"), "higher_high": flag(f"high > {L('high')}"), "lower_low": flag(f"low < {L('low')}"), "higher_close": flag(f"close > {L('close')}"), "lower_close": flag(f"close < {L('close')}"), "bullish_engulfing": flag(f"close > open AND {L('close')} < {L('open')} AND close > {L('open')} AND open < {L('close')}"), "bearish_engulfing": flag(f"close < open AND {L('close')} > {L('open')} AND close < {L('open')} AND open > {L('close')}"), "is_doji": flag("candle_body_pct < 0.1")}, {"bullish_pin": flag("lower_wick_pct > 0.6 AND candle_body_pct < 0.3"), "bearish_pin": flag("upper_wick_pct > 0.6 AND candle_body_pct < 0.3")}])


def _session(week: int, extra: dict[str, str], days: bool = True) -> list[dict[str, str]]:
    day = "(isodow(ts) - 1)"
    out = {"hour_sin": "sin(hour(ts) * (2 * pi() / 24))", "hour_cos": "cos(hour(ts) * (2 * pi() / 24))", "dow_sin": f"sin({day} * (2 * pi() / {week}))", "dow_cos": f"cos({day} * (2 * pi() / {week}))"}
    return [out | ({"is_monday": flag(f"{day} = 0"), "is_friday": flag(f"{day} = 4")} if days else {}) | extra]


family("session", _session(7, {"is_london": flag("hour(ts) BETWEEN 8 AND 15"), "is_ny": flag("hour(ts) BETWEEN 13 AND 21"), "is_asian": flag("hour(ts) < 8"), "is_london_ny_overlap": flag("hour(ts) BETWEEN 13 AND 15"), "is_high_activity": flag("hour(ts) BETWEEN 8 AND 21")}, False), base=False)
family("session_combined", _session(5, {"is_asian_session": flag("hour(ts) BETWEEN 0 AND 7"), "is_london_session": flag("hour(ts) BETWEEN 8 AND 15"), "is_ny_session": flag("hour(ts) BETWEEN 13 AND 20"), "is_overlap_session": flag("hour(ts) BETWEEN 13 AND 16")}), base=False)
family("session_expanded", _session(5, {"is_midweek": flag("isodow(ts) BETWEEN 2 AND 4"), "is_asian": flag("hour(ts) IN (0, 4, 8)"), "is_london": flag("hour(ts) IN (8, 12)"), "is_ny": flag("hour(ts) IN (12, 16)"), "is_overlap": flag("hour(ts) IN (12, 16)")}), base=False)
family("adx", t.ADX, base=False)
family("volatility", [{"_ret": chg("close"), "atr_change": chg("atr_pct", 3), "bb_squeeze": flag(f"bb_width_pct < ({R('quantile_cont', 'bb_width_pct', 20, ', 0.2')})"), "bb_expansion": flag(f"bb_width_pct > ({R('quantile_cont', 'bb_width_pct', 20, ', 0.8')})"), "volatility_spike": flag(f"atr_pct > ({R('avg', 'atr_pct', 20)}) * 1.5"), "volatility_ratio": f"coalesce(atr_pct / nullif({R('avg', 'atr_pct', 50)}, 0), 0)", "intrabar_vol": "(high - low) / nullif(close, 0)", "_p": prank("atr_pct", 50)}, {"historical_vol": f"({R('stddev_samp', '_ret', 20)}) * {math.sqrt(252)!r}", "volatility_regime": "CASE WHEN _p <= 0.33 THEN 0.0::DOUBLE WHEN _p <= 0.66 THEN 1.0 WHEN _p <= 1 THEN 2.0 END"}])
family("volatility_expanded", [{"_ret": chg("close"), "atr_ratio_5_20": f"({R('avg', 'atr_pct', 5)}) / nullif({R('avg', 'atr_pct', 20)}, 0)", "atr_expansion": flag(f"atr_pct > ({R('avg', 'atr_pct', 20)})"), "atr_contraction": flag(f"atr_pct < ({R('avg', 'atr_pct', 20)}) * 0.7"), "bb_squeeze_50": flag(f"bb_width_pct < ({R('quantile_cont', 'bb_width_pct', 50, ', 0.2')})"), "bb_expansion_50": flag(f"bb_width_pct > ({R('quantile_cont', 'bb_width_pct', 50, ', 0.8')})"), "daily_range_pct": "(high - low) / nullif(close, 0)"}, {"range_vs_atr": "daily_range_pct / nullif(atr_pct, 0)", "hist_vol_10": f"({R('stddev_samp', '_ret', 10)}) * {math.sqrt(1512)!r}", "hist_vol_20": f"({R('stddev_samp', '_ret', 20)}) * {math.sqrt(1512)!r}"}, {"vol_ratio": "hist_vol_10 / nullif(hist_vol_20, 0)"}])
family("reversion", [{f"ma_{n}": R("avg", "close", n) for n in (10, 20, 50)}, {**{f"dist_from_ma{n}": f"coalesce((close - ma_{n}) / nullif(ma_{n}, 0), 0)" for n in (10, 20, 50)}, "overextension": "coalesce((close - middle_band) / nullif(middle_band, 0), 0)", "reversion_probability": "CASE WHEN bb_position IS NOT NULL THEN greatest(0.0, least(1.0, 1 - bb_position)) END", "price_above_ma20": flag("close > ma_20"), "price_above_ma50": flag("close > ma_50"), "all_ma_bullish": flag("close > ma_20 AND ma_20 > ma_50"), "ma20_slope": chg("ma_20", 5), "ma50_slope": chg("ma_50", 10), "is_volatile": flag(f"atr_pct > ({R('avg', 'atr_pct', 50)}) * 1.5"), "trend_direction": "sign(close - ma_50)::DOUBLE"}, {"mean_reversion_score": "dist_from_ma20 * rsi_value / 100", "overextension_20": "greatest(dist_from_ma20, 0.0)", "extreme_overextension": flag(f"dist_from_ma20 > ({R('quantile_cont', 'dist_from_ma20', 100, ', 0.95')})")}])
OSCILLATORS = [
    {"_h14": R("max", "high", 14), "_l14": R("min", "low", 14), "_tp": "(high + low + close) / 3", **{f"roc_{k}": f"{chg('close', k)} * 100" for k in (5, 10, 20, 50)}, **{f"momentum_{k}": diff("close", k) for k in (10, 20)}},
    {"stoch_k": "100 * (close - _l14) / nullif(_h14 - _l14, 0)", "williams_r": "-100 * (_h14 - close) / nullif(_h14 - _l14, 0)", "_tpm": R("avg", "_tp", 20), "_tpl": f"list(_tp) OVER {t.W(20)}"},
    {"stoch_d": R("avg", "stoch_k", 3), "stoch_k_slope": diff("stoch_k", 3), "williams_r_slope": diff("williams_r", 3), "cci": "(_tp - _tpm) / nullif(0.015::DOUBLE * CASE WHEN len(_tpl) = 20 THEN list_avg(list_transform(_tpl, lambda v: abs(v - _tpm))) END, 0)"},
    {"stoch_d_slope": diff("stoch_d", 3), "cci_slope": diff("cci", 3)},
]
family("oscillators", OSCILLATORS, base=False)
_mid = lambda n: f"(({R('max', 'high', n)}) + ({R('min', 'low', n)})) / 2"
CHANNELS = [
    {"ichimoku_tenkan": _mid(9), "ichimoku_kijun": _mid(26), "ichimoku_senkou_b": _mid(52), "donchian_high": R("max", "high", 20), "donchian_low": R("min", "low", 20)},
    {"ichimoku_senkou_a": "(ichimoku_tenkan + ichimoku_kijun) / 2", "donchian_mid": "(donchian_high + donchian_low) / 2", "donchian_width": "(donchian_high - donchian_low) / nullif(close, 0)", "donchian_position": "(close - donchian_low) / nullif(donchian_high - donchian_low, 0)", "donchian_breakout_up": flag(f"high >= {L('donchian_high')}"), "donchian_breakout_down": flag(f"low <= {L('donchian_low')}"), "price_vs_tenkan": "(close - ichimoku_tenkan) / nullif(ichimoku_tenkan, 0)", "price_vs_kijun": "(close - ichimoku_kijun) / nullif(ichimoku_kijun, 0)", "tenkan_vs_kijun": "(ichimoku_tenkan - ichimoku_kijun) / nullif(ichimoku_kijun, 0)"},
    {"ichimoku_cloud_top": "greatest(ichimoku_senkou_a, ichimoku_senkou_b)", "ichimoku_cloud_bottom": "least(ichimoku_senkou_a, ichimoku_senkou_b)"},
    {"ichimoku_cloud_width": "(ichimoku_cloud_top - ichimoku_cloud_bottom) / nullif(close, 0)", "price_vs_cloud": "CASE WHEN close > ichimoku_cloud_top THEN 1 WHEN close < ichimoku_cloud_bottom THEN -1 ELSE 0 END"},
]
family("channels", CHANNELS, base=False, whole=("price_vs_cloud",))

# Averages with infinite memory: the SQL folds each series row by row
_spans = {"ema_8": 8, "ema_21": 21, "ema_50": 50, "ema_200": 200, "_e12": 12, "_e26": 26}
_a = {k: repr(2.0 / (n + 1)) for k, n in _spans.items()}
EMA_CTES = [
    t.bars(),
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS _i FROM bars)",
    "folded AS (SELECT key, _i, " + ", ".join(f"close AS {k}" for k in _spans) + ", 0.0::DOUBLE AS macd_line, 0.0::DOUBLE AS macd_signal FROM numbered WHERE _i = 1 UNION ALL SELECT n.key, n._i, " + ", ".join(f"f.{k} + {a} * (n.close - f.{k})" for k, a in _a.items()) + f", (f._e12 + {_a['_e12']} * (n.close - f._e12)) - (f._e26 + {_a['_e26']} * (n.close - f._e26)), f.macd_signal + 0.2 * ((f._e12 + {_a['_e12']} * (n.close - f._e12)) - (f._e26 + {_a['_e26']} * (n.close - f._e26)) - f.macd_signal) FROM folded f JOIN numbered n ON n.key = f.key AND n._i = f._i + 1)",
    "averaged AS (SELECT n.*, f.* EXCLUDE (key, _i), f.macd_line - f.macd_signal AS macd_histogram FROM numbered n JOIN folded f ON n.key = f.key AND n._i = f._i)",
]
_emas = [{**{f"ema_{n}_slope": chg(f"ema_{n}", 3) for n in (8, 21, 50, 200)}, **{f"price_vs_ema_{n}": f"(close - ema_{n}) / nullif(ema_{n}, 0)" for n in (8, 21, 50, 200)}, **{f"ema_{a}_{b}_dist": f"(ema_{a} - ema_{b}) / nullif(ema_{b}, 0)" for a, b in ((8, 21), (21, 50), (50, 200))}, "macd_hist_slope": diff("macd_histogram", 3), "macd_line_slope": diff("macd_line", 3), "macd_normalized": "macd_line / nullif(close, 0) * 1000", "macd_hist_normalized": "macd_histogram / nullif(close, 0) * 1000"}]
family("emas", _emas, base=False, ctes=EMA_CTES, source="averaged", digits=5)
_levels = [f"ema_{n}" for n in (8, 21, 50, 200)] + ["macd_line", "macd_signal", "macd_histogram"]
QUERIES["f_ema_levels"] = lambda s, d: shown(features.add(fast(s, d), "emas"), ["key", "ts", *_levels], 5)
SQL["f_ema_levels"] = t.query(EMA_CTES, f"SELECT key, {STAMP} AS ts, " + ", ".join(t.rounded(k, 5) for k in _levels) + " FROM averaged")
EMA_BASE = {"ctes": EMA_CTES, "source": "averaged"}
family("momentum_expanded", [{**{f"price_momentum_{k}": chg("close", k) for k in (3, 5, 10, 20)}, **{f"rsi_momentum_{k}": diff("rsi_value", k) for k in (3, 5, 10)}, "_m3": diff("macd_histogram", 3)}, {"price_accel_5": diff("price_momentum_5", 5), "price_accel_10": diff("price_momentum_10", 10), "rsi_accel": diff("rsi_momentum_3", 3), "macd_accel": diff("_m3", 3), "_c": "CASE WHEN price_momentum_3 IS NOT NULL THEN CASE WHEN price_momentum_3 > 0 THEN 1.0::DOUBLE ELSE 0.0 END END"}, {"momentum_consistency": R("avg", "_c", 10)}], digits=5, **EMA_BASE)


def _crosses(name: str, a: str, b: str) -> dict[str, str]:
    la, lb = L(a), L(b) if not b[0].isdigit() else b
    return {f"{name}_cross_up": flag(f"{a} > {b} AND {la} <= {lb}"), f"{name}_cross_down": flag(f"{a} < {b} AND {la} >= {lb}")}


_since = lambda n: f"_r - max(CASE WHEN {n}_cross_up = 1 OR {n}_cross_down = 1 THEN _r END) OVER (PARTITION BY key ORDER BY ts)"
CROSSES = [
    {**_crosses("ema_8_21", "ema_8", "ema_21"), **_crosses("ema_21_50", "ema_21", "ema_50"), **_crosses("ema_50_200", "ema_50", "ema_200"), **_crosses("macd", "macd_line", "macd_signal"), **_crosses("stoch", "stoch_k", "stoch_d"), **_crosses("ichimoku_tk", "ichimoku_tenkan", "ichimoku_kijun"), **_crosses("macd_zero", "macd_line", "0.0"), "ema_bullish_alignment": flag("ema_8 > ema_21 AND ema_21 > ema_50 AND ema_50 > ema_200"), "ema_bearish_alignment": flag("ema_8 < ema_21 AND ema_21 < ema_50 AND ema_50 < ema_200"), "_r": "row_number() OVER (PARTITION BY key ORDER BY ts)"},
    {"bars_since_ema_8_21_cross": _since("ema_8_21"), "bars_since_macd_cross": _since("macd")},
]
family("crossovers", CROSSES, base=False, whole=("bars_since_ema_8_21_cross", "bars_since_macd_cross"), extra=[OSCILLATORS, CHANNELS], **EMA_BASE)
LONG_Z = [{f"{x}_zscore50": z(x, 50, "0.0001") for x in ("rsi_value", "bb_position", "close", "cci", "stoch_k")}]
family("long_zscores", LONG_Z, extra=[OSCILLATORS])
family("long_percentiles", [{f"{x}_percentile100": prank(x, 100) for x in ("rsi_value", "bb_position", "atr_pct", "adx")}], extra=[t.ADX])
family("regime_expanded", [{"is_uptrend": flag("ema_21 > ema_50"), "is_downtrend": flag("ema_21 < ema_50"), "is_strong_trend": flag("adx > 25"), "is_weak_trend": flag("adx < 20"), "trend_regime_score": "adx * sign(di_diff)", "volatility_regime_score": prank("atr_pct", 100)}, {"high_volatility": flag("volatility_regime_score > 0.7"), "low_volatility": flag("volatility_regime_score < 0.3")}], extra=[t.ADX], **EMA_BASE)
_third = lambda x: f"greatest(-3.0, least(3.0, {x})) / 3"
family("reversion_expanded", [{**{f"dist_from_ema_{n}": f"(close - ema_{n}) / nullif(ema_{n}, 0)" for n in (8, 21, 50, 200)}, "price_overextended_up": flag("close > upper_band"), "price_overextended_down": flag("close < lower_band"), "rsi_overextended_up": flag("rsi_value > 70"), "rsi_overextended_down": flag("rsi_value < 30"), "reversion_blend": f"({_third('rsi_value_zscore50')} + {_third('bb_position_zscore50')}) / 2"}], extra=[OSCILLATORS, LONG_Z], digits=5, **EMA_BASE)
_up = ["rsi_value > 50", "macd_histogram > 0", "stoch_k > 50", "di_diff > 0", "price_vs_cloud = 1", "close > ema_50"]
_down = ["rsi_value < 50", "macd_histogram < 0", "stoch_k < 50", "di_diff < 0", "price_vs_cloud = -1", "close < ema_50"]
_comb = {"rsi_macd_bullish": "rsi_value > 50 AND macd_histogram > 0", "rsi_macd_bearish": "rsi_value < 50 AND macd_histogram < 0", "stoch_rsi_oversold": "stoch_k < 20 AND rsi_value < 30", "stoch_rsi_overbought": "stoch_k > 80 AND rsi_value > 70", "trend_confluence": "adx > 25 AND ema_bullish_alignment = 1", "cci_bb_extreme_up": "cci > 100 AND bb_position > 0.9", "cci_bb_extreme_down": "cci < -100 AND bb_position < 0.1", "ichimoku_ema_bullish": "price_vs_cloud = 1 AND close > ema_50", "ichimoku_ema_bearish": "price_vs_cloud = -1 AND close < ema_50", "macd_bearish_div": f"close > {L('close', 5)} AND macd_histogram < {L('macd_histogram', 5)}", "macd_bullish_div": f"close < {L('close', 5)} AND macd_histogram > {L('macd_histogram', 5)}"}
for _n in (5, 10):
    _comb |= {f"bearish_divergence_{_n}": f"close > {L('close', _n)} AND rsi_value < {L('rsi_value', _n)}", f"bullish_divergence_{_n}": f"close < {L('close', _n)} AND rsi_value > {L('rsi_value', _n)}"}
_sum = lambda xs: " + ".join(f"({flag(x)})" for x in xs)
family("combinations", [{k: flag(v) for k, v in _comb.items()} | {"bullish_indicator_count": _sum(_up), "bearish_indicator_count": _sum(_down)}, {"indicator_consensus": "bullish_indicator_count - bearish_indicator_count"}], extra=[t.ADX, OSCILLATORS, CHANNELS, CROSSES], whole=("bullish_indicator_count", "bearish_indicator_count", "indicator_consensus"), **EMA_BASE)
_xl = {f"{n}{k}": L(x, k) for x, (n, ks) in features.EXTENDED_LAGS.items() for k in ks} | {f"close_pct_lag{k}": chg("close", k) for k in (1, 2, 3, 5, 10, 15, 20)}
family("extended_lags", [_xl], extra=[t.ADX, OSCILLATORS, CHANNELS, _emas], digits=5, **EMA_BASE)


_prior = "(PARTITION BY key ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_exporter = [
    {
        "bb_touch_strength": "high / nullif(upper_band, 0)", "prev_candle_body_pct": L("candle_body_pct"), "prev_volume_ratio": L("volume_ratio"),
        "gap_from_prev_close": f"(open - {L('close')}) / nullif({L('close')}, 0)", "price_momentum": chg("close", 5),
        "resistance_distance_pct": f"(({t.R('max', 'high', 20)}) - close) / nullif(close, 0)",
        "_touched": flag("high >= upper_band"), "_i": "row_number() OVER (PARTITION BY key ORDER BY ts)",
    },
    {
        "previous_touches": f"CASE WHEN count(*) OVER {_prior} = 10 THEN sum(_touched) OVER {_prior} END",
        "time_since_last_touch": "_i - max(CASE WHEN _touched = 1 THEN _i END) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    },
]
family("exporter", _exporter, whole=("previous_touches", "time_since_last_touch"))
_early = [
    {
        "atr_14": t.R("avg", "(high - low)", 14), "bb_position_ma5": t.R("avg", "bb_position", 5), "bb_trend": diff("bb_position", 3),
        "rsi_ma5": t.R("avg", "rsi_value", 5), "rsi_trend": diff("rsi_value", 3), "rsi_momentum": diff("rsi_value", 5),
        "trend_strength_ma5": t.R("avg", "trend_strength", 5), "trend_acceleration": diff("trend_strength", 3),
        "h4_uptrend": flag("trend_strength > 0.3"), "h4_downtrend": flag("trend_strength < -0.3"),
        "is_london": flag("hour(ts) IN (8, 9, 10, 11)"), "is_ny": flag("hour(ts) IN (13, 14, 15, 16)"), "is_overlap": flag("hour(ts) IN (13, 14, 15, 16)"),
        "is_monday": flag("isodow(ts) = 1"), "is_friday": flag("isodow(ts) = 5"),
    },
    {"atr_14_pct": "atr_14 / nullif(close, 0)", "volatility_ratio": f"atr_14 / nullif(({t.R('avg', 'atr_14', 50)}), 0)"},
]
family("early", _early)


@query("f_zscores_chunked", SQL["f_zscores"])
def f_zscores_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain family, with windows over pieces of ten days and a halo of thirty instead of whole keys."""
    ready = features.add(fast(spark, sf_dir), "base")
    done = w.in_chunks(ready, lambda df: features.add(df, "zscores"), 10 * 86_400, 30 * 86_400)
    return shown(done, ["key", "ts", *features.columns_of("zscores")])


PAIRS = [
    "h4_d1_rsi_diff", "h4_d1_rsi_ratio", "d1_bb_extreme", "h4_d1_bb_diff", "d1_uptrend", "d1_downtrend", "d1_strong_trend", "h4_d1_trend_diff", "h4_d1_trend_aligned",
    "mtf_trend_conflict", "h4_d1_vol_ratio", "d1_vol_high", "mtf_rsi_both_overbought", "mtf_rsi_both_oversold", "mtf_bb_both_high", "mtf_bb_both_low",
]


@query("pair_features")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared with pandas in tests."""
    return shown(crossframe.pair_features(crossframe.merged(fast(spark, sf_dir), slow(spark, sf_dir))), ["key", "ts", *PAIRS])


@query("slow_ema_features")
def slow_ema_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared with pandas in tests."""
    out = crossframe.slow_ema_features(features.add(slow(spark, sf_dir), "base"))
    return shown(out, ["key", "ts", "close", "ema_21", "ema_50", "trend", "trend_strength", "rsi_overbought", "rsi_oversold", "rsi_momentum", "bb_extreme_high", "bb_extreme_low"])
