"""Sinks: trade log, run ledger and reports. For tables of results and models that several runs write to see ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADE = T.StructType(
    [T.StructField("config_id", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in ("outcome",)]
    + [T.StructField(c, T.DoubleType()) for c in ("pips_result", "model_probability", "threshold_used", "rsi_value", "bb_position", "trend_strength", "atr_pct", "volume_ratio", "exhaustion_score", "macd_histogram", "adx", "d1_rsi_value", "d1_bb_position", "d1_trend_strength", "d1_trend_direction", "d1_atr_percentile", "mtf_confluence_score", "h4_vs_d1_rsi")]
    + [T.StructField(c, T.IntegerType()) for c in ("bars_held", "hour", "day_of_week", "is_asian_session", "is_london_session", "is_ny_session", "is_overlap_session", "consecutive_bullish", "d1_is_trending_up", "d1_is_trending_down", "d1_consecutive_bullish", "mtf_rsi_aligned", "mtf_bb_aligned", "mtf_trend_aligned", "d1_supports_short", "d1_opposes_short", "mtf_strong_short_setup")]
)


def as_trades(df: DataFrame) -> DataFrame:
    """Columns of the trade log: unknown ones are ignored, missing ones null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRADE))


def append_trades(df: DataFrame, path: str) -> None:
    as_trades(df).write.mode("append").partitionBy("config_id", "fold").parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append rows with the time of the run; read_ledger() and latest() take the last one of each parameter set."""
    df.withColumn("run_ts", F.current_timestamp()).write.mode("append").parquet(path)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A small result as one sorted CSV file with a header."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
