"""Bars from raw events and from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType([T.StructField(c, t) for c, t in (("key", T.StringType()), ("ts", T.TimestampNTZType()), *((x, T.DoubleType()) for x in ("open", "high", "low", "close")), ("volume", T.LongType()))])
#: Timestamp formats that are tried in turn.
FORMATS = ("yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def bars(events: DataFrame, every: str = "4 hours", *, key: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Open, high, low, close and volume (event count) for each key and interval; one shuffle, combined on the map side."""
    at = F.struct(F.col(ts), F.col(tie))
    out = events.groupBy(F.col(key).cast("string").alias("key"), F.window(F.col(ts), every).alias("w")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return out.select("key", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def parse_time(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")


def read_csv(spark: SparkSession, path: str, *, key: str | None = None, time_col: str = "timestamp") -> DataFrame:
    """Bars from CSV files: the separator is told from the header line, names are trimmed and lower-cased."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    sep = max(",;\t", key=line.count)
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    numbers = [F.col(c).cast("double").alias(c) for c in raw.columns if c not in (time_col, "session", "key")]
    named = F.lit(key) if key is not None else F.col("key") if "key" in raw.columns else F.lit("")
    rest = [F.col(c) for c in raw.columns if c == "session"]
    return raw.select(named.alias("key"), parse_time(time_col).alias("ts"), *numbers, *rest)


def read_trades(spark: SparkSession, path: str, config_id: str | None = None) -> DataFrame:
    """The trade log; a config_id prunes partitions."""
    df = spark.read.parquet(path)
    return df if config_id is None else df.filter(F.col("config_id") == config_id)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each parameter set in the run ledger."""
    from .sinks import latest

    return latest(spark.read.parquet(path), ["tp_pips", "sl_pips", "max_holding_bars"], "run_ts")
