"""Checks of bar tables. Each gives rows (check, n_bad, severity) or the rows at fault; report() rolls them up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
REQUIRED = ("key", "ts", "open", "high", "low", "close", "volume")


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMBERS) and f.name not in exclude]


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = (), least: float = 0.0) -> list[str]:
    """Numeric columns of which more than `least` is set; one pass for all."""
    names = numeric_columns(df, exclude)
    if not least or not names:
        return names
    row = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in names)).first()
    return [c for c in names if (row[c] or 0) > least]


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate), one pass, unpivoted."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "null_rate")


def worst_nulls(df: DataFrame, columns: list[str], over: float = 0.05, n: int = 3) -> DataFrame:
    return null_rates(df, columns).filter(F.col("null_rate") > over).orderBy(F.desc("null_rate"), "column").limit(n)


def validate_features(df: DataFrame, columns: list[str], most_null: float = 0.1) -> DataFrame:
    """(feature, null_rate, std, issue) with issue all_null, many_null, constant or ok."""
    each = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNull().cast("double")).alias("null_rate"), F.stddev_samp(F.col(c).cast("double")).alias("std")) for c in columns]
    rows = df.agg(F.array(*each).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    issue = F.when(F.col("null_rate") == 1, "all_null").when(F.col("null_rate") > most_null, "many_null").when(F.coalesce("std", F.lit(0.0)) == 0, "constant").otherwise("ok")
    return rows.withColumn("issue", issue)


def duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy("key", "ts").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def out_of_order(df: DataFrame, ingest: str) -> DataFrame:
    """Rows whose time isn't after that of the row ingested before."""
    w = Window.partitionBy("key").orderBy(ingest)
    return df.withColumn("__before", F.lag("ts").over(w)).filter(F.col("ts") <= F.col("__before")).drop("__before")


def ohlc_faults(df: DataFrame) -> DataFrame:
    """Bars with high below low, or open or close outside of them."""
    outside = lambda c: (F.col(c) > F.col("high")) | (F.col(c) < F.col("low"))
    return df.filter((F.col("high") < F.col("low")) | outside("open") | outside("close"))


def bar_faults(df: DataFrame, hours: tuple[int, ...] = (0, 4, 8, 12, 16, 20), spike: float = 0.1, step_seconds: int = 4 * 3600) -> DataFrame:
    """(key, check, n_bad): price not positive, one-bar spike, time off the grid, gap, RSI outside 0 to 100, ATR not positive."""
    w = Window.partitionBy("key").orderBy("ts")
    seen = df.withColumn("__c", F.lag("close").over(w)).withColumn("__t", F.lag("ts").over(w))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    checks = {
        "price_not_positive": F.col("low") <= 0,
        "spike": F.abs(F.try_divide(F.col("close"), F.col("__c")) - 1) > spike,
        "off_grid": ~F.hour("ts").isin(*hours) | (F.minute("ts") != 0),
        "gap": (seconds("ts") - seconds("__t")) > step_seconds,
    }
    if "rsi_value" in df.columns:
        checks["rsi_range"] = ~F.col("rsi_value").between(0, 100)
    if "atr" in df.columns:
        checks["atr_not_positive"] = F.col("atr") <= 0
    return seen.groupBy("key").agg(*(F.count_if(c).alias(n) for n, c in checks.items())).unpivot("key", list(checks), "check", "n_bad")


def overlap(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Share of the fast frame's time span that the slow one covers, by key."""
    days = lambda c: F.to_date(c)
    f = fast.groupBy("key").agg(F.min(days("ts")).alias("f0"), F.max(days("ts")).alias("f1"), F.count(F.lit(1)).alias("fast_rows"))
    s = slow.groupBy(F.col("key").alias("k")).agg(F.min(days("ts")).alias("s0"), F.max(days("ts")).alias("s1"), F.count(F.lit(1)).alias("slow_rows"))
    both = f.join(s, F.col("key") == F.col("k"))
    days_shared = F.greatest(F.datediff(F.least("f1", "s1"), F.greatest("f0", "s0")) + 1, F.lit(0))
    return both.select("key", "fast_rows", "slow_rows", (days_shared / (F.datediff("f1", "f0") + 1)).alias("overlap"))


def coverage(joined: DataFrame, prefix: str = "d1_") -> DataFrame:
    return joined.groupBy("key").agg(F.avg(F.col(prefix + "ts").isNotNull().cast("double")).alias("coverage"), F.lit(sum(c.startswith(prefix) for c in joined.columns)).alias("n_slow_columns"))


def after_warm_up(df: DataFrame, bars: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("ts"))).filter(F.col("__n") > bars).drop("__n")


def fill(df: DataFrame, columns: list[str], how: str = "drop") -> DataFrame:
    """Missing values: drop rows, 0 or the column's median."""
    if how == "drop":
        return df.na.drop(subset=columns)
    if how == "zero":
        return df.na.fill(0, subset=columns)
    medians = df.agg(*(F.median(c).alias(c) for c in columns)).first().asDict()
    return df.na.fill({c: v for c, v in medians.items() if v is not None})


def outliers(df: DataFrame, x: str, n: int = 50, limit: float = 3.0) -> DataFrame:
    """Rows further than `limit` standard deviations from their trailing mean."""
    from barloom.functions import windows as w

    return df.withColumn("z", w.zscore(x, n)).filter(F.abs("z") > limit)


def report(checks: list[DataFrame]) -> DataFrame:
    """One row from rows (check, n_bad, severity): counts of failures and the overall verdict."""
    every = reduce(DataFrame.unionByName, checks)
    failed = lambda s: F.count_if((F.col("n_bad") > 0) & (F.col("severity") == s))
    one = every.agg(F.count(F.lit(1)).alias("n_checks"), failed("error").alias("n_errors"), failed("warning").alias("n_warnings"))
    return one.withColumn("verdict", F.when(F.col("n_errors") > 0, "fail").when(F.col("n_warnings") > 0, "warn").otherwise("pass"))
