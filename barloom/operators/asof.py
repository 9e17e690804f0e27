"""As-of join of a slow frame to a fast one, without look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixed(slow: DataFrame, prefix: str = "d1_") -> DataFrame:
    return slow.select("key", *(F.col(c).alias(prefix + c) for c in slow.columns if c != "key"))


def previous_day(fast: DataFrame, slow: DataFrame, prefix: str = "d1_") -> DataFrame:
    """Each fast row with the last slow row of an earlier day; rows are neither dropped nor doubled, no match gives nulls.

    Both sides are united and one running `last` carries the slow row forward: one shuffle and one sort by key and day,
    with no inequality join. Slow rows become usable a day after their own.
    """
    named = prefixed(slow, prefix)
    columns = [c for c in named.columns if c != "key"]
    usable = F.date_add(F.to_date(F.col(prefix + "ts")), 1)
    right = named.select("key", usable.alias("__day"), F.lit(0).alias("__side"), F.col(prefix + "ts").alias("__ts"), F.struct(*columns).alias("__slow"), F.lit(None).cast(fast.select(F.struct("*")).schema[0].dataType).alias("__fast"))
    left = fast.select("key", F.to_date("ts").alias("__day"), F.lit(1).alias("__side"), F.col("ts").alias("__ts"), F.lit(None).cast(right.schema["__slow"].dataType).alias("__slow"), F.struct(*fast.columns).alias("__fast"))
    running = Window.partitionBy("key").orderBy("__day", "__side", "__ts").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__last", F.last("__slow", ignorenulls=True).over(running))
    return both.filter("__side = 1").select("__fast.*", *(F.col("__last")[c].alias(c) for c in columns))


def previous_day_dense(fast: DataFrame, slow: DataFrame, prefix: str = "d1_") -> DataFrame:
    """The same where the slow frame has a row every day: an equi-join on the day before, which Spark may broadcast by size."""
    named = prefixed(slow, prefix).withColumnRenamed("key", "__key").withColumn("__day", F.date_add(F.to_date(F.col(prefix + "ts")), 1))
    return fast.join(named, (F.col("key") == F.col("__key")) & (F.to_date("ts") == F.col("__day")), "left").drop("__key", "__day")


def leaks(joined: DataFrame, prefix: str = "d1_") -> DataFrame:
    """Rows whose slow row isn't of an earlier day."""
    return joined.filter(F.to_date(F.col(prefix + "ts")) >= F.to_date("ts"))


def drop_unmatched(joined: DataFrame, prefix: str = "d1_", every: bool = False) -> DataFrame:
    """Rows with a slow row; every: with any slow column set."""
    slow = [c for c in joined.columns if c.startswith(prefix)]
    return joined.na.drop(how="all", subset=slow) if every else joined.na.drop(subset=[prefix + "ts"])


def merge_statistics(fast: DataFrame, slow: DataFrame, joined: DataFrame, prefix: str = "d1_") -> DataFrame:
    f = fast.agg(F.count(F.lit(1)).alias("fast_rows"), F.min("ts").alias("fast_first"), F.max("ts").alias("fast_last"))
    s = slow.agg(F.count(F.lit(1)).alias("slow_rows"), F.min("ts").alias("slow_first"), F.max("ts").alias("slow_last"))
    j = joined.agg(F.count(F.lit(1)).alias("merged_rows"), F.count(F.col(prefix + "ts")).alias("with_slow"), F.count_if(F.col(prefix + "ts").isNull()).alias("without_slow"))
    return f.join(s).join(j)  # one row each


def fingerprint(bars: DataFrame) -> DataFrame:
    return bars.groupBy("key").agg(F.md5(F.concat_ws("_", F.count(F.lit(1)).cast("string"), F.min_by("close", "ts").cast("decimal(18,4)").cast("string"), F.max_by("close", "ts").cast("decimal(18,4)").cast("string")).cast("binary")).alias("fingerprint"))
