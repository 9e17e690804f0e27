"""Windows over bars: trailing and forward row frames for each key, with the library's rules for missing values.

A trailing aggregate is null until its frame holds n values. Comparisons with null count as 0 in flags. safe_div gives 0 for
a zero or missing denominator. Windows share one partitioning and order, so a plan of many features sorts once."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TS = "key", "ts"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def order() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TS)


def trailing(n: int) -> WindowSpec:
    return order().rowsBetween(-(n - 1), 0)


def forward(n: int) -> WindowSpec:
    return order().rowsBetween(1, n)


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(order())


def diff(x: str | Column, k: int = 1) -> Column:
    return col(x) - lag(x, k)


def change(x: str | Column, k: int = 1) -> Column:
    return F.try_divide(col(x), lag(x, k)) - 1


def slope(x: str | Column, k: int) -> Column:
    return diff(x, k) / k


def safe_div(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(col(a), col(b)), F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def roll(agg: Callable[[Column], Column], x: str | Column, n: int) -> Column:
    return F.when(F.count(col(x)).over(trailing(n)) == n, agg(col(x)).over(trailing(n)))


def mean(x: str | Column, n: int) -> Column:
    return roll(F.avg, x, n)


def std(x: str | Column, n: int) -> Column:
    return roll(F.stddev_samp, x, n)


def low(x: str | Column, n: int) -> Column:
    return roll(F.min, x, n)


def high(x: str | Column, n: int) -> Column:
    return roll(F.max, x, n)


def total(x: str | Column, n: int) -> Column:
    return roll(F.sum, x, n)


def zscore(x: str | Column, n: int, floor: float = 0.0) -> Column:
    return safe_div(col(x) - mean(x, n), std(x, n) + floor)


def quantile(x: str | Column, q: float, n: int) -> Column:
    return roll(lambda c: F.percentile(c, F.lit(q)), x, n)


def percent_rank(x: str | Column, n: int) -> Column:
    """Share of the trailing n values below the current one, ties counted with their average rank."""
    held = F.collect_list(col(x)).over(trailing(n))
    here = F.element_at(held, -1)
    less = F.size(F.filter(held, lambda v: v < here))
    same = F.size(F.filter(held, lambda v: v == here))
    return F.when(F.count(col(x)).over(trailing(n)) == n, (less + (same + 1) / 2) / n)


def skew(x: str | Column, n: int) -> Column:
    """Bias-corrected skewness."""
    return roll(F.skewness, x, n) * (math.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: str | Column, n: int) -> Column:
    """Bias-corrected excess kurtosis."""
    return (roll(F.kurtosis, x, n) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def mean_deviation(x: str | Column, n: int) -> Column:
    held = F.collect_list(col(x)).over(trailing(n))
    middle = F.avg(col(x)).over(trailing(n))
    total_ = F.aggregate(F.transform(held, lambda v: F.abs(v - middle)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.count(col(x)).over(trailing(n)) == n, total_ / n)


def streaks(df: DataFrame, **conditions: Column) -> DataFrame:
    """For each name=condition the length of the run of true that ends at the row, else 0."""
    out = df
    for name, c in conditions.items():
        out = out.withColumn(f"__{name}", flag(c))
        out = out.withColumn(f"__{name}_run", F.sum(1 - F.col(f"__{name}")).over(order()))
    for name in conditions:
        run = Window.partitionBy(KEY, f"__{name}_run").orderBy(TS)
        out = out.withColumn(name, F.sum(f"__{name}").over(run).cast("int"))
    return out.drop(*(f"__{n}{e}" for n in conditions for e in ("", "_run")))


def bars_since(condition: Column) -> Column:
    """Rows since the condition last held; null before it first does."""
    at = F.row_number().over(order())
    last = F.last(F.when(condition, at), ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))
    return at - last


def _passed_on(name: str, keep: float) -> Callable[[Column, Column], Column]:
    return lambda a, s: a * F.pow(F.lit(keep), s["m"]) + s[f"e_{name}"]


def emas(df: DataFrame, spans: dict[str, tuple[str, int]], chunk: int = 128) -> DataFrame:
    """Add exponential moving averages, name -> (column, span), each starting at its key's first row.

    A series is cut into chunks of rows, by __rank where pieces.in_pieces has numbered them. In a chunk the recurrence is a weighted running sum; only each chunk's last value
    is passed on, over as many chunks as it takes to weigh less than a double's precision.
    """
    number = F.col("__rank") if "__rank" in df.columns else F.row_number().over(order()) - 1
    out = df.withColumn("__i", number).withColumn("__c", F.floor(F.col("__i") / chunk))
    out = out.withColumn("__j", F.col("__i") % chunk)
    inner = Window.partitionBy(KEY, "__c").orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    for name, (x, span) in spans.items():
        keep = 1 - 2.0 / (span + 1)
        weight = F.when(F.col("__i") == 0, F.lit(1.0)).otherwise(F.lit(1 - keep))
        grown = F.sum(F.col(x) * weight * F.pow(F.lit(keep), -F.col("__j"))).over(inner)
        out = out.withColumn(f"__l_{name}", grown * F.pow(F.lit(keep), F.col("__j")))
    last = [F.max_by(f"__l_{n}", "__j").alias(f"e_{n}") for n in spans]
    ends = out.groupBy(KEY, "__c").agg((F.max("__j") + 1).alias("m"), *last)
    longest = max((span for _, span in spans.values()), default=1)
    felt = 1 if longest <= 1 else math.ceil(-42 / (chunk * math.log(1 - 2.0 / (longest + 1)))) + 1
    before = Window.partitionBy(KEY).orderBy("__c").rowsBetween(-felt, -1)
    held = ends.withColumn("__held", F.collect_list(F.struct("m", *(f"e_{n}" for n in spans))).over(before))
    for name, (_, span) in spans.items():
        keep = 1 - 2.0 / (span + 1)
        held = held.withColumn(f"__b_{name}", F.aggregate("__held", F.lit(0.0), _passed_on(name, keep)))
    held = held.select(F.col(KEY).alias("__ek"), F.col("__c").alias("__ec"), *(f"__b_{n}" for n in spans))
    out = out.join(held, F.col(KEY).eqNullSafe(F.col("__ek")) & (F.col("__c") == F.col("__ec")))
    for name, (_, span) in spans.items():
        out = out.withColumn(name, F.col(f"__l_{name}") + F.col(f"__b_{name}") * F.pow(F.lit(1 - 2.0 / (span + 1)), F.col("__j") + 1))
    return out.select(*df.columns, *spans)


def in_chunks(df: DataFrame, apply: Callable[[DataFrame], DataFrame], chunk_seconds: int, halo_seconds: int) -> DataFrame:
    """apply() with trailing windows over pieces of time instead of whole keys, for few and long series.

    Each row is in its own piece and, as a halo that is dropped afterwards, in the next one if that begins within
    halo_seconds. Right if no row looks back further than the halo.
    """
    seconds = F.unix_timestamp(F.col(TS).cast("timestamp"))
    piece = F.floor(seconds / chunk_seconds)
    reach = F.floor((seconds + halo_seconds) / chunk_seconds)
    spread = df.withColumn("own_piece", piece).withColumn("piece_", F.explode(F.sequence(piece, reach)))
    spread = spread.withColumn("whole_key", F.col(KEY)).withColumn(KEY, F.struct(F.col("whole_key").alias("k"), F.col("piece_").alias("p")))
    done = apply(spread).filter("own_piece = piece_")
    return done.withColumn(KEY, F.col("whole_key")).drop("own_piece", "piece_", "whole_key")


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
