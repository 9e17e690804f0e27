"""Profit and classification metrics of trades and predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import pieces

c = F.col


def win() -> Column:
    return F.col("outcome") == "WIN"


def loss() -> Column:
    return F.col("outcome") == "LOSS"


def min_win_rate(tp: Column | float, sl: Column | float) -> Column:
    lift = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.try_divide(lift(sl), lift(tp) + lift(sl))


def expected_value(precision: Column, tp: Column | float, sl: Column | float) -> Column:
    return precision * tp - (1 - precision) * sl


def drawdown(trades: DataFrame, by: list[str], order: list[str], pips: str = "pips_result", bucket: Column | None = None) -> DataFrame:
    """(by, max_drawdown) of the running sum of pips from 0.

    Sums run inside buckets and are carried over by bucket totals, so that one long history is spread over tasks. bucket: a
    value that follows the order (a month, say); by default pieces of rows.
    """
    rows = pieces.in_pieces(trades, by, order).withColumn("__b", c(pieces.PIECE)) if bucket is None else trades.withColumn("__b", bucket)
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.sum(pips).over(inner))
    rows = rows.withColumn("__peak", F.max("__s").over(inner)).withColumn("__fall", F.max("__s").over(inner) - c("__s"))
    total = F.sum(pips)
    parts = rows.groupBy(*by, "__b").agg(total.alias("__t"), F.max("__peak").alias("__p"), F.max("__fall").alias("__f"), F.min("__s").alias("__m"))
    over = Window.partitionBy(*by).orderBy("__b")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__c", F.coalesce(F.sum("__t").over(before), F.lit(0.0)))
    parts = parts.withColumn("__top", F.coalesce(F.max(c("__c") + c("__p")).over(before), F.lit(float("-inf"))))
    fall = F.greatest(c("__f"), c("__top") - (c("__c") + c("__m")))
    return parts.groupBy(*by).agg(F.max(fall).alias("max_drawdown"))


def profit(trades: DataFrame, by: list[str], order: list[str], pips: str = "pips_result", bucket: Column | None = None, year: int = 252) -> DataFrame:
    """Counts, win rate, total and average pips, Sharpe, profit factor, expectancy, average win and loss, drawdown."""
    up, down = F.when(c(pips) > 0, c(pips)), F.when(c(pips) < 0, c(pips))
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins"), F.count_if(loss()).alias("losses"), F.sum(pips).alias("total_pips"), F.avg(pips).alias("avg_pips"), F.stddev_pop(pips).alias("__sd"), F.sum(up).alias("__up"), F.sum(down).alias("__down"), F.avg(up).alias("avg_win"), F.avg(-down).alias("avg_loss")
    )
    rate = c("wins") / c("n_trades")
    out = out.withColumns({"win_rate": rate, "sharpe": F.coalesce(F.try_divide(c("avg_pips"), c("__sd")) * math.sqrt(year), F.lit(0.0)), "profit_factor": F.coalesce(c("__up"), F.lit(0.0)) / F.coalesce(-c("__down"), F.lit(1.0)), "expectancy": rate * F.coalesce("avg_win", F.lit(0.0)) - (1 - rate) * F.coalesce("avg_loss", F.lit(0.0))})
    falls = drawdown(trades, by, order, pips, bucket)
    same = [c(b).eqNullSafe(c(f"__{b}")) for b in by]
    falls = falls.select(*(c(b).alias(f"__{b}") for b in by), "max_drawdown")
    return out.join(falls, same).drop("__sd", "__up", "__down", *(f"__{b}" for b in by))


def threshold_sweep(trades: DataFrame, thresholds: list[float], order: list[str], by: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """profit() of the trades at or above each threshold: rows are spread over the thresholds they pass."""
    passed = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("model_probability"))
    return profit(trades.withColumn("threshold", F.explode(passed)), [*(by or []), "threshold"], order, bucket=bucket)


def best_threshold(sweep: DataFrame, metric: str, least: int = 100) -> DataFrame:
    return sweep.filter(c("n_trades") >= least).agg(F.max_by("threshold", F.struct(F.round(metric, 9), -c("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def fold_thresholds(predictions: DataFrame, thresholds: list[float], fold: str = "fold", least: int = 5) -> DataFrame:
    """A row for each fold and threshold: the trades at or above it against all of the fold's; none counted where fewer than
    `least` are left, improved where their mean is above the fold's."""
    passed = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("model_probability"))
    rows = predictions.select(c(fold).alias("__f"), F.explode(passed).alias("__t"), win().cast("int").alias("w"), c("pips_result").alias("p"))
    at = rows.groupBy("__f", "__t").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum("p").alias("p")).filter(c("n") >= least)
    base = predictions.groupBy(fold).agg(F.avg("pips_result").alias("base_avg_pips")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    out = base.join(at, c(fold).eqNullSafe(c("__f")) & (c("threshold") == c("__t")), "left")
    return out.select(
        fold, "threshold", F.coalesce("n", F.lit(0)).alias("n_trades"), F.coalesce("w", F.lit(0)).alias("wins"), F.coalesce("p", F.lit(0.0)).alias("total_pips"),
        F.coalesce(c("w") / c("n"), F.lit(0.0)).alias("win_rate"), F.coalesce(c("p") / c("n"), F.lit(0.0)).alias("avg_pips"), F.coalesce(c("p") / c("n") > c("base_avg_pips"), F.lit(False)).alias("improved"),
    )


def improved_folds(rows: DataFrame) -> DataFrame:
    """fold_thresholds() by threshold: folds in all, folds that improved, and the trades of all folds."""
    out = rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_folds"), F.count_if(c("improved")).alias("n_improved"), F.sum("n_trades").alias("n_trades"), F.sum("wins").alias("wins"), F.sum("total_pips").alias("total_pips"))
    return out.withColumn("win_rate", F.coalesce(F.try_divide("wins", "n_trades"), F.lit(0.0))).withColumn("avg_pips", F.coalesce(F.try_divide("total_pips", "n_trades"), F.lit(0.0)))


def ev_threshold(predictions: DataFrame, tp: float, sl: float, thresholds: list[float], by: list[str], least: int = 20) -> DataFrame:
    """For each group the threshold with the best expected value, the lowest of equal ones; needs `least` trades."""
    passed = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("model_probability"))
    at = predictions.withColumn("threshold", F.explode(passed)).groupBy(*by, "threshold").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins")).filter(c("n_trades") >= least)
    at = at.withColumn("precision", c("wins") / c("n_trades")).withColumn("ev", F.round(expected_value(c("precision"), tp, sl), 9))
    first = Window.partitionBy(*by).orderBy(F.desc("ev"), "threshold")
    return at.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")


def classification(predictions: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, ROC AUC and average precision of outcome and model_probability.

    Where all outcomes of a group are alike, the areas that need the other kind are null. Each distinct score is one row; running counts
    over these, from the highest score down and by pieces of them, give both areas. Scores lie between 0 and 1, and rows are numbered
    in buckets of 1 / 4096.
    """
    hit = c("model_probability") >= threshold
    cells = predictions.groupBy(*by).agg(F.count_if(hit & win()).alias("tp"), F.count_if(hit & ~win()).alias("fp"), F.count_if(~hit & win()).alias("fn"), F.count_if(~hit & ~win()).alias("tn"))
    scores = predictions.groupBy(*by, (-c("model_probability")).alias("__down")).agg(F.count_if(win()).alias("p"), F.count_if(~win()).alias("n"))
    own = pieces.in_pieces(scores, by, ["__down"], bucket=F.floor(c("__down") * 4096))
    s = pieces.scan(own, by, cp=pieces.total("p"), cn=pieces.total("n"))
    areas = s.groupBy(*(c(b).alias(f"__{b}") for b in by)).agg(
        F.try_divide(F.sum((c("cp") - c("p") / 2) * c("n")), (F.sum("p") * F.sum("n")).cast("double")).alias("roc_auc"), F.try_divide(F.sum(c("p") * (c("cp") / (c("cp") + c("cn")))), F.sum("p")).alias("average_precision")
    )
    out = cells.join(areas, [c(b).eqNullSafe(c(f"__{b}")) for b in by]).drop(*(f"__{b}" for b in by))
    precision, recall = F.coalesce(F.try_divide(c("tp"), c("tp") + c("fp")), F.lit(0.0)), F.coalesce(F.try_divide(c("tp"), c("tp") + c("fn")), F.lit(0.0))
    return out.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.coalesce(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")), F.lit(0.0)))


def fold_aggregate(folds: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population deviation and coefficient of variation of each metric over folds."""
    out = folds.groupBy(*by).agg(*(F.avg(m).alias(f"{m}_mean") for m in metrics), *(F.stddev_pop(m).alias(f"{m}_std") for m in metrics), F.count(F.lit(1)).alias("n_folds"))
    return out.withColumns({f"{m}_cv": F.try_divide(c(f"{m}_std"), F.abs(f"{m}_mean")) for m in metrics})


def consensus_threshold(folds: DataFrame, by: list[str]) -> DataFrame:
    """Median, mean, and the mode where most folds agree on it."""
    count = folds.groupBy(*by, "threshold").agg(F.count(F.lit(1)).alias("n"))
    mode = count.groupBy(*by).agg(F.max_by("threshold", F.struct("n", -c("threshold"))).alias("mode"), F.max("n").alias("__m"), F.sum("n").alias("__n"))
    mode = mode.select(*(c(b).alias(f"__{b}") for b in by), F.when(c("__m") * 2 > c("__n"), c("mode")).alias("majority"))
    out = folds.groupBy(*by).agg(F.median("threshold").alias("median"), F.avg("threshold").alias("mean"))
    return out.join(mode, [c(b).eqNullSafe(c(f"__{b}")) for b in by]).drop(*(f"__{b}" for b in by))


def acceptance(df: DataFrame, edge: float = 0.05, trades: int = 30, ev: float = 0.0, cv: float = 0.30) -> DataFrame:
    """Add passed and reasons to rows with tp, sl, precision_mean, precision_std, ev_mean, total_trades and n_folds."""
    least = min_win_rate(c("tp"), c("sl")) + edge
    checks = {"precision": c("precision_mean") <= least, "ev": c("ev_mean") <= ev, "trades": c("total_trades") / F.greatest(c("n_folds"), F.lit(1)) < trades, "cv": (c("precision_mean") > 0) & (c("precision_std") / c("precision_mean") > cv)}
    reasons = F.filter(F.array(*(F.when(x, F.lit(n)) for n, x in checks.items())), lambda r: r.isNotNull())
    return df.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def calibration(predictions: DataFrame, by: list[str], bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(curve, scores): mean probability and win rate of each bin; Brier score and expected calibration error."""
    y = win().cast("double")
    rows = predictions.withColumn("bin", F.least(F.floor(c("model_probability") * bins), F.lit(bins - 1)).cast("int"))
    curve = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("model_probability").alias("mean_probability"), F.avg(y).alias("win_rate"))
    brier = predictions.groupBy(*by).agg(F.avg((c("model_probability") - y) ** 2).alias("brier"))
    ece = curve.groupBy(*(c(b).alias(f"__{b}") for b in by)).agg((F.sum(c("n") * F.abs(c("mean_probability") - c("win_rate"))) / F.sum("n")).alias("ece"))
    return curve, brier.join(ece, [c(b).eqNullSafe(c(f"__{b}")) for b in by]).drop(*(f"__{b}" for b in by))
