"""Statistics of features, folds and signals. The aggregations are distributed; p-values are added to their small results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import pieces
from barloom.functions.distributions import chi_square_tail, t_two_sided

from .metrics import win
from .strategy import PRIME

c = F.col


def with_p(df: DataFrame, t: str = "t", dof: str = "df", name: str = "p") -> DataFrame:
    """Add the two-sided p-value of Student's t to a table of results."""

    def p(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(ts, ds)], dtype=float)

    return df.withColumn(name, F.pandas_udf(p, "double")(c(t).cast("double"), c(dof).cast("double")))


def prefilter(df: DataFrame, features: list[str], label: str = "label", least: int = 100) -> DataFrame:
    """(feature, n1, n0, t, df, effect, p, verdict): Welch t and Cohen's d with population deviations; one pass."""
    long = df.select(c(label).alias("y"), *(c(f).cast("double").alias(f) for f in features)).unpivot(["y"], features, "feature", "value").filter("value is not null")
    part = lambda f, y, n: f(F.when(c("y") == y, c("value"))).alias(n)
    m = long.groupBy("feature").agg(part(F.count, 1, "n1"), part(F.count, 0, "n0"), part(F.avg, 1, "m1"), part(F.avg, 0, "m0"), part(F.var_pop, 1, "v1"), part(F.var_pop, 0, "v0"))
    a, b = c("v1") / c("n1"), c("v0") / c("n0")
    m = m.withColumns({"t": F.try_divide(c("m1") - c("m0"), F.sqrt(a + b)), "df": F.try_divide((a + b) ** 2, a**2 / (c("n1") - 1) + b**2 / (c("n0") - 1)), "effect": F.try_divide(c("m1") - c("m0"), F.sqrt((c("v1") + c("v0")) / 2))})
    few = (c("n1") < least) | (c("n0") < least)
    size = F.abs("effect")
    m = with_p(m)
    return m.withColumns({"verdict": F.when(few, "MAYBE").when((c("p") < 0.05) & (size >= 0.1), "KEEP").when((c("p") < 0.1) | (size >= 0.05), "MAYBE").otherwise("DROP"), "stars": F.when(c("p") < 0.001, "***").when(c("p") < 0.01, "**").when(c("p") < 0.05, "*").otherwise(""), "size": F.when(size >= 0.8, "large").when(size >= 0.5, "medium").when(size >= 0.2, "small").otherwise("negligible")})


def validated_importance(importance: DataFrame, tests: DataFrame) -> DataFrame:
    """Importance beside its test: HIGH, MEDIUM, LOW or UNVALIDATED."""
    j = importance.join(tests.select(c("feature").alias("__f"), "p", "effect"), c("feature") == c("__f"), "left").drop("__f")
    top = F.percent_rank().over(Window.orderBy(F.desc("importance"))) < 0.25  # one row for each feature
    return j.withColumn("validity", F.when(c("p").isNull() | (c("p") >= 0.05), "UNVALIDATED").when(top & (F.abs("effect") >= 0.2), "HIGH").when(F.abs("effect") >= 0.1, "MEDIUM").otherwise("LOW"))


def fold_stability(folds: DataFrame, by: list[str], metrics: list[str], cuts: tuple[float, float, float] = (0.10, 0.20, 0.35)) -> DataFrame:
    """(by, metric, mean, std, cv, grade) over folds."""
    long = folds.unpivot(by, metrics, "metric", "value")
    out = long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).withColumn("cv", F.try_divide(c("std"), F.abs("mean")))
    return out.withColumn("grade", F.when(c("cv") < cuts[0], "A").when(c("cv") < cuts[1], "B").when(c("cv") < cuts[2], "C").otherwise("F"))


def paired_t(folds: DataFrame, metric: str, config: str = "config_id") -> DataFrame:
    """Each pair of configs across the folds they share: mean difference, t, df."""
    a = folds.select(c(config).alias("a"), "fold", c(metric).alias("x"))
    b = folds.select(c(config).alias("b"), c("fold").alias("__f"), c(metric).alias("y"))
    pairs = a.join(b, (c("fold") == c("__f")) & (c("a") < c("b"))).withColumn("d", c("x") - c("y"))
    out = pairs.groupBy("a", "b").agg(F.count("d").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("__sd")).filter("n > 1")
    return out.withColumns({"t": F.try_divide(c("mean_difference"), c("__sd") / F.sqrt("n")), "df": (c("n") - 1).cast("double")}).drop("__sd")


def distance_to_best(df: DataFrame, metric: str, n: int) -> DataFrame:
    """The n best rows with their rank and their distance to the best."""
    top = df.orderBy(F.desc(metric), "config_id").limit(n)
    w = Window.orderBy(F.desc(metric), "config_id")  # n rows
    return top.withColumn("rank", F.row_number().over(w)).withColumn("behind", F.first(metric).over(w) - c(metric))


def two_groups(df: DataFrame, by: list[str], group: Column, value: str) -> DataFrame:
    """Student's t (equal variances) of value between rows in the group and the others, for each `by`."""
    v, g = c(value).cast("double"), F.coalesce(group, F.lit(False))
    m = df.groupBy(*by).agg(F.count(F.when(g, v)).alias("n_in"), F.count(F.when(~g, v)).alias("n_out"), F.avg(F.when(g, v)).alias("mean_in"), F.avg(F.when(~g, v)).alias("mean_out"), F.var_samp(F.when(g, v)).alias("__vi"), F.var_samp(F.when(~g, v)).alias("__vo"))
    pooled = ((c("n_in") - 1) * c("__vi") + (c("n_out") - 1) * c("__vo")) / (c("n_in") + c("n_out") - 2)
    t = F.try_divide(c("mean_in") - c("mean_out"), F.sqrt(pooled * (1 / c("n_in") + 1 / c("n_out"))))
    return m.withColumns({"t": t, "df": (c("n_in") + c("n_out") - 2).cast("double"), "edge_percent": F.try_divide((c("mean_in") - c("mean_out")) * 100, F.abs("mean_out"))}).drop("__vi", "__vo")


def signal_edges(measured: DataFrame, fired: DataFrame, value: str) -> DataFrame:
    """Each signal's rows against all others. measured: (key, ts, value); fired: (key, ts, signal)."""
    both = fired.select(c("key").alias("k"), c("ts").alias("t"), "signal").join(measured, (c("k") == c("key")) & (c("t") == c("ts")))
    inside = both.groupBy("signal").agg(F.count(value).alias("n_in"), F.sum(value).alias("s_in"), F.sum(c(value) ** 2).alias("q_in"))
    every = measured.agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(c(value) ** 2).alias("q"))  # one row
    j = inside.join(every).withColumns({"n_out": c("n") - c("n_in"), "mean_in": c("s_in") / c("n_in"), "mean_out": F.try_divide(c("s") - c("s_in"), c("n") - c("n_in"))})
    ss = (c("q_in") - c("n_in") * c("mean_in") ** 2) + (c("q") - c("q_in") - c("n_out") * c("mean_out") ** 2)
    t = F.try_divide(c("mean_in") - c("mean_out"), F.sqrt(F.try_divide(ss, c("n") - 2) * (1 / c("n_in") + F.try_divide(F.lit(1.0), c("n_out")))))
    return j.select("signal", "n_in", "n_out", "mean_in", "mean_out", t.alias("t"), (c("n") - 2).cast("double").alias("df"))


def matched_baseline(rows: DataFrame, fired: DataFrame, stratum: str, draw: Column, top: int = PRIME, buckets: int = 4096) -> DataFrame:
    """Rows without a signal, as many of each stratum as there are with one (all, if fewer): those with the smallest draw.

    draw: a number from 0 to top - 1 that looks random. Its histogram in each stratum tells which buckets are taken whole and in which one
    the quota is reached; only that bucket's rows are ranked, equal draws by key and time. Rows of no stratum aren't drawn.
    """
    quota = fired.select("key", "ts").distinct()
    own = rows.join(quota.select(c("key").alias("k"), c("ts").alias("t"), F.lit(1).alias("hit")), (c("key") == c("k")) & (c("ts") == c("t")), "left").drop("k", "t")
    own = own.withColumn("__d", draw).withColumn("__u", F.floor(c("__d") * buckets / top))
    counts = own.groupBy(stratum, "__u").agg(F.count_if(c("hit") == 1).alias("hits"), F.count_if(c("hit").isNull()).alias("n"))
    per, upto = Window.partitionBy(stratum), Window.partitionBy(stratum).orderBy("__u").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.select(c(stratum).alias("__s"), c("__u").alias("__b"), "n", F.sum("hits").over(per).alias("quota"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")).filter("before < quota")  # at most `buckets` rows a stratum
    rest = own.filter("hit is null").join(cut, (c(stratum) == c("__s")) & (c("__u") == c("__b")))
    whole = rest.filter("before + n <= quota")
    ranked = rest.filter("before + n > quota").withColumn("__r", F.row_number().over(Window.partitionBy(stratum, "__u").orderBy("__d", "key", "ts"))).filter("__r <= quota - before").drop("__r")
    return whole.unionByName(ranked).select(*rows.columns)


def exact_quantiles(df: DataFrame, columns: list[str], at: list[float], accuracy: int = 10_000) -> DataFrame:
    """(feature, q, value) of each column and share: the exact quantile, linear between neighbours; nulls don't count.

    A mergeable sketch brackets each quantile by ranks 2 / accuracy of the rows below and above it, where its error is half of that at most. One
    more pass counts the values below each bracket and those in it by value, and the value at the rank is found among the latter. So no
    task holds a column's values.
    """
    margin = 2 / accuracy
    asked = sorted({min(1.0, max(0.0, q + d)) for q in at for d in (-margin, margin)})
    sketch = df.agg(*(F.count(x).alias(f"n {x}") for x in columns), *(F.percentile_approx(c(x).cast("double"), F.array(*map(F.lit, asked)), accuracy).alias(x) for x in columns)).first()
    many = lambda x: sketch[f"n {x}"] > 10 * accuracy  # noqa: E731  the bracket of a few values is all of them
    low = lambda x, q: sketch[x][asked.index(max(0.0, q - margin))] if many(x) and q > margin else float("-inf")
    high = lambda x, q: sketch[x][asked.index(min(1.0, q + margin))] if many(x) and q < 1 - margin else float("inf")
    known = [x for x in columns if sketch[x]]
    own = df.sparkSession.createDataFrame([(x, q, low(x, q), high(x, q), sketch[f"n {x}"]) for x in known for q in at], "feature string, q double, low double, high double, size long")
    long = df.select(*(c(x).cast("double").alias(x) for x in known)).unpivot([], known, "name", "value").filter("value is not null") if known else df.select(F.lit("").alias("name"), F.lit(0.0).alias("value")).limit(0)
    # A row for each column and share: broadcast.
    met = long.join(F.broadcast(own), (c("name") == c("feature")) & (c("value") <= c("high")))
    inside = F.when(c("value") >= c("low"), c("value"))
    cells = met.groupBy("feature", "q", "size", inside.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature", "q").orderBy(F.asc_nulls_first("value")))
    ranked = cells.withColumn("upto", upto).withColumn("rank", c("q") * (c("size") - 1))
    first = F.min(F.when(c("upto") > F.floor("rank"), c("value")))
    then = F.min(F.when(c("upto") > F.ceil("rank"), c("value")))
    return ranked.groupBy("feature", "q").agg((first + (then - first) * (F.max("rank") - F.floor(F.max("rank")))).alias("value"))


def chi_square(df: DataFrame, row: str, column: Column) -> DataFrame:
    """One row: statistic, degrees of freedom and p of a cross table."""
    cells = df.groupBy(c(row).alias("r"), column.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    r, k, all_ = Window.partitionBy("r"), Window.partitionBy("k"), F.sum("n").over(Window.partitionBy())
    e = cells.withColumns({"er": F.sum("n").over(r), "ek": F.sum("n").over(k), "total": all_})  # one row for each cell
    # Cells without rows add their whole expectation: sum of n**2 / expected, less the total, covers them.
    out = e.agg((F.sum(c("n") ** 2 * c("total") / (c("er") * c("ek"))) - F.max("total")).alias("chi2"), ((F.count_distinct("r") - 1) * (F.count_distinct("k") - 1)).alias("df"))
    tail = F.pandas_udf(lambda x, d: pd.Series([chi_square_tail(a, int(b)) if b else 1.0 for a, b in zip(x, d)], dtype=float), "double")
    return out.withColumn("p", tail("chi2", c("df").cast("double")))


def research_buckets(df: DataFrame, bucket: Column, targets: list[float], horizon: int) -> DataFrame:
    """By bucket: rows, share that reaches each target, mean excursions, their ratio, edge over all rows."""
    mfe, mae = c(f"mfe_{horizon}"), c(f"mae_{horizon}")
    rows = df.filter(mfe.isNotNull()).withColumn("bucket", bucket).filter("bucket is not null")
    reach = [F.avg((mfe >= t).cast("double")).alias(f"p_{t:g}") for t in targets]
    by = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *reach, F.avg(mfe).alias("mean_mfe"), F.avg(mae).alias("mean_mae"))
    every = rows.agg(F.avg(mfe).alias("__all"))
    return by.join(every).withColumns({"ratio": F.try_divide("mean_mfe", "mean_mae"), "edge": c("mean_mfe") - c("__all")}).drop("__all")


def stop_coverage(df: DataFrame, multiples: list[float], horizon: int) -> DataFrame:
    """Share of rows whose adverse excursion stays within a multiple of ATR."""
    rows = df.filter(c(f"mae_{horizon}").isNotNull() & c("atr").isNotNull()).withColumn("multiple", F.explode(F.array(*map(F.lit, multiples))))
    return rows.groupBy("multiple").agg(F.count(F.lit(1)).alias("n"), F.avg((c(f"mae_{horizon}") <= c("atr") * c("multiple")).cast("double")).alias("coverage"))


def regimes(df: DataFrame, rank: str) -> DataFrame:
    """Quartile regime of a trailing rank, and the number of the run of equal regimes that a bar is in."""
    out = df.withColumn("regime", F.when(c(rank) <= 0.25, "low").when(c(rank) <= 0.5, "normal").when(c(rank) <= 0.75, "elevated").when(c(rank) <= 1, "high"))
    own = pieces.scan(pieces.in_pieces(out), __before=pieces.previous("regime"))
    new = F.when(c("regime").eqNullSafe(c("__before")), 0).otherwise(1)
    own = pieces.scan(own.withColumn("__new", new), cluster=pieces.total("__new"))
    return own.select(*out.columns, "cluster")


def effect_by(df: DataFrame, by: Column, name: str) -> DataFrame:
    out = df.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins"), F.avg("pips_result").alias("avg_pips"))
    return out.withColumn("win_rate", c("wins") / c("n_trades"))
