"""Run ledger: parameter grids, what is left to do, tiers, medals, diagnostics and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import min_win_rate

c = F.col
PARAMETERS = ["tp", "sl", "hold"]


def parameter_grid(spark: SparkSession, tp: tuple[int, int, int], sl: tuple[int, int, int], hold: tuple[int, int, int]) -> DataFrame:
    """Every combination of three (first, last, step) ranges."""
    one = spark.range(1).select(*(F.sequence(*map(F.lit, r)).alias(n) for n, r in zip(PARAMETERS, (tp, sl, hold))))
    for n in PARAMETERS:
        one = one.withColumn(n, F.explode(n))
    return one


def pending(grid: DataFrame, ledger: DataFrame) -> DataFrame:
    done = ledger.select(*(c(p).cast("int").alias(p) for p in PARAMETERS)).distinct()
    return grid.join(done, PARAMETERS, "left_anti")


def tiers(df: DataFrame) -> DataFrame:
    """Add risk_reward, tier (0 from 2.5 on), config_id, least win rate and edge."""
    rr = F.try_divide(c("tp").cast("double"), c("sl").cast("double"))
    whole = lambda x: c(x).cast("int").cast("string")
    return df.withColumns({"risk_reward": rr, "tier": F.when(rr >= 2.5, 0).otherwise(1), "config_id": F.concat(F.lit("TP"), whole("tp"), F.lit("_SL"), whole("sl"), F.lit("_H"), whole("hold")), "min_win_rate": min_win_rate(c("tp").cast("double"), c("sl").cast("double"))})


def medals(df: DataFrame, by: str = "edge") -> DataFrame:
    """GOLD, SILVER or BRONZE by edge over the break-even rate (0.15, 0.08), or by expected value and variation."""
    if by == "edge":
        edge = c("precision_mean") - c("min_win_rate")
        return df.withColumn("medal", F.when(edge >= 0.15, "GOLD").when(edge >= 0.08, "SILVER").otherwise("BRONZE"))
    return df.withColumn("medal", F.when((c("ev_mean") >= 5) & (c("precision_cv") < 0.15), "GOLD").when(c("ev_mean") >= 2, "SILVER").otherwise("BRONZE"))


def best_config(df: DataFrame) -> DataFrame:
    return df.agg(F.max_by("config_id", F.struct("ev_mean", "f1_mean", "precision_mean", "config_id")).alias("config_id"), F.max("ev_mean").alias("ev_mean"))


def progress(ledger: DataFrame, n_grid: int) -> DataFrame:
    out = ledger.agg(F.count(F.lit(1)).alias("n_done"), F.count_if(c("passed")).alias("n_passed"), F.count_if(~c("passed")).alias("n_failed"), F.count_if(c("passed") & (c("tier") == 0)).alias("n_tier0"), F.count_if(c("medal") == "GOLD").alias("n_gold"), F.max("ev_mean").alias("best_ev"))
    return out.withColumn("percent_done", c("n_done") * 100 / n_grid)


def parameter_patterns(ledger: DataFrame) -> DataFrame:
    """Pass rate and mean expected value by each parameter and by risk-reward bucket, in one pass of grouping sets."""
    bucket = F.when(c("risk_reward") < 1.5, "<1.5").when(c("risk_reward") < 2.5, "1.5-2.5").otherwise(">=2.5")
    base = ledger.select(*(c(p).cast("int").cast("string").alias(p) for p in PARAMETERS), bucket.alias("rr"), "passed", "ev_mean")
    names = [*PARAMETERS, "rr"]
    sets = [[c(n)] for n in names]
    g = base.groupingSets(sets, *names).agg(F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("n"), F.avg(c("passed").cast("double")).alias("pass_rate"), F.avg("ev_mean").alias("mean_ev"))
    which = F.when(c("__g") == 7, "tp").when(c("__g") == 11, "sl").when(c("__g") == 13, "hold").otherwise("rr")
    return g.select(which.alias("parameter"), F.coalesce(*names).alias("value"), "n", "pass_rate", "mean_ev")


def rejection_histogram(ledger: DataFrame) -> DataFrame:
    one = ledger.select(F.explode("reasons").alias("r"))
    return one.groupBy(F.trim(F.substring_index("r", "(", 1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def near_misses(ledger: DataFrame, most: int = 1) -> DataFrame:
    return ledger.filter(~c("passed") & (F.size("reasons") <= most)).select("config_id", "ev_mean", "precision_mean", F.array_join("reasons", ",").alias("issues"))


def feature_frequency(selected: DataFrame, least_share: float = 0.0) -> DataFrame:
    """(feature, n, share) of rows with an array `features`."""
    total = selected.agg(F.count(F.lit(1)).alias("total"))
    by = selected.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return by.join(total).select("feature", "n", (c("n") / c("total")).alias("share")).filter(c("share") >= least_share)


def consensus_features(selected: DataFrame, by: list[str], share: float = 0.6) -> DataFrame:
    """Features chosen in at least that share of a group's folds, and how stable: always, sometimes or rarely."""
    n = selected.groupBy(*by).agg(F.count_distinct("fold").alias("__n")).select(*(c(b).alias(f"__{b}") for b in by), "__n")
    f = selected.select(*by, "fold", F.explode("features").alias("feature")).groupBy(*by, "feature").agg(F.count_distinct("fold").alias("n_folds"))
    out = f.join(n, [c(b).eqNullSafe(c(f"__{b}")) for b in by])
    out = out.withColumn("share", c("n_folds") / c("__n")).withColumn("stability", F.when(c("share") == 1, "always").when(c("share") >= 0.5, "sometimes").otherwise("rarely"))
    return out.withColumn("consensus", c("share") >= share).drop("__n", *(f"__{b}" for b in by))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts, pass rates and mean expected values of two ledgers, differences and Welch's t of the values."""
    side = lambda d, s: d.agg(F.count(F.lit(1)).alias(f"n_{s}"), F.avg(c("passed").cast("double")).alias(f"pass_{s}"), F.avg("ev_mean").alias(f"ev_{s}"), F.var_samp("ev_mean").alias(f"__v{s}"))
    j = side(a, "a").join(side(b, "b"))
    va, vb = c("__va") / c("n_a"), c("__vb") / c("n_b")
    return j.withColumns({"pass_delta": c("pass_b") - c("pass_a"), "ev_delta": c("ev_b") - c("ev_a"), "t": F.try_divide(c("ev_b") - c("ev_a"), F.sqrt(va + vb)), "df": F.try_divide((va + vb) ** 2, va**2 / (c("n_a") - 1) + vb**2 / (c("n_b") - 1))}).drop("__va", "__vb")


def shared_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """(feature, side): in both, only in the first or only in the second."""
    fa, fb = (x.select(F.explode("features").alias("feature")).distinct() for x in (a, b))
    tag = lambda d, s: d.withColumn("side", F.lit(s))
    return tag(fa.intersect(fb), "both").unionByName(tag(fa.exceptAll(fb), "first")).unionByName(tag(fb.exceptAll(fa), "second"))


def recommendations(ledger: DataFrame) -> DataFrame:
    """(code, triggered): verdict rows from one aggregate."""
    a = ledger.agg(F.count(F.lit(1)).alias("n"), F.avg(c("passed").cast("double")).alias("rate"), F.max("ev_mean").alias("ev"), F.avg(F.when(c("tier") == 0, c("passed").cast("double"))).alias("r0"), F.avg(F.when(c("tier") == 1, c("passed").cast("double"))).alias("r1"))
    rules = {"no_config_passes": c("rate") == 0, "few_configs_pass": (c("rate") > 0) & (c("rate") < 0.2), "many_configs_pass": c("rate") >= 0.5, "no_positive_value": c("ev") <= 0, "prefer_tier0": c("r0") > c("r1"), "prefer_tier1": c("r1") > c("r0")}
    each = F.array(*(F.struct(F.lit(n).alias("code"), F.coalesce(x, F.lit(False)).alias("triggered")) for n, x in rules.items()))
    return a.select(F.explode(each).alias("r")).select("r.*")


def index_folds(df: DataFrame, n_folds: int, test_share: float = 0.1, calibration_share: float = 0.05) -> DataFrame:
    """Expanding folds by row number of each key, half-open: (key, fold, train_end, cal_end, test_end)."""
    n = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    end = F.floor(c("n") * (1 - test_share * (n_folds - c("fold"))))
    return out.select("key", "fold", F.floor(c("n") * (1 - test_share * (n_folds - c("fold") + 1) - calibration_share)).alias("train_end"), F.floor(c("n") * (1 - test_share * (n_folds - c("fold") + 1))).alias("cal_end"), end.alias("test_end"))


def date_folds(df: DataFrame, n_folds: int, test_days: int, calibration_days: int) -> DataFrame:
    """Folds counted back from the last day, half-open: (fold, cal_start, test_start, test_end)."""
    last = df.agg(F.max(F.to_date("ts")).alias("last"))
    back = (n_folds - c("fold")) * test_days
    f = last.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    end = F.date_sub(F.date_add("last", 1), back.cast("int"))
    return f.select("fold", F.date_sub(end, test_days + calibration_days).alias("cal_start"), F.date_sub(end, test_days).alias("test_start"), end.alias("test_end"))


def fixed_folds(df: DataFrame, folds: list[tuple[str, str, str]]) -> DataFrame:
    """Each row with the named folds (name, train_end, test_end) that it is in: train before train_end, test from then on and
    before test_end; days, half-open."""
    day = F.to_date("ts")
    parts = [F.struct(F.lit(n).alias("fold"), F.when(day < F.lit(a).cast("date"), "train").when(day < F.lit(b).cast("date"), "test").alias("part")) for n, a, b in folds]
    return df.withColumn("__f", F.explode(F.filter(F.array(*parts), lambda f: f["part"].isNotNull()))).select(*df.columns, "__f.fold", "__f.part")


def assign_folds(df: DataFrame, folds: DataFrame, purge_days: int = 0) -> DataFrame:
    """Each row with the fold and the part (train, cal or test) that it is in; purge drops train rows that close to cal."""
    day = F.to_date("ts")
    j = df.join(F.broadcast(folds), day < c("test_end"))  # a few folds
    part = F.when(day < F.date_sub("cal_start", purge_days), "train").when((day >= c("cal_start")) & (day < c("test_start")), "cal").when(day >= c("test_start"), "test")
    return j.withColumn("part", part).filter("part is not null").drop("cal_start", "test_start", "test_end")
