"""Walk-forward modelling jobs on pyspark.ml: pipelines, feature elimination, search, calibration, importance and heads."""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.ledger import MODELS, Ledger

from . import metrics, runs

c = F.col


class NoFold(ValueError):
    """No fold has enough rows to train and test on."""


def as_doubles(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles with null for NaN and infinite values."""
    clean = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return df.withColumns({f: clean(c(f).cast("double")) for f in features})


def preparation(features: list[str], strategy: str = "median") -> list:
    """Stages fitted on training rows only: impute, assemble, scale."""
    filled = [f"{f}__i" for f in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy=strategy), VectorAssembler(inputCols=filled, outputCol="__raw", handleInvalid="keep"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)]


def train(df: DataFrame, features: list[str], label: str = "label", **params: object) -> PipelineModel:
    """Boosted trees with the given parameters (maxIter, maxDepth, stepSize, subsamplingRate, seed)."""
    learner = GBTClassifier(featuresCol="__x", labelCol=label, **({"maxIter": 20, "maxDepth": 3, "seed": 1} | params))
    return Pipeline(stages=[*preparation(features), learner]).fit(as_doubles(df, features))


def predict(model: PipelineModel, df: DataFrame, features: list[str], name: str = "model_probability") -> DataFrame:
    out = model.transform(as_doubles(df, features))
    out = out.withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    weights = model.stages[-1].featureImportances.toArray()
    total = float(weights.sum()) or 1.0
    return [(f, float(w) / total) for f, w in zip(features, weights)]


def importance_table(spark: SparkSession, folds: list[list[tuple[str, float]]]) -> DataFrame:
    """Summed importance of each feature over folds."""
    rows = [(i, f, w) for i, fold in enumerate(folds) for f, w in fold]
    df = spark.createDataFrame(rows, "fold int, feature string, importance double")
    return df.groupBy("feature").agg(F.sum("importance").alias("importance"), F.count_if(c("importance") > 0).alias("n_folds"))


def eliminate(df: DataFrame, features: list[str], keep: int, step: int = 1, label: str = "label", **params: object) -> list[str]:
    """Recursive elimination: fit, drop the `step` least important features, repeat until `keep` are left."""
    left = list(features)
    while len(left) > keep:
        ranked = sorted(importance(train(df, left, label, **params), left), key=lambda x: (x[1], x[0]))
        gone = {f for f, _ in ranked[: min(step, len(left) - keep)]}
        left = [f for f in left if f not in gone]
    return left


def evaluate(df: DataFrame, label: str = "label", metric: str = "areaUnderPR", probability: str = "model_probability") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=probability, labelCol=label, metricName=metric).evaluate(df)


def eliminate_cv(splits: list[tuple[DataFrame, DataFrame]], features: list[str], sizes: list[int], **params: object) -> tuple[list[str], dict[int, float]]:
    """Elimination with the number of features chosen by mean average precision over (train, test) splits."""
    scores = {}
    for k in sizes:
        found = []
        for fit_rows, test_rows in splits:
            chosen = eliminate(fit_rows, features, k, max(1, (len(features) - k) // 2), **params)
            found.append(evaluate(predict(train(fit_rows, chosen, **params), test_rows, chosen)))
        scores[k] = sum(found) / len(found)
    best = max(sizes, key=lambda k: (scores[k], -k))
    return eliminate(splits[-1][0], features, best, **params), scores


def search(splits: list[tuple[DataFrame, DataFrame]], features: list[str], grid: dict[str, list], n: int | None = None, seed: int = 1) -> list[tuple[dict, float]]:
    """Parameter sets with their mean average precision, best first; n: so many drawn at random instead of all."""
    every = [dict(zip(grid, v)) for v in product(*grid.values())]
    tried = every if n is None else random.Random(seed).sample(every, min(n, len(every)))
    scored = [(p, sum(evaluate(predict(train(a, features, **p), b, features)) for a, b in splits) / len(splits)) for p in tried]
    return sorted(scored, key=lambda x: -x[1])


def calibrate(df: DataFrame, label: str = "label", method: str = "platt", probability: str = "model_probability") -> Callable[[DataFrame], DataFrame]:
    """Fit Platt scaling or isotonic regression on held-out predictions; returns what adds `calibrated`."""
    if method == "platt":
        logit = lambda d: d.withColumn("__z", F.log(F.greatest(c(probability), F.lit(1e-9)) / F.greatest(1 - c(probability), F.lit(1e-9))))
        stages = Pipeline(stages=[VectorAssembler(inputCols=["__z"], outputCol="__v"), LogisticRegression(featuresCol="__v", labelCol=label, rawPredictionCol="__r", probabilityCol="__p", predictionCol="__y")]).fit(logit(df))
        return lambda d: stages.transform(logit(d)).withColumn("calibrated", vector_to_array("__p")[1]).drop("__z", "__v", "__r", "__p", "__y")
    iso = IsotonicRegression(featuresCol=probability, labelCol=label, predictionCol="calibrated").fit(df)
    return iso.transform


def time_splits(df: DataFrame, n: int) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding time-ordered splits by quantiles of time: train before, test after, n of them."""
    seconds = df.withColumn("__s", F.unix_timestamp(c("ts").cast("timestamp")))
    cuts = seconds.approxQuantile("__s", [i / (n + 1) for i in range(1, n + 2)], 0.001)
    part = lambda lo, hi: seconds.filter((c("__s") >= lo) & (c("__s") < hi)).drop("__s")
    return [(part(float("-inf"), a), part(a, b + (1 if i == n - 1 else 0))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def walk_forward(df: DataFrame, features: list[str], label: str = "label", *, keep: int | None = None, least_train: int = 100, least_test: int = 30, method: str = "platt", **params: object) -> DataFrame:
    """Out-of-fold predictions of rows with `fold` and `part` (train, cal, test): select, fit, calibrate, score.

    Folds with too few rows are skipped. Each fold is an independent job over distributed rows.
    """
    sizes = {r["fold"]: (r["a"], r["b"]) for r in df.groupBy("fold").agg(F.count_if(c("part") == "train").alias("a"), F.count_if(c("part") == "test").alias("b")).collect()}
    out: DataFrame | None = None
    for fold in sorted(f for f, (a, b) in sizes.items() if a >= least_train and b >= least_test):
        rows = df.filter(c("fold") == fold)
        fit_rows = rows.filter("part = 'train'")
        chosen = eliminate(fit_rows, features, keep, max(1, (len(features) - keep) // 2), label, **params) if keep else features
        model = train(fit_rows, chosen, label, **params)
        fix = calibrate(predict(model, rows.filter("part = 'cal'"), chosen), label, method)
        scored = fix(predict(model, rows.filter("part = 'test'"), chosen)).select(*df.columns, "model_probability", "calibrated")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise NoFold("no fold has enough rows")
    return out


LEDGER = "tp int, sl int, hold int, n_folds long, n_test long, roc_auc double, average_precision double, precision_mean double, recall_mean double"


def _grid_line(data: DataFrame, config: dict, features: list[str], **params: object) -> DataFrame:
    """The ledger's line of one configuration; without a usable fold, one with n_folds 0."""
    own = [F.lit(int(config[p])).alias(p) for p in runs.PARAMETERS]
    areas = {"roc_auc": "roc_auc", "average_precision": "average_precision", "precision": "precision_mean", "recall": "recall_mean"}
    try:
        scored = walk_forward(data, features, **params)
    except NoFold:
        return data.sparkSession.range(1).select(*own, F.lit(0).alias("n_folds"), F.lit(0).alias("n_test"), *(F.lit(None).alias(n) for n in areas.values()))
    named = scored.withColumn("outcome", F.when(c("label") == 1, "WIN").otherwise("LOSS")).withColumn("model_probability", c("calibrated"))
    folds = metrics.classification(named, ["fold"])
    n = c("tp") + c("fp") + c("fn") + c("tn")
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), F.sum(n).alias("n_test"), *(F.avg(x).alias(y) for x, y in areas.items())).select(*own, "*")


def grid_run(rows: Callable[[dict], DataFrame], grid: DataFrame, ledger: Ledger, features: list[str], *, threads: int = 4, tries: int = 2, **params: object) -> DataFrame:
    """Walk forward for every configuration (tp, sl, hold) that the ledger lacks, best area under the curve first.

    rows: the labelled rows of a configuration, with their folds. Configurations run as jobs of their own in a bounded pool of threads, each in
    a scheduler pool of its own, so that with spark.scheduler.mode FAIR small fits fill the cluster. A line is written once, when all folds
    of its configuration are done; one that fails is tried again, and what failed every time is raised after the others are
    done. A run that stopped goes on with what the ledger lacks. The grid is a small table.
    """
    spark = grid.sparkSession
    todo = [r.asDict() for r in runs.pending(grid, ledger.read()).orderBy(*runs.PARAMETERS).collect()]

    def done(config: dict) -> Exception | None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "grid-" + "-".join(str(config[p]) for p in runs.PARAMETERS))
        failed = None
        for _ in range(tries):
            try:
                data = rows(config).cache()  # read by every stage of every fold
                try:
                    ledger.upsert(_grid_line(data, config, features, **params))
                finally:
                    data.unpersist()
            except Exception as e:  # noqa: BLE001  raised below, once the rest is done
                failed = e
            else:
                return None
        return failed

    with ThreadPoolExecutor(max(1, threads)) as pool:
        failed = [(x, e) for x, e in zip(todo, pool.map(inheritable_thread_target(spark)(done), todo)) if e]
    if failed:
        raise RuntimeError(f"{len(failed)} configurations failed, the first: {failed[0][0]}") from failed[0][1]
    return ledger.read().orderBy(F.desc_nulls_last("roc_auc"), *runs.PARAMETERS)


def grid_ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, list(runs.PARAMETERS), LEDGER)


def fit_and_export(df: DataFrame, features: list[str], registry: Ledger, folder: str, config_id: str, *, label: str = "label", threshold: float = 0.5, tier: int | None = None, **params: object) -> dict:
    """The final job of a configuration: fit on all rows (fold 0), save the pipeline, write its feature list and facts as JSON beside
    it, and enter it in the registry. Precision and expected value are in-sample. Returns the facts."""
    spark = df.sparkSession
    model = train(df, features, label, **params)
    path = f"{folder}/{config_id}-{uuid.uuid4().hex}"
    model.write().save(f"{path}/model")
    scored = predict(model, df, features).filter(c("model_probability") >= threshold)
    row = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(c(label).cast("double")).alias("precision"), F.avg(c("pips")).alias("ev") if "pips" in df.columns else F.lit(None).alias("ev")).first()
    facts = {"config_id": config_id, "fold": 0, "path": path, "threshold": float(threshold), "precision": row["precision"], "ev": row["ev"], "tier": tier}
    weights = [{"feature": f, "importance": x} for f, x in sorted(importance(model, features), key=lambda v: (-v[1], v[0]))]
    spark.createDataFrame([json.dumps({**facts, "n_trades": row["n"], "features": features, "importance": weights, "params": params})], "string").coalesce(1).write.text(f"{path}/config")
    registry.upsert(spark.createDataFrame([tuple(facts[f.name] for f in spark.createDataFrame([], MODELS).schema)], MODELS))
    return facts


def by_tier(registry: Ledger) -> DataFrame:
    """Models of each tier: count, best precision and its path."""
    own = registry.read()
    return own.groupBy("tier").agg(F.count(F.lit(1)).alias("n_models"), F.max("precision").alias("best_precision"), F.max_by("path", F.struct("precision", "path")).alias("best_path"))


def load(registry: Ledger, config_id: str, fold: int | None = None) -> tuple[PipelineModel, dict] | None:
    """The model of a configuration and fold, by default that with the best precision, and what was exported with it."""
    own = registry.read().filter((c("config_id") == config_id) & (F.lit(True) if fold is None else c("fold") == fold))
    best = own.orderBy(F.desc_nulls_last("precision"), "fold").first()
    if best is None:
        return None
    facts = json.loads(registry.spark.read.text(f"{best['path']}/config").first()[0])
    return PipelineModel.load(f"{best['path']}/model"), facts


def heads(df: DataFrame, features: list[str], flags: list[str], values: list[str]) -> dict[str, PipelineModel]:
    """One classifier for each flag (targets reached) and one regressor for each value (excursions)."""
    out = {f: train(df.filter(c(f).isNotNull()), features, f) for f in flags}
    for v in values:
        learner = GBTRegressor(featuresCol="__x", labelCol=v, maxIter=20, maxDepth=3, seed=1)
        out[v] = Pipeline(stages=[*preparation(features), learner]).fit(as_doubles(df.filter(c(v).isNotNull()), features))
    return out


def extract_trades(predictions: DataFrame, threshold: float, probability: str = "calibrated") -> DataFrame:
    return predictions.filter(c(probability) >= threshold).withColumn("threshold_used", F.lit(threshold))


def rank_models(predictions: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """ROC AUC and average precision of models on the rows that all of them scored, ranked."""
    from functools import reduce

    keys = reduce(DataFrame.intersect, [p.select("key", "ts") for p in predictions.values()])
    spark = keys.sparkSession
    rows = [(n, *(evaluate(p.join(keys, ["key", "ts"], "left_semi"), label, m) for m in ("areaUnderROC", "areaUnderPR"))) for n, p in predictions.items()]
    df = spark.createDataFrame(rows, "model string, roc_auc double, average_precision double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("average_precision"), "model")))  # one row for each model
