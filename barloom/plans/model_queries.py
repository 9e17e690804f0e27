"""Queries of modelling jobs and streams; compared by their properties in tests."""

from __future__ import annotations

import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import crossframe, labels, metrics, models, runs
from barloom.sources import ledger
from barloom.streaming import asof as stream_asof
from barloom.streaming import bars as streaming

from . import feature_queries as fq
from . import trade_queries as tq
from .feature_queries import fast, read, shown, slow
from .sqltext import STAMP

QUERIES: dict[str, fq.Query] = {}
FEATURES = ["rsi_value", "bb_position", "trend_strength", "volume_ratio", "atr_pct", "candle_body_pct", "candle_rejection", "plus_di"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = crossframe.merged(fast(spark, sf_dir), slow(spark, sf_dir))
    df = labels.barrier(merged, 100, 60, 12).filter("reason <> 'insufficient_data' and d1_ts is not null")
    return runs.assign_folds(df.select("key", "ts", *FEATURES, "label", "pips"), runs.date_folds(df, 2, 5, 4), purge_days=2)


def gbt_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold classification metrics of each fold: elimination, boosted trees, Platt scaling."""
    rows = _rows(spark, sf_dir).cache()
    scored = models.walk_forward(rows, FEATURES, keep=4, maxIter=3)
    named = scored.withColumn("outcome", F.when(F.col("label") == 1, "WIN").otherwise("LOSS"))
    return shown(metrics.classification(named, ["fold"]))


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that the session names; one under /tmp only where there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{root or 'file://' + tempfile.mkdtemp(prefix='spark-models-', dir='/tmp')}/barloom-{uuid.uuid4().hex}"


def grid_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk forward over a grid of barriers, resumed once: the ledger of all configurations, best first."""
    folder = _folder(spark)
    bars_ = crossframe.merged(fast(spark, sf_dir), slow(spark, sf_dir)).filter("d1_ts is not null")
    bars_.select("key", "ts", "high", "low", "close", *FEATURES).write.parquet(f"{folder}/bars")  # made once, and a short plan for every fit
    merged = spark.read.parquet(f"{folder}/bars")

    def rows(config: dict) -> DataFrame:
        df = labels.barrier(merged, config["tp"], config["sl"], config["hold"]).filter("reason <> 'insufficient_data'")
        return runs.assign_folds(df.select("key", "ts", *FEATURES, "label", "pips"), runs.date_folds(df, 2, 5, 4), purge_days=2)

    lines, grid = models.grid_ledger(spark, f"{folder}/ledger"), runs.parameter_grid(spark, (60, 120, 60), (60, 60, 1), (6, 6, 1))
    models.grid_run(rows, grid.filter("tp = 60"), lines, FEATURES, maxIter=3)
    return shown(models.grid_run(rows, grid, lines, FEATURES, maxIter=3))


def stream_bars_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished bars of the events read as a stream, run until all that is there is processed."""
    root = _folder(spark)
    source = read(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    streaming.run_available(streaming.stream_bars(events), f"{root}/bars", f"{root}/state")
    return shown(spark.read.parquet(f"{root}/bars"))


def stream_asof_prev_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of join of two streams of bars, stopped and resumed between them; the last rows move the watermark past all bars."""
    root, before = _folder(spark), spark.conf.get(stream_asof.PROVIDER)
    bars_ = stream_asof.united(fast(spark, sf_dir), slow(spark, sf_dir)).withColumn("day", F.dayofmonth("ts"))
    end = lambda at: stream_asof.clock(spark, at)
    last = datetime(2200, 1, 1)
    parts = [bars_.filter("day <= 15"), bars_.filter("day > 15 or day is null"), end(last), end(last)]
    spark.conf.set(stream_asof.PROVIDER, stream_asof.ROCKS)
    try:
        for part in parts:
            part.drop("day").write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(stream_asof.BAR).parquet(f"{root}/in")
            streaming.run_available(stream_asof.stream_previous_day(stream), f"{root}/out", f"{root}/state")
    finally:
        spark.conf.set(stream_asof.PROVIDER, before)
    return shown(spark.read.parquet(f"{root}/out"), ["key", "ts", "close", "d1_ts", "d1_close", "d1_volume"], 12)


FOLD_SQL = tq.cte([*tq.TRADES], f"SELECT config_id, fold, round({tq.WIN} / count(*)::DOUBLE, 6) AS precision, round(avg(pips_result), 6) + 0.0 AS ev, count(*) AS n_trades, {STAMP.replace('ts', 'min(ts)')} AS test_start, {STAMP.replace('ts', 'max(ts)')} AS test_end FROM trades GROUP BY ALL")


def fold_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each configuration and fold: an earlier run's are replaced by two runs that write at the same time, then compacted."""
    log = tq.log(spark, sf_dir)
    win = F.avg((F.col("outcome") == "WIN").cast("double"))
    results = log.groupBy("config_id", "fold").agg(win.alias("precision"), F.avg("pips_result").alias("ev"), F.count(F.lit(1)).alias("n_trades"), F.min("ts").alias("test_start"), F.max("ts").alias("test_end"))
    table = ledger.fold_results(spark, f"{_folder(spark)}/folds")
    table.upsert(results.withColumn("precision", F.lit(0.0)))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(table.upsert, [results.filter("fold % 2 = 0"), results.filter("fold % 2 = 1")]))
    table.compact()
    return shown(table.read(), ["config_id", "fold", "precision", "ev", "n_trades", "test_start", "test_end"])


def final_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on all rows and export for two configurations, reload the better one, and count what it takes by key."""
    folder = _folder(spark)
    registry = ledger.models(spark, f"{folder}/registry")
    crossframe.merged(fast(spark, sf_dir), slow(spark, sf_dir)).filter("d1_ts is not null").select("key", "ts", "high", "low", "close", *FEATURES).write.parquet(f"{folder}/bars")
    merged = spark.read.parquet(f"{folder}/bars")
    rows = {}
    for tp in (60, 120):
        rows[f"TP{tp}_SL60_H12"] = labels.barrier(merged, tp, 60, 12).filter("reason <> 'insufficient_data'")
        models.fit_and_export(rows[f"TP{tp}_SL60_H12"], FEATURES, registry, folder, f"TP{tp}_SL60_H12", tier=tp // 60, maxIter=3)
    best = registry.read().orderBy(F.desc("precision"), "config_id").first()["config_id"]
    model, facts = models.load(registry, best)
    taken = models.predict(model, rows[best], facts["features"]).filter(F.col("model_probability") >= facts["threshold"])
    return shown(taken.groupBy("key").agg(F.first(F.lit(best)).alias("config_id"), F.count(F.lit(1)).alias("n_trades"), F.avg(F.col("label").cast("double")).alias("precision")))


QUERIES |= {"fold_ledger": fold_ledger, "final_model": final_model, "stream_asof_prev_day": stream_asof_prev_day, "gbt_walk_forward": gbt_walk_forward, "grid_walk_forward": grid_walk_forward, "stream_bars_4h": stream_bars_4h}
