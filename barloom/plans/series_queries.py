"""Queries and SQL over one long series: bars of 30 seconds of all events, with gaps where there were none, run in pieces of rows.

The SQL is that of the same queries over several short series, with another key and interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import pieces
from barloom.functions import windows as w
from barloom.operators import features, labels, signals, stats
from barloom.sources.bars import bars

from . import feature_queries as fq
from . import label_queries as lq
from .feature_queries import read, shown

#: Rows of a piece.
SIZE = 1000
_kept = ("whole_key", "own_piece", "in_piece")


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(read(spark, sf_dir, "events").withColumn("all", F.lit("all")), "30 seconds", key="all")


def of_one(sql: str) -> str:
    return sql.replace("CAST(event_type AS VARCHAR)", "'all'").replace("INTERVAL '4 hours'", "INTERVAL '30 seconds'")


def family(name: str) -> fq.Query:
    columns, digits = fq.SHOWN[name]
    return lambda s, d: shown(features.add(one_series(s, d), name, size=SIZE), ["key", "ts", *columns], digits)


FAMILIES = ("zscores", "percentiles", "adx", "streaks", "run_streaks", "exporter", "crossovers")
QUERIES: dict[str, fq.Query] = {f"one_series_{n}": family(n) for n in FAMILIES}
SQL: dict[str, str] = {f"one_series_{n}": of_one(fq.SQL[f"f_{n}"]) for n in FAMILIES}


def query(name: str):
    def put(f: fq.Query) -> fq.Query:
        QUERIES[f"one_series_{name}"] = f
        SQL[f"one_series_{name}"] = of_one(lq.SQL[name])
        return f

    return put


@query("label_grid")
def label_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lambda part: labels.barrier_grid(part, lq.GRID, keep=_kept)
    return shown(pieces.by_pieces(one_series(spark, sf_dir), grid, ahead=max(h for *_, h in lq.GRID), size=SIZE))


@query("regime_clusters")
def regime_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    based = features.add(one_series(spark, sf_dir), "base", size=SIZE)
    ranked = pieces.by_pieces(based, lambda part: part.withColumn("rank", w.percent_rank("atr_pct", 50)), back=50, size=SIZE)
    return shown(stats.regimes(ranked, "rank"), ["key", "ts", "regime", "cluster"])


@query("signals_15")
def signals_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    based = features.add(one_series(spark, sf_dir), "base", size=SIZE)
    ready = pieces.by_pieces(based, signals.prepare, back=200, size=SIZE)
    return shown(signals.evaluate(ready, signals.single_frame()))
