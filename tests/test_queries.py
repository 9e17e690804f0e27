"""Registered queries against their SQL in DuckDB, a few of each kind."""

import math
import os

import pytest

from barloom.plans import registry

DATA = "/root/testdata/sf0.001"
PICKED = ["flagship", "f_exporter", "f_early", "early_pairs", "label_summary", "loss_report", "asof_user_prev_day", "f_adx", "f_percentiles", "f_ema_levels", "f_zscores_chunked", "mtf_features", "label_grid_stats", "nonoverlap_trades", "signals_15", "filter_combos", "profit_metrics", "classification_metrics", "param_patterns", "walk_forward_rows", "trade_decision", "feature_comparison", "filter_impact", "filter_comparison", "fold_thresholds", "improved_folds", "fixed_date_folds", "final_report", "f_zscores_user", "label_grid_user", "permutation_mc", "bootstrap_mc", "filter_combos_all", "filter_dynamic", "filter_oos", "one_series_zscores", "one_series_crossovers", "one_series_label_grid", "one_series_regime_clusters", "matched_baseline", "matched_baseline_regime", "equity_curve", "threshold_sweep", "fold_ledger", "stream_asof_prev_day"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    r = con.sql(registry.SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
    assert sorted(tuple(map(plain, row)) for row in df.select(*columns).collect()) == want


def test_feature_significance_by_integration(spark):
    """p of Welch's test against Simpson's rule over Student's density."""
    for r in registry.QUERIES["feature_significance"](spark, DATA).collect():
        log_c = math.lgamma((r.df + 1) / 2) - math.lgamma(r.df / 2) - 0.5 * math.log(r.df * math.pi)
        density = lambda x: math.exp(log_c - (r.df + 1) / 2 * math.log1p(x * x / r.df))  # noqa: B023, E731
        n, t = 20_000, min(abs(r.t), 60.0)
        h = t / n
        middle = h / 3 * (density(0) + density(t) + 4 * sum(density(h * i) for i in range(1, n, 2)) + 2 * sum(density(h * i) for i in range(2, n, 2)))
        assert r.p_value == pytest.approx(max(0.0, 1 - 2 * middle), abs=2e-6) and r.is_significant == (r.p_value < 0.05)


def test_averages_over_many_chunks(spark):
    """The carry looks back over a bounded number of chunks, and a long series shows no difference."""
    from pyspark.sql import functions as F

    from barloom.functions import windows as w

    df = spark.range(3000).select(F.lit("k").alias("key"), F.timestamp_seconds("id").alias("ts"), F.sin(F.col("id") * 0.37).alias("x"))
    got = [r.e for r in w.emas(df, {"e": ("x", 9)}, chunk=16).orderBy("ts").collect()]
    want, keep = [], 1 - 2 / 10
    for i in range(3000):
        x = math.sin(i * 0.37)
        want.append(x if not want else want[-1] * keep + x * (1 - keep))
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 120


def test_combinations_of_the_best_of_all_rules(spark):
    import operator
    from itertools import combinations

    from barloom.plans import trade_queries as tq

    t = tq.log(spark, DATA).toPandas()
    won, lost = t["outcome"] == "WIN", t["outcome"] == "LOSS"
    kept = {r.name: {">=": operator.ge, "==": operator.eq, "<=": operator.le}[r.op](t[r.feature].astype(float), r.value) for r in tq.RULES}
    net = lambda k: float(40 * (lost & ~k).sum() - 100 * (won & ~k).sum())
    best = sorted(kept, key=lambda n: (-net(kept[n]), n))[:5]
    want = {}
    for k in (2, 3):
        for names in combinations(best, k):
            both = True
            for n in names:
                both = kept[n] & both
            if net(both) > 0:
                want[" & ".join(names)] = (int(both.sum()), net(both))
    got = {r.rule: (r.n_after, r.net_pips) for r in registry.QUERIES["filter_combos_all"](spark, DATA).collect()}
    assert got == want and len(tq.RULES) > 8


@pytest.mark.parametrize("name", ["permutation_mc", "bootstrap_mc"])
def test_simulations_of_the_whole_log(spark, name):
    from barloom.plans import trade_queries as tq

    log = tq.log(spark, DATA).toPandas().groupby("config_id")["pips_result"]
    got = {r.config_id: r for r in registry.QUERIES[name](spark, DATA).collect()}
    assert got.keys() == set(log.groups)
    for config, pips in log:
        r, spread = got[config], pips.std() * len(pips) ** 0.5
        assert r.n_sims == 1000
        assert abs(r.mean_total - pips.sum()) <= (1e-6 if name == "permutation_mc" else 6 * spread / 1000**0.5)
        assert r.drawdown_p5 < r.drawdown_p95


@pytest.mark.parametrize("replace", [False, True])
@pytest.mark.parametrize("block", [4096, 7])
def test_resample_against_brute_force(spark, replace, block):
    from pyspark.sql import functions as F

    from barloom.operators import strategy

    mix = lambda x, s: strategy.scrambled(x, s)
    data = [("ab"[i % 2] if i % 5 else None, (i * 7919 + i // 50) % 1000, float((i * 37) % 11 - 5)) for i in range(125)]
    t = spark.createDataFrame([*data, ("a", 3, None)], "config_id string, trade long, pips_result double").repartition(3)
    got = {(r.config_id, r.sim): (r.total, r.max_drawdown) for r in strategy.resample(t, ["config_id"], 7, replace=replace, key=F.col("trade"), block=block).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((k, x) for c, k, x in [*data, ("a", 3, 0.0)] if c == g)
        n = -(-len(own) // block)
        blocks = {}
        for k, x in own:
            blocks.setdefault(mix(k, strategy.DEAL) % n, []).append((k, x))
        for sim in range(7):
            path = []
            for b in sorted(blocks, key=lambda b: (mix(b, sim + strategy.PLACE), b)):
                held = blocks[b]
                path += [held[mix(k, sim) % len(held)][1] for k, _ in held] if replace else [x for _, _, x in sorted((mix(k, sim), k, x) for k, x in held)]
            s, peak, fall = 0.0, -math.inf, 0.0
            for x in path:
                s += x
                peak = max(peak, s)
                fall = max(fall, peak - s)
            want[g, sim] = (s, fall)
    assert got == want


def test_simulations_in_buffers():
    """Numbers and orders as by remainders and a stable sort, also at the ends of the range, of equal keys and of keys that agree in their
    upper bits; paths' summaries in stretches; and all of it in less time than the remainders and the sort alone."""
    import time

    import numpy as np
    import pandas as pd

    from barloom.operators import strategy

    p, rng = strategy.PRIME, np.random.default_rng(3)
    ends = np.concatenate([np.arange(40), np.arange(40), p - 1 - np.arange(40)])
    for key in (ends, rng.integers(0, p, 2048), rng.integers(0, p, 9000), rng.integers(0, p, 70_000), np.zeros(300, int), np.array([5])):
        key = np.sort(key.astype(np.int64))
        draws = strategy._Simulator(key, 16)
        for lo, hi in ((0, 16), (16, 21), (999_990, 1_000_003)):
            want = strategy.scrambled(key[None, :], np.arange(lo, hi)[:, None])
            assert (draws.numbers(lo, hi) - 1 == want).all() and (draws.places(lo, hi) == np.argsort(want, axis=1, kind="stable")).all()
    key, x = rng.integers(0, p, 2048), rng.integers(-40, 100, 2048).astype(float)
    for m in (1, 15, 16, 17, 500):
        path = rng.integers(-40, 41, (50, m)).astype(float)
        run = np.cumsum(path, axis=1)
        want = run[:, -1], run.max(axis=1), run.min(axis=1), (np.maximum.accumulate(run, axis=1) - run).max(axis=1)
        assert np.array_equal(strategy._summaries(np.pad(path, ((0, 0), (0, -m % strategy.STRETCH)))), want)
    own = pd.DataFrame({"g": "a", "block": 0, "trade": key, "x": x})
    least = lambda f: min(f() for _ in range(3))

    def by_run() -> float:
        began = time.perf_counter()
        strategy._path_summaries(["g"], 200, False)(own)
        return time.perf_counter() - began

    def by_sorting_places() -> float:
        began = time.perf_counter()
        np.argsort(strategy.scrambled(key[None, :], np.arange(200)[:, None]), axis=1, kind="stable")
        return time.perf_counter() - began

    assert least(by_run) < 0.7 * least(by_sorting_places)


def test_reordering_of_one_block_is_uniform():
    """Every place of a path holds every trade about equally often."""
    import numpy as np

    from barloom.operators import strategy

    keys = np.array([(i * 8 + j) * 48271 % strategy.PRIME for i in range(5) for j in range(4)])
    order = np.argsort(strategy.scrambled(keys[None, :], np.arange(20_000)[:, None]), axis=1)
    counts = np.array([np.bincount(order[:, k], minlength=20) for k in range(20)])
    assert abs(counts / 1000 - 1).max() < 0.15


def test_stream_equals_batch(spark):
    got = registry.QUERIES["stream_bars_4h"](spark, DATA)
    batch = registry.QUERIES["bars_4h"](spark, DATA)
    assert got.count() > 0 and got.join(batch, got.columns, "left_anti").isEmpty()


def test_stream_state_keeps_the_last_bars(spark, tmp_path):
    from datetime import datetime, timedelta

    from barloom.streaming import bars as streaming

    schema = "key string, ts timestamp, close double"
    source = tmp_path / "in"
    for part in (range(0, 4), range(4, 8)):
        spark.createDataFrame([("a", datetime(2024, 1, 1) + timedelta(hours=4 * i), float(i)) for i in part], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        streaming.run_available(streaming.stream_features(stream, 3), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [r.n for r in got] == list(range(1, 9)) and got[-1].ma == 6.0 and got[-1].streak == 7


def test_slow_averages_equal_pandas(spark):
    got = registry.QUERIES["slow_ema_features"](spark, DATA).toPandas().sort_values(["key", "ts"])
    for _, g in got.groupby("key"):
        for n in (21, 50):
            assert (g[f"ema_{n}"] - g["close"].ewm(span=n, adjust=False).mean()).abs().max() < 1e-5
        assert ((g["close"] > g["ema_21"]).map({True: 1, False: -1}) == g["trend"])[(g["close"] - g["ema_21"]).abs() > 1e-5].all()


def test_pair_features_equal_pandas(spark):
    from barloom.operators import crossframe
    from barloom.plans import feature_queries as fq

    raw = crossframe.merged(fq.fast(spark, DATA), fq.slow(spark, DATA)).select("key", "ts", "rsi_value", "d1_rsi_value", "bb_position", "d1_bb_position", "trend_strength", "d1_trend_strength", "atr_pct", "d1_atr_pct").toPandas()
    got = registry.QUERIES["pair_features"](spark, DATA).toPandas()
    raw["ts"] = raw["ts"].astype("datetime64[s]").astype(str).str.replace("T", " ")
    both = raw.merge(got, on=["key", "ts"]).sort_values(["key", "ts"])
    assert len(both) == len(raw) == len(got)
    near = lambda a, b: ((a - b).abs().fillna(0) < 1e-5).all() and (a.isna() == b.isna()).all()
    assert near(both["h4_d1_rsi_diff"], both["rsi_value"] - both["d1_rsi_value"]) and near(both["h4_d1_bb_diff"], both["bb_position"] - both["d1_bb_position"])
    assert near(both["h4_d1_rsi_ratio"], both["rsi_value"] / both["d1_rsi_value"].where(both["d1_rsi_value"] != 0))
    flags = {"d1_strong_trend": both["d1_trend_strength"].abs() > 0.7, "mtf_rsi_both_oversold": (both["rsi_value"] < 35) & (both["d1_rsi_value"] < 35), "mtf_bb_both_low": (both["bb_position"] < 0.2) & (both["d1_bb_position"] < 0.2)}
    flags["mtf_trend_conflict"] = both["trend_strength"] * both["d1_trend_strength"] < 0
    flags["d1_vol_high"] = both["d1_atr_pct"] > both.groupby("key")["d1_atr_pct"].transform(lambda x: x.rolling(20).quantile(0.8))
    for name, want in flags.items():
        assert (both[name] == want.astype(int)).mean() > (0.97 if name == "d1_vol_high" else 0.999999), name
