"""Bars, joins, windows, labels and analytics against pandas, loops and planted patterns."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.functions.distributions import chi_square_tail, t_two_sided
from barloom.operators import asof, chains, features, labels, metrics, quality, runs, stats, strategy, trades
from barloom.sources import bars, sinks


def frame(n=160, keys=("a", "b"), seed=3, hours=4):
    rng = np.random.default_rng(seed)
    out = []
    for k in keys:
        close = 100 + rng.normal(0, 1, n).cumsum()
        open_ = np.concatenate(([close[0]], close[:-1])) + rng.normal(0, 0.2, n)
        high, low = np.maximum(open_, close) + rng.random(n), np.minimum(open_, close) - rng.random(n)
        ts = [datetime(2024, 1, 1) + timedelta(hours=hours * i) for i in range(n)]
        out.append(pd.DataFrame({"key": k, "ts": ts, "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(5, 50, n)}))
    return pd.concat(out, ignore_index=True)


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def collected(df, *columns):
    return df.select("key", "ts", *columns).toPandas().sort_values(["key", "ts"]).reset_index(drop=True)


def test_asof_table(spark):
    fast = spark.createDataFrame([("a", datetime(2024, 1, 15) + timedelta(hours=4 * i)) for i in range(18)], "key string, ts timestamp_ntz")
    slow = spark.createDataFrame([("a", datetime(2024, 1, d), float(d)) for d in range(13, 18)], "key string, ts timestamp_ntz, close double")
    got = collected(asof.previous_day(fast, slow), "d1_close")
    assert got["d1_close"].tolist() == [14.0] * 6 + [15.0] * 6 + [16.0] * 6
    assert asof.leaks(asof.previous_day(fast, slow)).isEmpty()
    dense = collected(asof.previous_day_dense(fast, slow), "d1_close")
    assert dense["d1_close"].tolist() == got["d1_close"].tolist()


def test_asof_gaps_keys_and_duplicates(spark):
    fast = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 9)), ("a", datetime(2024, 1, 9)), ("b", datetime(2024, 1, 9))], "key string, ts timestamp_ntz")
    slow = spark.createDataFrame([("a", datetime(2024, 1, 2), 2.0), ("a", datetime(2024, 1, 9), 9.0)], "key string, ts timestamp_ntz, close double")
    got = collected(asof.previous_day(fast, slow), "d1_close")
    assert got["d1_close"].fillna(-1).tolist() == [-1, 2, 2, -1]


def test_windows_match_pandas(spark):
    pdf = frame()
    got = spark_frame(spark, pdf).withColumns({"z": w.zscore("close", 20), "r": w.percent_rank("close", 20), "s": w.skew("close", 20), "k": w.kurt("close", 20), "q": w.quantile("close", 0.2, 20)})
    got = collected(got, "z", "r", "s", "k", "q")
    g = pdf.sort_values(["key", "ts"]).groupby("key")["close"]
    roll = lambda f: g.transform(lambda x: f(x.rolling(20))).reset_index(drop=True)
    close = pdf.sort_values(["key", "ts"])["close"].reset_index(drop=True)
    z = ((close - roll(lambda r: r.mean())) / roll(lambda r: r.std())).fillna(0)
    for name, want in {"z": z, "r": roll(lambda r: r.rank(pct=True)), "s": roll(lambda r: r.skew()), "k": roll(lambda r: r.kurt()), "q": roll(lambda r: r.quantile(0.2))}.items():
        np.testing.assert_allclose(got[name].astype(float), want, atol=1e-6, equal_nan=True, err_msg=name)


def test_ema_matches_pandas_over_chunks(spark):
    pdf = frame(n=300)
    got = collected(w.emas(spark_frame(spark, pdf), {"e21": ("close", 21), "e200": ("close", 200)}, chunk=64), "e21", "e200")
    for span in (21, 200):
        want = pdf.groupby("key")["close"].transform(lambda x, s=span: x.ewm(span=s, adjust=False).mean())
        np.testing.assert_allclose(got[f"e{span}"], want, rtol=1e-9)


def test_streaks(spark):
    pdf = frame()
    got = collected(features.add(spark_frame(spark, pdf), "streaks"), "consecutive_bullish")
    want, run = [], 0
    for k, o, c in pdf[["key", "open", "close"]].itertuples(index=False):
        run = 0 if want and len(want) % 160 == 0 and k == "b" and len(want) == 160 else run
        run = run + 1 if c > o else 0
        want.append(run)
    assert got["consecutive_bullish"].tolist() == want


def test_chunked_equals_plain(spark):
    df = spark_frame(spark, frame())
    plain = collected(df.withColumn("m", w.mean("close", 20)), "m")
    chunked = collected(w.in_chunks(df, lambda d: d.withColumn("m", w.mean("close", 20)), 5 * 86_400, 5 * 86_400), "m")
    np.testing.assert_allclose(plain["m"], chunked["m"], equal_nan=True)


@pytest.mark.parametrize("direction", ["short", "long"])
@pytest.mark.parametrize("tie", ["sl", "tp"])
def test_barrier_matches_loop(spark, direction, tie):
    pdf = frame(n=90)
    tp, sl, hold = 1.5, 1.0, 8
    got = collected(labels.barrier(spark_frame(spark, pdf), tp, sl, hold, direction=direction, tie=tie), "label", "reason", "exit_bar")
    grid = labels.barrier_grid(spark_frame(spark, pdf), [(tp, sl, hold), (3.0, 2.0, 5)], direction=direction, tie=tie)
    again = collected(grid.filter("tp = 1.5"), "label", "reason", "exit_bar")
    want = []
    for _, g in pdf.groupby("key"):
        h, lo, c = g["high"].to_numpy(), g["low"].to_numpy(), g["close"].to_numpy()
        for i in range(len(g)):
            if i + hold >= len(g):
                want.append("insufficient_data")
                continue
            reason = "timeout"
            for j in range(i + 1, i + hold + 1):
                up, down = h[j] >= c[i] + (sl if direction == "short" else tp), lo[j] <= c[i] - (tp if direction == "short" else sl)
                hit_tp, hit_sl = (down, up) if direction == "short" else (up, down)
                if hit_tp and (tie == "tp" or not hit_sl):
                    reason = "tp_hit"
                elif hit_sl:
                    reason = "sl_hit"
                if reason != "timeout":
                    break
            want.append(reason)
    assert got["reason"].tolist() == want and again["reason"].tolist() == want
    assert set(want) >= {"tp_hit", "sl_hit", "insufficient_data"}


def test_non_overlapping(spark):
    rows = spark.createDataFrame([("a", "x", 1, 5), ("a", "x", 3, 4), ("a", "x", 5, 6), ("a", "x", 6, 9), ("b", "x", 2, 2)], "key string, config string, at int, exit_at int")
    assert sorted((r.key, r.at) for r in chains.non_overlapping(rows).collect()) == [("a", 1), ("a", 6), ("b", 2)]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "b.csv").write_text(" Timestamp ;Open;HIGH;low;close;volume\n2024.01.02 04:00:00;1;2;0.5;1.5;7\n2024-01-02 08:00:00;1;2;0.5;1.5;8\n")
    df = bars.read_csv(spark, str(tmp_path / "b.csv"), key="x")
    assert [str(r.ts) for r in df.orderBy("ts").collect()] == ["2024-01-02 04:00:00", "2024-01-02 08:00:00"]


def planted(spark, n=500):
    rng = np.random.default_rng(5)
    asian = rng.random(n) < 0.25
    won = np.where(asian, rng.random(n) < 0.05, rng.random(n) < 0.65)
    rows = [(f"c{i % 3}", i % 5 + 1, int(a), int(not a), "WIN" if x else "LOSS", 100.0 if x else -30.0, 0.5 + (i % 40) / 100, i) for i, (a, x) in enumerate(zip(asian, won))]
    return spark.createDataFrame(rows, "config_id string, fold int, is_asian_session int, is_london_session int, outcome string, pips_result double, model_probability double, i int").withColumns({"is_ny_session": F.lit(0), "is_overlap_session": F.lit(0)})


def test_planted_session_and_rule(spark):
    t = planted(spark)
    bad = {r.session for r in trades.sessions(t).filter("problematic").collect()}
    assert bad == {"Asian"}
    rules = trades.candidate_rules(t.columns)
    best = trades.verdicts(trades.impact(t, {r.name: [r] for r in rules}, 100, 30), 5).collect()
    assert best[0].rule in ("is_asian_session == 0", "is_london_session == 1") and best[0].net_pips > 0
    for r in best:
        assert r.n_after + r.wins_removed + r.losses_removed == r.n_before


def test_drawdown_buckets(spark):
    t = planted(spark)
    whole = {r.config_id: r.max_drawdown for r in metrics.drawdown(t, ["config_id"], ["i"]).collect()}
    parts = {r.config_id: r.max_drawdown for r in metrics.drawdown(t, ["config_id"], ["i"], bucket=F.floor(F.col("i") / 37)).collect()}
    pdf = t.toPandas()
    for k, g in pdf.sort_values("i").groupby("config_id"):
        s = g["pips_result"].cumsum()
        assert whole[k] == parts[k] == (s.cummax() - s).max()


def test_acceptance(spark):
    rows = [(100.0, 30.0, 0.30, 0.03, 5.0, 200, 5), (100.0, 30.0, 0.20, 0.02, -2.0, 200, 5), (100.0, 30.0, 0.55, 0.22, 5.0, 200, 5), (100.0, 30.0, 0.55, 0.05, 5.0, 20, 5)]
    df = spark.createDataFrame(rows, "tp double, sl double, precision_mean double, precision_std double, ev_mean double, total_trades int, n_folds int")
    assert [sorted(r.reasons) for r in metrics.acceptance(df).collect()] == [[], ["ev", "precision"], ["cv"], ["trades"]]


def test_ledger_is_latest_wins_and_resumes(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.append_ledger(spark.createDataFrame([(50, 30, 12, 1.0)], "tp_pips int, sl_pips int, max_holding_bars int, ev double"), path)
    sinks.append_ledger(spark.createDataFrame([(50, 30, 12, 2.0)], "tp_pips int, sl_pips int, max_holding_bars int, ev double"), path)
    assert [r.ev for r in bars.read_ledger(spark, path).collect()] == [2.0]
    grid = runs.parameter_grid(spark, (50, 100, 50), (30, 30, 10), (12, 24, 12))
    done = spark.createDataFrame([(50, 30, 12)], "tp int, sl int, hold int")
    assert runs.pending(grid, done).count() == 3


def test_trade_log_schema(spark, tmp_path):
    sinks.append_trades(planted(spark, 50).withColumn("unknown", F.lit(1)), str(tmp_path / "t"))
    back = bars.read_trades(spark, str(tmp_path / "t"), "c1")
    assert "unknown" not in back.columns and "adx" in back.columns and back.filter("config_id <> 'c1'").isEmpty()


def test_tail_probabilities():
    assert abs(t_two_sided(2.0, 10) - 0.07338803) < 1e-6
    assert abs(t_two_sided(1.96, 1e6) - 0.05) < 1e-4
    assert abs(chi_square_tail(3.841459, 1) - 0.05) < 1e-6


def test_feature_signal_is_kept(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(500) < 0.6).astype(int)
    pdf = pd.DataFrame({"label": y, "sig": np.where(y == 1, 1.5, 0.0) + rng.normal(0, 0.5, 500), "noise": rng.normal(0, 1, 500)})
    got = {r.feature: r.verdict for r in stats.prefilter(spark.createDataFrame(pdf), ["sig", "noise"]).collect()}
    assert got["sig"] == "KEEP" and got["noise"] != "KEEP"


def test_take_profit_choice(spark):
    df = spark.createDataFrame([(40.0, 0.72, 0.48, 0.29, 0.18)], "sl double, p30 double, p50 double, p80 double, p100 double")
    r = strategy.best_take_profit(df, {k: F.col(f"p{k}") for k in (30, 50, 80, 100)}, [30, 50, 80, 100]).first()
    assert r.action == "TRADE" and r.optimal_tp == 50 and abs(r.tp_ev - 3.2) < 1e-9


def test_resampling_keeps_totals(spark):
    t = planted(spark, 60)
    paths = strategy.resample(t, ["config_id"], 5, identity=["i"]).toPandas()
    assert paths.groupby("config_id")["total"].nunique().eq(1).all()


def test_quality_report(spark):
    pdf = frame(n=20)
    pdf.loc[3, "high"] = pdf.loc[3, "low"] - 1
    assert quality.ohlc_faults(spark_frame(spark, pdf)).count() == 1
    assert quality.duplicates(spark_frame(spark, pd.concat([pdf, pdf.head(1)]))).count() == 1


def test_empty_frames(spark):
    empty = spark_frame(spark, frame()).limit(0)
    assert features.add(empty, "base", "adx", "streaks").isEmpty()
    assert labels.barrier(empty, 1, 1, 3).isEmpty()
    assert asof.previous_day(empty, empty).isEmpty()


def test_direction_of_a_price_at_its_mean(spark):
    """A close that is exactly the mean of its window has no direction, whatever the mean's sum is rounded to."""
    from datetime import datetime, timedelta
    from fractions import Fraction

    from barloom.operators import crossframe, features

    rows, want = [], {}
    for k in range(40):
        closes = [Fraction((i * i * 7919 + k * 104_729) % 9973, 100) for i in range(19)]
        closes.append(sum(closes) / 19)  # the mean of all 20
        closes[-1] += Fraction(k % 3 - 1, 10**6) if k % 2 else 0
        want[str(k)] = float((closes[-1] > sum(closes) / 20) - (closes[-1] < sum(closes) / 20))
        rows += [(str(k), datetime(2024, 1, 1) + timedelta(days=i), *[float(x)] * 4, 1) for i, x in enumerate(closes)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    last = datetime(2024, 1, 20)
    fast = {r.key: r.trend_direction_h4 for r in features.add(df, "adx").filter(f"ts = timestamp_ntz'{last}'").collect()}
    slow = {r.key: r.trend_direction for r in crossframe.slow_features(df).filter(f"ts = timestamp_ntz'{last}'").collect()}
    assert fast == slow == want and {-1.0, 0.0, 1.0} == set(want.values())


def test_signals_sort_only_what_they_read(spark):
    """The rows that the join of frames packs and sorts hold the columns that are read, and the signals are those of all columns."""
    from barloom.operators import crossframe, signals
    from barloom.plans import feature_queries as fq
    from barloom.plans import registry

    data = "/root/testdata/sf0.001"
    got = registry.QUERIES["signals_31"](spark, data)
    both = crossframe.joined(fq.fast(spark, data), fq.slow(spark, data), signals.FAST, signals.SLOW)
    assert both.columns == ["key", "ts", *signals.FAST, "d1_ts", *(f"d1_{x}" for x in signals.SLOW)]
    every = fq.shown(signals.evaluate(signals.prepare(crossframe.merged(fq.fast(spark, data), fq.slow(spark, data))), signals.single_frame() | signals.two_frames()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
