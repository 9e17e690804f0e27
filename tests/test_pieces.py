"""Pieces of long series against loops: row numbers, windows with a halo, running aggregates."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import pieces
from barloom.functions import windows as w
from barloom.operators import features, metrics, stats, strategy

START = datetime(2024, 1, 1)


def series(n=3000, keys=("a", None)):
    """Rows of two keys with gaps of up to five days, and one day that holds a third of all rows."""
    rng = random.Random(6)
    out = []
    for k in keys:
        at = START
        for i in range(n):
            at += timedelta(seconds=20) if n // 3 < i < 2 * n // 3 else timedelta(minutes=rng.choice([5, 30, 600, 7200 if i % 50 == 0 else 60]))
            out.append((k, at, rng.choice([None, -1.0, 1.0, rng.gauss(0, 1)])))
    return out


@pytest.fixture(scope="module")
def rows():
    return series()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp, x double").repartition(5)


def by_key(found, name):
    out = {}
    for r in sorted(found, key=lambda r: r.ts):
        out.setdefault(r.key, []).append(r[name])
    return out


def loop(rows, step, first=None):
    """step(state, x, i) -> (state, value) along each key."""
    out = {}
    for k in {k for k, *_ in rows}:
        state, own = first, []
        for i, (_, _, x) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            state, value = step(state, x, i)
            own.append(value)
        out[k] = own
    return out


def test_row_numbers(frame, rows):
    got = by_key(pieces.in_pieces(frame, size=100).collect(), "__rank")
    assert got == {k: list(range(3000)) for k in ("a", None)}
    assert {r["__piece"] for r in pieces.in_pieces(frame, size=700).collect()} == {0, 1, 2, 3, 4}


def test_streaks_and_rows_since(frame, rows):
    up = F.col("x") > 0
    got = by_key(pieces.streaks(frame, size=64, run=up).collect(), "run")
    assert got == loop(rows, lambda s, x, i: ((s + 1 if x is not None and x > 0 else 0),) * 2, 0)
    rare = F.col("x") > 2
    got = by_key(pieces.since(frame, size=64, n=rare).collect(), "n")
    assert got == loop(rows, lambda s, x, i: (i if x is not None and x > 2 else s, None if (x is None or x <= 2) and s is None else i - (i if x is not None and x > 2 else s)))


def test_running_aggregates(frame, rows):
    own = pieces.scan(pieces.in_pieces(frame, size=50), total=pieces.total("x"), top=pieces.highest("x"), last=pieces.latest("x"), before=pieces.previous("x")).collect()
    held = lambda s, x, i: ((s or 0.0) + (x or 0.0),) * 2
    for k, values in loop(rows, held).items():
        assert by_key(own, "total")[k] == pytest.approx(values)
    assert by_key(own, "top") == loop(rows, lambda s, x, i: ((s if x is None else x if s is None else max(s, x)),) * 2)
    assert by_key(own, "last") == loop(rows, lambda s, x, i: ((s if x is None else x),) * 2)
    assert by_key(own, "before") == loop(rows, lambda s, x, i: (x, s))


def test_windows_with_a_halo_count_rows(frame):
    means = lambda df: df.withColumns({"back": w.mean("x", 30), "lag": w.lag("x", 7), "ahead": F.sum("x").over(w.forward(20))})
    whole, cut = means(frame), pieces.by_pieces(frame, means, back=30, ahead=20, size=90)
    assert cut.columns == whole.columns and cut.count() == 6000
    for name in ("back", "lag", "ahead"):
        a, b = by_key(whole.collect(), name), by_key(cut.collect(), name)
        for k in a:
            assert [x is None for x in a[k]] == [x is None for x in b[k]]
            assert [x for x in b[k] if x is not None] == pytest.approx([x for x in a[k] if x is not None])
    with pytest.raises(ValueError):
        pieces.by_pieces(frame, means, back=30, size=20)


def test_features_in_pieces_equal_whole_keys(spark):
    rng = random.Random(9)
    price, data = 100.0, []
    for i in range(1500):
        price += rng.gauss(0, 1)
        data.append(("k", START + timedelta(hours=4 * i + (300 if i > 700 else 0)), price, price + 1, price - 1, price + rng.gauss(0, 0.5), 100 + i % 7))
    bars = spark.createDataFrame(data, "key string, ts timestamp, open double, high double, low double, close double, volume long")
    names = ("zscores", "run_streaks", "streaks", "crossovers", "exporter")
    a, b = (features.add(bars, *names, size=size).orderBy("ts").collect() for size in (None, 900))
    assert len(a) == len(b) == 1500
    for x, y in zip(a, b):
        for name in set(x.asDict()):
            assert x[name] == (pytest.approx(y[name], abs=1e-9) if isinstance(x[name], float) and y[name] is not None else y[name]), name


def test_equity_and_drawdown_of_one_long_log(spark):
    rng = random.Random(4)
    data = [("c", START + timedelta(minutes=7 * i + 3000 * (i // 500)), i, float(rng.choice([100, -40, 30]))) for i in range(3000)]
    log = spark.createDataFrame(data, "config_id string, ts timestamp, id long, pips_result double").repartition(4)
    got = {r.id: r for r in strategy.equity(log, ["config_id"], ["ts", "id"], size=128).collect()}
    level, peak, s, top, fall = 1.0, 1.0, 0.0, -math.inf, 0.0
    for _, _, i, x in data:
        level *= 1 + x / 50 * 0.01
        peak = max(peak, level)
        assert got[i].equity == pytest.approx(level) and got[i].drawdown_percent == pytest.approx((1 - level / peak) * 100, abs=1e-7)
        s += x
        top = max(top, s)
        fall = max(fall, top - s)
    assert [r.max_drawdown for r in metrics.drawdown(log, ["config_id"], ["ts", "id"]).collect()] == [fall]


def test_regimes_of_a_long_series(spark):
    rng = random.Random(1)
    ranks, at = [], 0.5
    for _ in range(3000):
        at = rng.random() if rng.random() < 0.2 else at
        ranks.append(None if rng.random() < 0.1 else at)
    df = spark.createDataFrame([("k", START + timedelta(hours=i), r) for i, r in enumerate(ranks)], "key string, ts timestamp, rank double")
    got = [(r.regime, r.cluster) for r in stats.regimes(df, "rank").orderBy("ts").collect()]
    name = lambda r: None if r is None else "low" if r <= 0.25 else "normal" if r <= 0.5 else "elevated" if r <= 0.75 else "high"
    before, n, want = None, 0, []
    for r in ranks:
        n += name(r) != before
        before = name(r)
        want.append((before, n))
    assert got == want


def test_nothing_in_pieces(spark):
    empty = spark.createDataFrame([], "key string, ts timestamp, x double")
    assert pieces.in_pieces(empty).isEmpty() and pieces.streaks(empty, a=F.col("x") > 0).isEmpty()


@pytest.mark.parametrize("records", [7, 10_000])
def test_barriers_by_a_loop_over_batches(spark, records):
    """Keys that end inside a batch, or go on over many of them; a price that is missing; fewer bars than the horizon."""
    from barloom.operators import labels

    rng = random.Random(records)
    data = []
    for k, n in (("a", 150), ("b", 3), (None, 40), ("d", 1)):
        price = 100.0
        for i in range(n):
            price += rng.gauss(0, 2)
            data.append((k, START + timedelta(hours=i), price + rng.random() * 3 if i != 20 else None, price - rng.random() * 3, price))
    bars = spark.createDataFrame(data, "key string, ts timestamp, high double, low double, close double").repartition(3)
    configs = labels.grid([2, 5], [3], [4, 11])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        for tie in ("sl", "tp"):
            got = {(r.key, r.ts, r.tp, r.hold): (r.label, r.reason, r.exit_bar, r.pips) for r in labels.barrier_grid(bars, configs, tie=tie, timeout="mark").collect()}
            assert len(got) == len(data) * 4
            for k in ("a", "b", None, "d"):
                own = [x for x in data if x[0] == k]
                for i, (_, ts, _, _, close) in enumerate(own):
                    for tp, sl, hold in configs:
                        want = (0, "insufficient_data", None, None)
                        if i + hold < len(own):
                            mark = close - own[i + hold][4]
                            want = (int(mark > 0), "timeout", hold, pytest.approx(mark))
                            for j in range(1, hold + 1):
                                _, _, high, low, _ = own[i + j]
                                down, up = low <= close - tp, high is not None and high >= close + sl
                                if down and (not up or tie == "tp"):
                                    want = (1, "tp_hit", j, tp)
                                elif up:
                                    want = (0, "sl_hit", j, -sl)
                                if down or up:
                                    break
                        assert got[k, ts, tp, hold] == want, (k, i, tp, hold, tie)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
