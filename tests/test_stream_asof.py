"""The as-of join on streams: equal to the batch join, late bars, silent keys."""

from datetime import datetime, timedelta

import pytest

from barloom.operators import asof as batch
from barloom.streaming import asof
from barloom.streaming.bars import run_available

DAY = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(asof.PROVIDER)
    spark.conf.set(asof.PROVIDER, asof.ROCKS)
    yield spark
    spark.conf.set(asof.PROVIDER, before)


def fast(key, hours, x=1.0):
    return [(key, asof.FAST, DAY + timedelta(hours=h), x * h, 1) for h in hours]


def slow(key, days):
    return [(key, asof.SLOW, DAY + timedelta(days=d), 100.0 * d, 10 + d) for d in days]


def played(spark, folder, files, **options):
    """Write file after file and run the stream after each one."""
    found = []
    for rows in files:
        spark.createDataFrame(rows, asof.BAR).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(asof.BAR).parquet(f"{folder}/in")
        run_available(asof.stream_previous_day(stream, **options), f"{folder}/out", f"{folder}/state")
    for r in spark.read.parquet(f"{folder}/out").collect():
        found.append((r.key, r.ts, r.close, r.d1_ts, r.d1_close, r.d1_volume, r.ma))
    return sorted(found, key=str)


END = [(None, asof.CLOCK, DAY + timedelta(days=400), None, None)]


def test_equal_to_the_batch_join(rocks, tmp_path):
    bars = fast("a", range(0, 240, 4)) + fast("b", range(5, 240, 7)) + slow("a", range(10)) + slow("b", [0, 3, 4, 8])
    parts = [[r for r in bars if lo <= (r[2] - DAY).total_seconds() / 3600 < lo + 80] for lo in (0, 80, 160)]
    got = played(rocks, tmp_path, [*parts, END, END], n=3)
    table = rocks.createDataFrame(bars, asof.BAR)
    sides = [table.filter(f"side = {s}").select("key", "ts", "close", "volume") for s in (asof.FAST, asof.SLOW)]
    want = {(r.key, r.ts): (r.close, r.d1_ts, r.d1_close, r.d1_volume) for r in batch.previous_day(*sides).collect()}
    assert {(r[0], r[1]): r[2:6] for r in got} == want
    means = [r[6] for r in sorted((r for r in got if r[0] == "a"), key=lambda r: r[1])]
    assert means[:2] == [None, None] and means[2:] == [4.0 * i - 4 for i in range(2, 60)]


def test_late_bars_and_silent_keys(rocks, tmp_path):
    first = slow("a", [0, 1]) + fast("a", [26, 50])
    late = fast("a", [30], 2.0) + fast("b", [100]) + slow("b", [3])  # the bar of hour 30 comes when the watermark is past it
    again = fast("a", [24 * 60]) + slow("b", [60])
    got = played(rocks, tmp_path, [first, fast("a", [70]), late, [(None, asof.CLOCK, DAY + timedelta(days=40), None, None)], [(None, asof.CLOCK, DAY + timedelta(days=41), None, None)], again, END, END], n=1, silent=timedelta(days=5))
    hours = [(r[0], int((r[1] - DAY).total_seconds() // 3600), r[4]) for r in got]
    # Key a was silent for over five days: its slow bars are gone, and the bar of day 60 finds none.
    assert sorted(hours, key=str) == sorted([("a", 26, 0.0), ("a", 50, 100.0), ("a", 70, 100.0), ("b", 100, 300.0), ("a", 1440, None)], key=str)
