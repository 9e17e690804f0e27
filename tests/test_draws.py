"""Exact quantiles, quota samples and signatures of rules against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import stats, trades


def test_exact_quantiles(spark):
    rng = random.Random(2)
    data = [(rng.gauss(0, 1), float(rng.choice([1, 1, 1, 2])), None if rng.random() < 0.3 else rng.random() ** 4, None, i) for i in range(4001)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e int").repartition(7)
    at = [0.0, 0.0001, 0.25, 0.5, 0.7501, 0.9, 1.0]
    for accuracy in (10_000, 20):  # also where the sketch is coarse
        got = {(r.feature, r.q): r.value for r in stats.exact_quantiles(df, ["a", "b", "c", "d", "e"], at, accuracy).collect()}
        want = {}
        for k, name in enumerate("abcde"):
            own = [r[k] for r in data if r[k] is not None]
            want |= {(name, q): float(np.quantile(own, q)) for q in at if own}
        assert got.keys() == want.keys()
        for key, value in want.items():
            assert got[key] == pytest.approx(value, abs=1e-12), key


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert stats.exact_quantiles(df, ["a"], [0.5]).isEmpty() and stats.exact_quantiles(df.limit(0), ["a"], [0.5]).isEmpty()


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_quota_sample_against_a_sort(spark, buckets):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    data = [("k", start + timedelta(hours=i), rng.choice(["x", "y", None]), rng.randrange(50), int(rng.random() < 0.3)) for i in range(600)]
    df = spark.createDataFrame(data, "key string, ts timestamp, s string, d int, hit int").repartition(3)
    got = stats.matched_baseline(df.select("key", "ts", "s", "d"), df.filter("hit = 1"), "s", F.col("d"), 50, buckets).collect()
    want = []
    for s in ("x", "y"):
        quota = sum(r[4] for r in data if r[2] == s)
        want += sorted((d, ts) for _, ts, name, d, hit in data if name == s and not hit)[:quota]
    assert sorted((r.d, r.ts) for r in got) == sorted(want)


def test_signatures_of_rules_in_several_words(spark):
    rng = random.Random(4)
    data = [(rng.random() if i % 9 else None, rng.randrange(4), rng.choice(["WIN", "LOSS", "OPEN"]), float(rng.randrange(-50, 90)), i % 2) for i in range(500)]
    log = spark.createDataFrame(data, "p double, n int, outcome string, pips_result double, fold int")
    one = [trades.Rule("p", ">=", x / 10) for x in range(9)] + [trades.Rule("n", "==", x) for x in range(4)] + [trades.Rule("absent", ">=", 1)]
    rules = {r.name: [r] for r in one} | {"both": [one[5], one[10]], "same": [one[5], one[5]], "three": [one[2], one[11], one[13]]}
    assert len(trades.words_of(rules)) > 1
    test = lambda r, row: r.feature == "absent" or (row[0] is not None and row[0] >= r.value if r.feature == "p" else row[1] == r.value)
    got = {(r.fold, r.rule): r for r in trades.impact(log, rules, 100, 40, ["fold"]).collect()}
    assert len(got) == 2 * len(rules)
    for (fold, name), r in got.items():
        own = [x for x in data if x[4] == fold]
        kept = [x for x in own if all(test(rule, x) for rule in rules[name])]
        count = lambda rows, what: sum(x[2] == what for x in rows)
        assert (r.n_before, r.wins_before, r.losses_before, r.pips_before) == (len(own), count(own, "WIN"), count(own, "LOSS"), sum(x[3] for x in own))
        assert (r.n_after, r.wins_after, r.losses_after, r.pips_after) == (len(kept), count(kept, "WIN"), count(kept, "LOSS"), sum(x[3] for x in kept))


def test_trades_kept_by_each_rule(spark):
    """As many as the impact of each rule alone, nulls, repeated rules and unknown columns too, from one scan that copies no trade."""
    from barloom.operators import trades
    from barloom.operators.trades import Rule

    rows = [(float(i % 13) if i % 7 else None, i % 3, "WIN" if i % 2 else "LOSS", 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b int, outcome string, pips_result double").repartition(3)
    rules = [Rule("a", op, v) for v in (0.0, 4.0, 12.0, 40.0) for op in (">=", "<", "==")] + [Rule("b", "==", 1), Rule("c", ">=", 1), Rule("b", "==", 1)]
    want = {int(r.rule): r.n_after for r in trades.impact(df, {str(i): [r] for i, r in enumerate(rules)}, 100, 40).collect()}
    got = trades.kept(df, rules)
    assert {r.rule: r.n for r in got.collect()} == want and len(want) == len(rules)
    assert trades.kept(df.limit(0), rules).filter("n = 0").count() == len(rules)
