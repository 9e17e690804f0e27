"""Trades that don't overlap, over pieces, against loops."""

import random
from collections import Counter

import pytest

from barloom.operators import chains

SCHEMA = "key string, config string, at int, exit_at int, note string"


def entries(n=400, keys=("a", "b", None)):
    rng = random.Random(12)
    out = []
    for k in keys:
        for config in ("x", "y"):
            for i in range(n):
                at = rng.randrange(900)
                out.append((k, config, at, at + rng.choice([0, 1, 2, 5, 17, 40]), f"n{i % 3}"))
    return out + [("a", "x", None, 4, ""), ("a", "x", 3, None, "")]


def greedy(rows, most=False):
    own = sorted((at, out) for _, _, at, out, _ in rows if at is not None and out is not None)
    taken, free = [], -1
    if most:
        own = sorted((out, at) for at, out in own)
    for x, y in own:
        at, out = (y, x) if most else (x, y)
        if at > free:
            taken.append((at, out))
            free = out
    return taken


@pytest.mark.parametrize("size", [7, 64, 4096])
@pytest.mark.parametrize("most", [False, True])
def test_chains_against_the_greedy_loop(spark, size, most):
    data = entries()
    got = chains.non_overlapping(spark.createDataFrame(data, SCHEMA).repartition(4), size=size, most=most)
    assert got.columns == ["key", "config", "at", "exit_at", "note"]
    found = {}
    for r in got.collect():
        found.setdefault((r.key, r.config), []).append((r["at"], r.exit_at))
    for k in ("a", "b", None):
        for config in ("x", "y"):
            want = greedy([r for r in data if r[:2] == (k, config)], most)
            if most:  # as many, none overlapping
                own = sorted(found[k, config])
                assert len(own) == len(want) and all(x[1] < y[0] for x, y in zip(own, own[1:]))
            else:
                assert sorted(found[k, config]) == want


def test_equal_entries_and_nothing(spark):
    data = [("a", "x", 5, 9, "q"), ("a", "x", 5, 6, "p"), ("a", "x", 5, 6, "p"), ("a", "x", 7, 8, "r"), ("a", "x", 8, 8, "s"), ("a", "x", 9, 3, "t")]
    got = chains.non_overlapping(spark.createDataFrame(data, SCHEMA))
    assert sorted((r["at"], r.exit_at, r.note) for r in got.collect()) == [(5, 6, "p"), (7, 8, "r"), (9, 3, "t")]
    assert chains.non_overlapping(spark.createDataFrame([], SCHEMA)).isEmpty()


@pytest.mark.parametrize("size", [11, 4096])
def test_random_trades_are_as_many_as_asked(spark, size):
    data = [r for r in entries() if r[1] == "x"]
    most = {k: len(greedy([r for r in data if r[0] == k], True)) for k in ("a", "b", None)}
    counts = [("a", 20), ("b", most["b"]), (None, most[None] + 50), ("c", 3)]
    got = chains.random_trades(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(counts, "key string, n long"), seed=5, size=size).collect()
    assert Counter(r.key for r in got) == {"a": 20, "b": most["b"], None: most[None]}
    for k in ("a", "b", None):
        own = sorted((r["at"], r.exit_at) for r in got if r.key == k)
        assert all(x[1] < y[0] for x, y in zip(own, own[1:]))
    assert {tuple(r) for r in got} <= set(data)
    early = [r["at"] for r in got if r.key == "a"]
    assert max(early) > 600 and min(early) < 300  # from the whole series, not only its start
