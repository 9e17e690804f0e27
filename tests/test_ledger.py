"""Keyed tables that several runs write to: nothing is lost, the last write counts, compaction changes nothing."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from barloom.sources.ledger import Ledger, Manifest, fold_results

SCHEMA = "k string, n int, x double"


@pytest.fixture
def table(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/t", ["k", "n"], SCHEMA)


def rows(spark, *data):
    return spark.createDataFrame([*data], SCHEMA)


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_last_write_counts(spark, table):
    assert held(table) == []
    table.upsert(rows(spark, ("a", 1, 1.0), ("b", 1, 1.0), (None, None, 5.0)))
    table.upsert(rows(spark, ("a", 1, 2.0), ("c", 2, None)))
    assert held(table) == [("a", 1, 2.0), ("b", 1, 1.0), ("c", 2, None), (None, None, 5.0)]
    table.upsert(spark.createDataFrame([("b", 1, "other")], "k string, n long, more string"))  # unknown columns go, missing ones are null
    assert ("b", 1, None) in held(table)


def test_two_writers_at_once_lose_nothing(spark, table):
    parts = [rows(spark, *((f"w{w}", i, float(w)) for i in range(5))) for w in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(table.upsert, parts))
    assert len(held(table)) == 30 and len(table.manifests()) == 6


def test_equal_sequences_settle_by_writer(spark, table):
    """Both writers saw the same manifests; whichever is read first, the higher id counts."""
    for writer, x in (("b", 2.0), ("a", 1.0)):
        folder = f"data/{writer}"
        table._shaped(rows(spark, ("k", 1, x))).selectExpr("*", "cast(null as long) __s", "cast(null as string) __w").write.parquet(f"{table.path}/{folder}")
        table._commit(Manifest(1, writer, folder))
    assert held(table) == [("k", 1, 2.0)]


def test_compaction_keeps_what_counts(spark, table):
    table.upsert(rows(spark, ("a", 1, 1.0), ("b", 1, 1.0)), "w1")
    table.upsert(rows(spark, ("b", 1, 2.0)), "w2")
    # Another writer saw one manifest only and comes with sequence 2 after the compaction.
    table.compact("c1")
    table._shaped(rows(spark, ("a", 1, 9.0), ("b", 1, 9.0))).selectExpr("*", "cast(null as long) __s", "cast(null as string) __w").write.parquet(f"{table.path}/data/late")
    table._commit(Manifest(2, "w1b", "data/late"))
    assert held(table) == [("a", 1, 9.0), ("b", 1, 2.0)]  # (2, w1b) is after (1, w1) and before (2, w2)
    before = held(table)
    table.compact("c2")
    assert held(table) == before and len(table.manifests()) == 1 and table.compact() is None
    table.upsert(rows(spark, ("a", 1, 10.0)))
    table.compact()
    assert held(table) == [("a", 1, 10.0), ("b", 1, 2.0)]


def test_writes_without_manifest_are_not_seen(spark, table):
    rows(spark, ("a", 1, 1.0)).write.parquet(f"{table.path}/data/lost")
    assert held(table) == []


def test_fold_results_have_their_schema(spark, tmp_path):
    table = fold_results(spark, f"file://{tmp_path}/folds")
    table.upsert(spark.createDataFrame([("c", 1, 0.5, 12)], "config_id string, fold int, precision double, n_trades int"))
    got = table.read().first()
    assert (got.config_id, got.fold, got.precision, got.n_trades, got.recall) == ("c", 1, 0.5, 12, None)
    assert table.read().columns == ["config_id", "fold", "precision", "recall", "f1", "ev", "auc_pr", "threshold", "n_trades", "train_start", "train_end", "test_start", "test_end"]
