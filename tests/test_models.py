"""Jobs over models and grids on small tables: each function's result against what its rows imply."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, models, stats
from barloom.sources import ledger


@pytest.fixture(scope="module")
def rows(spark):
    """a tells the label but for every tenth row, b doesn't; fold 1 and 2 with their parts."""
    data = []
    for i in range(240):
        label = (i * 7) % 2
        data.append(("k", i, 1 + (i // 8) % 2, ("train", "train", "cal", "test")[(i // 2) % 4], float(label if i % 10 else 1 - label), float((i * 37) % 11), label, float(label * 3 + 1)))
    df = spark.createDataFrame(data, "key string, ts long, fold int, part string, a double, b double, label int, value double")
    return df.coalesce(1).cache()


FEATURES = ["a", "b"]


def test_search_finds_the_best_first(rows):
    split = [(rows.filter("part = 'train'"), rows.filter("part = 'test'"))]
    found = models.search(split, FEATURES, {"maxIter": [1], "maxDepth": [0, 1]})
    assert [p["maxDepth"] for p, _ in found] == [1, 0] and found[0][1] > 0.8 > found[1][1]
    assert len(models.search(split, FEATURES, {"maxIter": [1], "maxDepth": [0, 1]}, n=1)) == 1


def test_elimination_keeps_what_tells(rows):
    split = [(rows.filter("part = 'train'"), rows.filter("part = 'test'"))]
    chosen, scores = models.eliminate_cv(split, FEATURES, [1], maxIter=1, maxDepth=1)
    assert chosen == ["a"] and scores[1] > 0.8


def test_heads_and_ranks(rows):
    heads = models.heads(rows, FEATURES, ["label"], ["value"])
    assert set(heads) == {"label", "value"}
    right = models.predict(heads["label"], rows, FEATURES)
    value = heads["value"].transform(models.as_doubles(rows, FEATURES)).groupBy("a").agg(F.avg("prediction").alias("m")).collect()
    by = {r.a: r.m for r in value}
    assert by[1.0] > by[0.0] + 1.5
    wrong = right.withColumn("model_probability", 1 - F.col("model_probability")).filter("ts < 200")
    ranked = {r.model: r for r in models.rank_models({"right": right, "wrong": wrong}).collect()}
    assert ranked["right"].rank == 1 and ranked["wrong"].rank == 2
    assert ranked["right"].roc_auc == pytest.approx(1 - ranked["wrong"].roc_auc)


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibration_follows_shares(rows, method):
    scored = rows.withColumn("model_probability", F.col("a") * 0.2 + 0.4)
    out = models.calibrate(scored, method=method)(scored).groupBy("a").agg(F.avg("calibrated").alias("p"), F.avg("label").alias("share")).collect()
    assert all(abs(r.p - r.share) < 0.02 for r in out)


def test_validated_importance(spark):
    weights = spark.createDataFrame([(f"f{i}", 1.0 - i / 10) for i in range(5)], "feature string, importance double")
    tests = spark.createDataFrame([("f0", 0.01, -0.3), ("f1", 0.01, 0.15), ("f2", 0.01, 0.05), ("f3", 0.2, 0.9)], "feature string, p double, effect double")
    got = {r.feature: r.validity for r in stats.validated_importance(weights, tests).collect()}
    assert got == {"f0": "HIGH", "f1": "MEDIUM", "f2": "LOW", "f3": "UNVALIDATED", "f4": "UNVALIDATED"}


def test_grid_run_goes_on_where_it_stopped(spark, rows, tmp_path):
    made = []

    def of(config):
        made.append(config["tp"])
        if config["tp"] == 2 and made.count(2) == 1:
            raise KeyboardInterrupt  # stopped on the way
        if config["tp"] == 4 and made.count(4) == 1:
            raise OSError("once")  # tried again
        return rows.filter("fold = 9") if config["tp"] == 3 else rows.filter("fold = 1")

    grid = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3, 4)], "tp int, sl int, hold int")
    lines, serial = (models.grid_ledger(spark, f"file://{tmp_path}/{x}") for x in ("lines", "serial"))
    run = lambda ledger, threads: models.grid_run(of, grid, ledger, FEATURES, threads=threads, least_train=10, least_test=5, maxIter=1, maxDepth=1)
    with pytest.raises(KeyboardInterrupt):
        run(lines, 3)
    assert 2 not in {r.tp for r in lines.read().collect()}
    got = run(lines, 3).collect()
    assert sorted(made) == [1, 2, 2, 3, 4, 4]
    assert [r.n_folds for r in sorted(got, key=lambda r: r.tp)] == [1, 1, 0, 1] and got[0].roc_auc > 0.8 and got[-1].roc_auc is None
    n_test = rows.filter("fold = 1 and part = 'test'").count()
    assert sorted(r.n_test for r in got) == [0, n_test, n_test, n_test]
    assert len(run(lines, 2).collect()) == 4 and len(made) == 6
    assert run(serial, 1).collect() == got


def test_grid_run_reports_what_fails(spark, rows, tmp_path):
    def of(config):
        if config["tp"] == 1:
            raise ValueError("always")
        return rows.filter("fold = 9")

    lines = models.grid_ledger(spark, f"file://{tmp_path}/lines")
    with pytest.raises(RuntimeError, match="1 configurations failed"):
        models.grid_run(of, spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "tp int, sl int, hold int"), lines, FEATURES)
    assert [r.tp for r in lines.read().collect()] == [2]


def test_final_fit_export_and_reload(spark, rows, tmp_path):
    registry = ledger.models(spark, f"file://{tmp_path}/registry")
    facts = [models.fit_and_export(rows.filter("fold = 1"), FEATURES, registry, f"file://{tmp_path}/models", name, tier=k, maxIter=1, maxDepth=k) for k, name in ((1, "a"), (2, "b"))]
    model, found = models.load(registry, "b")
    assert found["features"] == FEATURES and found["path"] == facts[1]["path"] and {x["feature"] for x in found["importance"]} == set(FEATURES)
    scored = models.predict(model, rows.filter("fold = 1"), FEATURES).filter("model_probability >= 0.5")
    assert scored.agg(F.avg(F.col("label").cast("double"))).first()[0] == pytest.approx(found["precision"])
    assert models.load(registry, "c") is None and models.load(registry, "a", 3) is None
    assert {(r.tier, r.n_models) for r in models.by_tier(registry).collect()} == {(1, 1), (2, 1)}


def test_areas_of_outcomes_that_are_all_alike(spark):
    df = spark.createDataFrame([("w", 0.2, "WIN"), ("w", 0.7, "WIN"), ("l", 0.7, "LOSS")], "g string, model_probability double, outcome string")
    got = {r.g: r for r in metrics.classification(df, ["g"]).collect()}
    assert got["w"].roc_auc is None and got["w"].average_precision == 1.0 and got["w"].recall == 0.5
    assert got["l"].roc_auc is None and got["l"].average_precision is None and got["l"].precision == 0.0
