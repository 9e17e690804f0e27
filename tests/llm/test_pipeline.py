"""The pipeline's stages against brute force on small tables."""

import random

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import queries

from .test_operators import library_ids, prose, quality_counts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [prose(rng, 80) for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", "too short", None, "again and again it goes on " * 40, prose(rng, 50) + " password=0a1b2c3d4e5f " + prose(rng, 30)]
    root = f"file://{tmp_path_factory.mktemp('sf')}"
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, dict(enumerate(texts))


def test_pipeline_brute_force(spark, folder):
    root, texts = folder
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
        docs.write.mode("overwrite").parquet(f"{root}/out-{name}")
        docs = spark.read.parquet(f"{root}/out-{name}")
        seen[name] = docs.collect()
    good = {i for i, t in texts.items() if not quality_counts(t)[-1]}
    assert {r.doc_id for r in seen["quality_rules"]} == good
    kept = good - {40, 41}  # 40 repeats 0, 41 is 1 with one more word
    assert {r.doc_id for r in seen["near_duplicates"]} == kept
    clean = {r.doc_id: r.text for r in seen["secret_scans"]}
    assert set(clean) == kept and clean[45] == texts[45].replace("password=0a1b2c3d4e5f", "[SECRET]")
    assert all(clean[i] == texts[i] for i in kept - {45})
    mixed = [r.doc_id for r in seen["mix_sources"]]
    assert max(map(mixed.count, mixed)) <= 2 and set(mixed) <= kept
    assert sorted((r.doc_id, r.ids) for r in seen["encode"]) == sorted((i, np.array(library_ids(clean[i]), "<u4").tobytes()) for i in mixed)


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
