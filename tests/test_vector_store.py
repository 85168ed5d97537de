"""Packed vectors: the same results as a full scan, fewer blocks read, nothing built twice."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismdex.operators import retrieval, vector_store
from prismdex.operators.vector_store import VectorStore


def clustered(spark, n=6000, kinds=40, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dim))
    rows = centres[rng.integers(0, kinds, n)] + 0.05 * rng.normal(size=(n, dim))
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    vectors = spark.createDataFrame([(f"v{k}", int(k // 3), r.tolist()) for k, r in enumerate(rows)], "vid string, asset_id long, vector array<float>")
    queries = spark.createDataFrame([(k, (rows[37 * k] + 0.01).tolist()) for k in range(12)], "qid int, vector array<float>")
    return vectors.repartition(5), queries


def ranked(found, most, per_asset):
    best = retrieval.best_per_asset(found) if per_asset else found
    return sorted((r.qid, r.rank, r.asset_id, r.vid, round(r.raw, 9)) for r in retrieval.cut_and_rank(best, most=most).collect())


@pytest.mark.parametrize("per_asset", [True, False])
@pytest.mark.parametrize("filtered", [True, False])
def test_equal_to_a_full_scan_with_fewer_blocks(spark, tmp_path, per_asset, filtered):
    vectors, queries = clustered(spark)
    allowed = spark.createDataFrame([(k,) for k in range(0, 2000, 3)], "asset_id long") if filtered else None
    store = VectorStore.opened(vectors, str(tmp_path), "one", block=64)
    found, reads = store.nearest(queries, allowed, most=20, per_asset=per_asset)
    whole = retrieval.nearest(vectors, queries, allowed, most=20, per_asset=per_asset)
    assert ranked(found, 20, per_asset) == ranked(whole, 20, per_asset)
    told = reads.collect()
    assert len(told) == 12 and all(0 < r.read <= 0.35 * r.blocks for r in told)


def test_random_vectors_and_many_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(k, k % 90, rng.normal(size=8).tolist()) for k in range(900)], "vid long, asset_id long, vector array<double>")
    queries = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(11)], "qid int, vector array<double>")
    found, _ = VectorStore.opened(vectors, str(tmp_path), "r", block=32).nearest(queries)
    assert ranked(found, 200, True) == ranked(retrieval.nearest(vectors, queries), 200, True)


def test_the_same_signature_is_not_built_again(spark, tmp_path, monkeypatch):
    vectors, queries = clustered(spark, 500)
    VectorStore.opened(vectors, str(tmp_path), "v1-p")
    before = {f: os.stat(tmp_path / "v1-p" / f).st_mtime_ns for f in os.listdir(tmp_path / "v1-p")}
    monkeypatch.setattr(vector_store, "build", lambda *_: pytest.fail("built again"))
    again = VectorStore.opened(vectors, str(tmp_path), "v1-p")
    assert again.nearest(queries, most=5)[0].count() >= 60
    assert before == {f: os.stat(tmp_path / "v1-p" / f).st_mtime_ns for f in os.listdir(tmp_path / "v1-p")}
    monkeypatch.undo()
    assert VectorStore.opened(vectors.limit(100), str(tmp_path), "v2-p").blocks.agg(F.sum("n")).first()[0] == 100


def test_empty_and_null_vectors(spark, tmp_path):
    vectors, queries = clustered(spark, 450)
    none = VectorStore.opened(vectors.limit(0), str(tmp_path), "empty").nearest(queries)
    assert none[0].collect() == [] and none[1].collect() == []
    some = vectors.withColumn("vector", F.when(F.col("asset_id") > 40, F.col("vector")))
    found, _ = VectorStore.opened(some, str(tmp_path), "some").nearest(queries)
    assert ranked(found, 200, True) == ranked(retrieval.nearest(some.where("vector IS NOT NULL"), queries), 200, True)
    assert VectorStore.opened(vectors, str(tmp_path), "all").nearest(queries, spark.createDataFrame([], "asset_id long"))[0].collect() == []
