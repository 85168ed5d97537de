"""Layers of snapshots against plain dictionaries, and two writers at once."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from prismdex.sources import snapshots
from prismdex.sources.snapshots import Busy, Conflict, Delta, Snapshots

ROWS = "path string, n int"


def rows_of(frame):
    return sorted((r.path, r.n) for r in frame.collect())


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows), ROWS).coalesce(1)


def test_deltas_against_a_dictionary(spark, tmp_path):
    store, rng = Snapshots(spark, str(tmp_path / "s"), most_layers=4, most_share=10.0), random.Random(3)
    now = {f"p{k}": k for k in range(30)}
    store.commit({"t": frame(spark, now.items())})
    past, layers = {1: dict(now)}, []
    for version in range(2, 8):
        put = {f"p{rng.randint(0, 40)}": version * 100 + k for k in range(3)}
        gone = [k for k in rng.sample(sorted(now), 2) if k not in put]
        now = {k: v for k, v in (now | put).items() if k not in gone}
        assert store.commit({"t": Delta(frame(spark, put.items()), "path", spark.createDataFrame([(k,) for k in gone], "key string"))}) == version
        past[version] = dict(now)
        layers.append(len(store.manifest()["t"]))
        assert rows_of(store.read("t")) == sorted(now.items())
    assert layers == [2, 3, 4, 1, 2, 3] and store.versions() == [5, 6, 7]
    for version in (5, 6, 7):
        assert rows_of(store.read("t", version)) == sorted(past[version].items())
    assert len(os.listdir(tmp_path / "s" / "data")) == 3  # what no version names is gone


def test_several_rows_of_a_key_and_a_key_that_comes_back(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), most_share=10.0)
    store.commit({"t": frame(spark, [("a", 1), ("a", 2), ("b", 3)]), "u": frame(spark, [("x", 0)])})
    none = frame(spark, [("", 0)]).limit(0)
    store.commit({"t": Delta(none, "path", spark.createDataFrame([("a",)], "key string"))})
    assert rows_of(store.read("t")) == [("b", 3)]
    store.commit({"t": Delta(frame(spark, [("a", 7), ("a", 8)]), "path"), "u": Delta(frame(spark, [("x", 1)]))})
    assert rows_of(store.read("t")) == [("a", 7), ("a", 8), ("b", 3)] and rows_of(store.read("u")) == [("x", 0), ("x", 1)]
    assert rows_of(Snapshots(spark, str(tmp_path)).read("t", 2)) == [("b", 3)]


def test_a_small_change_writes_little(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    every = spark.range(200_000).select(F.concat(F.lit("/folder/"), F.sha1(F.col("id").cast("string"))).alias("path"), F.col("id").cast("int").alias("n"))
    store.commit({"t": every})
    store.commit({"t": Delta(every.where("n % 100 = 0").withColumn("n", F.col("n") + 1), "path")})
    base, delta = store.manifest()["t"]
    assert delta["bytes"] < 0.03 * base["bytes"]
    assert store.read("t").agg(F.sum("n"), F.count("*")).first() == (199_999 * 100_000 + 2000, 200_000)


def test_two_writers(spark, tmp_path):
    one, two = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    one.commit({"t": frame(spark, [("a", 1)])})
    claim = one.claim()
    with pytest.raises(Busy, match="version 2"):
        two.commit({"t": frame(spark, [("b", 2)])})
    assert two.claimed()["owner"] == claim.owner and rows_of(two.read("t")) == [("a", 1)]
    claim = one.commit({"t": Delta(frame(spark, [("c", 3)]), "path")}, claim=claim, go_on=True)
    with pytest.raises(Busy, match="version 3"):
        two.claim()
    one.release(claim)
    assert two.claimed() is None and two.commit({"t": Delta(frame(spark, [("d", 4)]), "path")}) == 3
    assert rows_of(one.read("t")) == [("a", 1), ("c", 3), ("d", 4)]


def test_a_claim_of_a_dead_writer_is_taken_over(spark, tmp_path):
    dead, heir = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path), lease=1.0)
    old = dead.claim()
    with pytest.raises(Busy):
        heir.claim()
    time.sleep(1.2)
    new = heir.claim()
    with pytest.raises(Conflict):  # it was not dead after all
        dead.commit({"t": frame(spark, [("late", 0)])}, claim=old)
    assert heir.commit({"t": frame(spark, [("a", 1)])}, claim=new) == 1 and rows_of(dead.read("t")) == [("a", 1)]
    assert snapshots.EMPTY and dead.read("files").count() == 0
