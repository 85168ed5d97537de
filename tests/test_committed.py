"""Sinks that commit: whole batches, no rest of failures, nothing twice."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from prismdex.sources import committed
from prismdex.sources.documents import append_attributions

NAMES = "name string, content binary"


def put(spark, rows, path, tasks=3, **options):
    committed.write(spark.createDataFrame(rows, NAMES).repartition(tasks), str(path), **options)


def everything(path):
    return sorted(os.path.join(f, n) for f, _, names in os.walk(path) for n in names)


def content(spark, path):
    return {r.name: bytes(r.content) for r in committed.latest(spark, str(path)).collect()}


def test_files_and_their_batches(spark, tmp_path):
    rows = [(f"{k % 7}/{k}.jpg", bytes([k])) for k in range(50)] + [("empty", None)]
    put(spark, rows, tmp_path)
    assert content(spark, tmp_path) == {n: c or b"" for n, c in rows}
    put(spark, [("3/3.jpg", b"new"), ("more", b"x")], tmp_path)
    assert content(spark, tmp_path) == {n: c or b"" for n, c in rows} | {"3/3.jpg": b"new", "more": b"x"}
    put(spark, [("only", b"1")], tmp_path, mode="overwrite")
    assert content(spark, tmp_path) == {"only": b"1"} and len(os.listdir(tmp_path)) == 1
    put(spark, [], tmp_path, mode="overwrite")
    assert content(spark, tmp_path) == {}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    put(spark, [("there", b"1")], tmp_path)
    had = everything(tmp_path)
    for bad in ("../out", "/root", "a//b", ".hidden", None, ""):
        with pytest.raises(Exception, match="not a name of a file"):
            put(spark, [(f"{k}.jpg", b"x") for k in range(20)] + [(bad, b"x")], tmp_path)
    with pytest.raises(Exception, match="exists"):
        put(spark, [("twice", b"1"), ("twice", b"2")], tmp_path, 1)
    assert everything(tmp_path) == had and len(os.listdir(tmp_path)) == 1 and not os.path.exists(tmp_path.parent / "out")


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    for text in (b"first", b"again"):
        put(spark, [("a", text), (text.decode(), text)], tmp_path, batch="run-1")
    assert content(spark, tmp_path) == {"a": b"first", "first": b"first"} and os.listdir(tmp_path) == ["run-1"]
    put(spark, [("a", b"x")], tmp_path, batch="run-1", mode="overwrite")
    assert content(spark, tmp_path) == {"a": b"first", "first": b"first"}
    with pytest.raises(Exception, match="not a name of a batch"):
        put(spark, [("a", b"x")], tmp_path, batch="../x")


def test_attempts_that_lost_are_left_out(tmp_path):
    writer = committed.BatchWriter(str(tmp_path), None, False, committed.put_files)
    row = lambda c: iter([{"name": "a", "content": c}])
    lost, won = writer.write(row(b"lost")), writer.write(row(b"won"))
    assert os.path.exists(lost.folder)
    writer.commit([won])
    (place,) = everything(tmp_path)
    assert open(place, "rb").read() == b"won" and all(not n.startswith(".") for n in os.listdir(tmp_path))
    died = committed.BatchWriter(str(tmp_path), None, False, committed.put_files)
    died.write(row(b"rest"))
    assert committed.swept(str(tmp_path)) == 0 and committed.swept(str(tmp_path), -1) == 1 and everything(tmp_path) == [place]


def test_attributions(spark, tmp_path):
    columns = "file string, title string, author string, license string, source_url string"
    rows = [("a.jpg", 'A "quoted", title', None, "", "https://x/é"), ("b,c.jpg", "two\nlines", "back\\slash", 'ends in \\', 'a\\"b')]
    first = spark.createDataFrame(rows, columns).withColumn("other", F.lit(1))
    for batch in ("one", "one", None):
        append_attributions(first, str(tmp_path), batch)
    found = [tuple(r) for r in committed.csv_rows(spark, str(tmp_path), columns).collect()]
    assert sorted(found, key=str) == sorted(rows * 2, key=str)


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"{k}/{i}", bytes([k, i])) for i in range(5)], NAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    committed.registered(spark)

    def run(checkpoint):
        stream = spark.readStream.schema(NAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = stream.writeStream.format("committed_files").option("batch", "s").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert out.awaitTermination(120)

    run("c1")
    had = everything(tmp_path / "out")
    assert content(spark, tmp_path / "out") == {f"{k}/{i}": bytes([k, i]) for k in range(3) for i in range(5)} and len(had) == 15
    run("c2")  # a stream that has lost its offsets
    assert everything(tmp_path / "out") == had
