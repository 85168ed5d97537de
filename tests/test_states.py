"""The stateful stream of files against the batch expressions, and its timers."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from prismdex.operators import ingest
from prismdex.streaming.states import COLUMNS, EVENTS, FILE, path_changes

FIELDS = [c.split()[0] for c in EVENTS.split(", ")]
LISTING = ["path", "folder", "name", "ext", "size", "mtime_ns"]


def event(**values):
    return tuple(values.get(c) for c in FIELDS)


def listed(path, at, size, redo=None):
    return event(path=path, at=at, kind="listed", folder="/f", name=path[3:], ext=path[path.rindex(".") :], size=size, mtime_ns=size, redo=redo)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # files are read by their times, which have whole seconds


def start(spark, tmp_path, name, files=None, **options):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    out = path_changes(stream, files, **options).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name))
    return out.trigger(processingTime="300 milliseconds").start()


@pytest.fixture(scope="module")
def quick(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", had)


def test_a_stream_ends_like_the_batch_runs(quick, tmp_path):
    spark, draw = quick, random.Random(11)
    paths = [f"/f/{k}{e}" for k in range(25) for e in (".jpg", ".pdf", ".txt", ".")]
    first = [(p, "/f", p[3:], p[p.rindex(".") :], k % 5, k % 5, None, draw.choice(["done", "failed", "unsupported", "processing"]), "old", 2, k % 4 > 0) for k, p in enumerate(paths) if k % 3]
    schema = f"path string, {FILE}"
    files, events = ingest.recovered(spark.createDataFrame(first, schema)), str(tmp_path / "events")
    for run, redo in enumerate((None, "failed", "all")):
        seen = [listed(p, run * 10, draw.randrange(3) + k % 5, redo) for k, p in enumerate(paths) if draw.random() < 0.7]
        rows = spark.createDataFrame([tuple(e[FIELDS.index(c)] for c in LISTING) for e in seen], "path string, folder string, name string, ext string, size long, mtime_ns long")
        files = ingest.mark_missing(ingest.classified(files, rows, redo == "failed", redo == "all")).drop("change")
        pending = files.where("present AND state = 'pending'").collect()
        kinds = {r.path: draw.choice([None, None, "corrupt", "unsupported", "empty", "other"]) for r in pending}
        outcomes = [event(path=r.path, at=run * 10 + 2, kind="outcome", size=r["size"], mtime_ns=r.mtime_ns, asset_id=None if kinds[r.path] else f"a{r['size']}", error_kind=kinds[r.path], error="no") for r in pending]
        stale = [event(path=r.path, at=run * 10 + 1, kind="outcome", size=-1, mtime_ns=-1, error_kind="corrupt", error="of other content") for r in pending[:5]]
        gone = [event(path=p, at=run * 10 + 1, kind="gone") for p in paths if p not in {e[0] for e in seen}]
        arrive(spark, events, seen + gone)
        arrive(spark, events, outcomes + stale + [event(kind="listed", at=0), event(path="/f/x.jpg", kind="odd", at=0)])
        told = spark.createDataFrame([(e[0], e[9], e[10]) for e in outcomes], "path string, asset string, kind string")
        state, known = ingest.error_state(F.col("kind"), F.lit("no")), F.col("k")
        done = known & F.col("kind").isNull()
        after = files.join(told.withColumn("k", F.lit(True)), "path", "left").withColumn("k", F.coalesce("k", F.lit(False)))
        after = after.select(
            "path", "folder", "name", "ext", "size", "mtime_ns", F.coalesce("asset", "asset_id").alias("asset_id"), F.when(done, "done").when(known, state["state"]).otherwise(F.col("state")).alias("state"),
            F.when(done, None).when(known, state["error"]).otherwise(F.col("error")).alias("error"), (F.col("attempts") + F.col("k").cast("int")).alias("attempts"), "present",
        )
        files = spark.createDataFrame(after.collect(), schema)
    query, ends = start(spark, tmp_path, "states", spark.createDataFrame(first, schema)), time.monotonic() + 90
    while not (tmp_path / "states" / "commits" / "5").exists() and not query.exception() and time.monotonic() < ends:  # six batches of one file
        time.sleep(0.2)
    query.stop()
    assert (tmp_path / "states" / "commits" / "5").exists(), query.exception()
    found = {p: tuple(r) for p, r in ((r[0], r[1:]) for r in ingest.recovered(spark.createDataFrame(first, schema)).select("path", *COLUMNS).collect())}
    for r in spark.table("states").collect():  # one partition and memory sink: in the order of batches
        found[r.path] = tuple(r[c] for c in COLUMNS)
    assert found == {r.path: tuple(r[c] for c in COLUMNS) for r in files.collect()}


def test_timers_retry_and_recover(quick, tmp_path):
    spark, events = quick, str(tmp_path / "events")
    failed = lambda at: event(path="/f/a.jpg", at=at, kind="outcome", size=1, mtime_ns=1, error_kind="embedder", error="busy")
    arrive(spark, events, [listed("/f/a.jpg", 0, 1), listed("/f/b.jpg", 0, 1), event(path="/f/b.jpg", at=1, kind="started"), failed(1)])
    query = start(spark, tmp_path, "timed", pause=0.5, lease=2.0)

    def until(path, wanted):
        ends = time.monotonic() + 60
        while time.monotonic() < ends:
            if query.exception():
                raise query.exception()
            rows = [(r.change, r.state, r.attempts) for r in spark.table("timed").where(F.col("path") == path).collect()]
            if len(rows) >= len(wanted):
                break
            time.sleep(0.2)
        assert rows == wanted

    begun = [("new", "pending", 0), ("postponed", "pending", 0), ("retry", "pending", 0)]
    until("/f/a.jpg", begun)
    until("/f/b.jpg", [("new", "pending", 0), ("started", "processing", 0), ("recovered", "pending", 0)])
    arrive(spark, events, [failed(2)])
    until("/f/a.jpg", begun + begun[1:])
    arrive(spark, events, [failed(3)])
    until("/f/a.jpg", begun + begun[1:] + [("outcome", "failed", 1)])
    query.stop()
    last = spark.table("timed").where("path = '/f/a.jpg' AND change = 'outcome'").first()
    assert last.error == "AI processing failed: busy"
