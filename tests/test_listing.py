"""Listing of folders: uneven trees, flat ones, and the stream of changed files."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from prismdex.plans.engine import Engine
from prismdex.settings import Settings
from prismdex.sources.embedders import PlainEmbedder
from prismdex.sources.listing import MediaListing, arrivals, listing, subtrees
from prismdex.streaming.catalogue import index_stream


@pytest.fixture
def tree(tmp_path):
    """An uneven tree of 900 files, one branch 40 folders deep and one folder of 500 files, with what a listing leaves out."""
    draw, root = random.Random(5), tmp_path / "media"
    deep = root / "deep"
    for _ in range(40):
        deep = deep / "d"
    (root / "flat").mkdir(parents=True)
    deep.mkdir(parents=True)
    places = [root / "flat" / f"{k}.png" for k in range(500)] + [deep / "end.jpg", root / "_top.pdf"]
    places += [root / f"a{draw.randrange(9)}" / f"b{draw.randrange(9)}" / f"{k}.MP4" for k in range(398)]
    hidden = [root / ".git" / "x.png", root / "flat" / ".x.png", root / "flat" / "Thumbs.db", root / "a0" / ".b" / "x.png"]
    for p in places + hidden:
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * draw.randrange(5))
    (root / "thumbs.db").mkdir()  # an ignored name is that of a file
    (root / "thumbs.db" / "in.png").write_bytes(b"")
    os.symlink(root / "flat", root / "link")
    os.symlink(root / "nowhere", root / "broken.png")
    os.symlink(root / "_top.pdf", root / "again.pdf")
    return root, {str(p) for p in [*places, root / "thumbs.db" / "in.png", root / "again.pdf"]}


@pytest.mark.parametrize("share", [1, 50, 20_000])
def test_rounds_list_every_file_once(spark, tree, share):
    root, places = tree
    if share == 1:
        root = root / "deep" / "d" / "d"
        for _ in range(32):
            root = root / "d"  # a round for each folder
        places = {p for p in places if p.startswith(f"{root}/")}
    rows = listing(spark, str(root), share).collect()
    assert len(rows) == len(places) and {r.path for r in rows} == places
    for r in rows[:50]:
        found = os.stat(r.path)
        assert (r.folder, r.name, r.ext, r.size, r.mtime_ns) == (os.path.dirname(r.path), os.path.basename(r.path), os.path.splitext(r.path)[1].lower(), found.st_size, found.st_mtime_ns)


def test_files_of_one_folder_are_looked_at_by_all_tasks(spark, tmp_path):
    for k in range(6000):
        (tmp_path / f"{k}.png").touch()
    found = listing(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == 6000 and max(r.n for r in found) <= 2000 and len(found) >= 3


def test_empty_and_missing_roots(spark, tmp_path):
    assert listing(spark, str(tmp_path)).count() == 0
    with pytest.raises(NotADirectoryError):
        listing(spark, str(tmp_path / "none"))


def test_data_source_and_its_plan(spark, tree):
    root, places = tree
    spark.dataSource.register(MediaListing)
    assert sorted(r.path for r in spark.read.format("media_listing").load(str(root)).collect()) == sorted(places)
    for wanted in (1, 5, 40, 10_000):
        parts = subtrees(str(root), wanted)
        assert len({p for p, _ in parts}) == len(parts) and (len(parts) >= wanted or not any(deep for _, deep in parts))


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    root = tmp_path / "media"
    (root / "a").mkdir(parents=True)

    def run():
        stream = arrivals(spark, str(root), settled=0.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
        assert stream.awaitTermination(120)
        return sorted(os.path.relpath(r.path, root) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (root / "a" / "1.png").write_bytes(b"1")
    (root / "2.png").write_bytes(b"2")
    assert run() == ["2.png", "a/1.png"]
    old = tmp_path / "old.png"
    old.write_bytes(b"old")
    os.utime(old, (1, 1))
    time.sleep(0.05)
    os.rename(old, root / "a" / "old.png")  # its content is older than the last batch, its name is not
    (root / "2.png").write_bytes(b"22")
    assert run() == ["2.png", "2.png", "a/1.png", "a/old.png"]
    assert run() == ["2.png", "2.png", "a/1.png", "a/old.png"]


def test_arrivals_leave_other_files_as_they_are(spark, tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    from fakes import OPENERS

    engine = Engine(spark, str(tmp_path / "index"), Settings(), PlainEmbedder(), OPENERS, pause=0.0)
    run = lambda: index_stream(arrivals(spark, str(root), settled=0.0), engine, str(tmp_path / "offsets"), complete=False).awaitTermination(120)
    (root / "red.png").write_text("IMG\n250 5 5")
    assert run()
    (root / "blue.png").write_text("IMG\n5 5 250")
    assert run()
    assert {(r.name, r.state, r.present) for r in engine.store.read("files").collect()} == {("red.png", "done", True), ("blue.png", "done", True)}
    engine.apply(listing(spark, str(root)).where("name = 'red.png'"))
    assert {(r.name, r.present) for r in engine.store.read("files").collect()} == {("red.png", True), ("blue.png", False)}
