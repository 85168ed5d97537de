"""Indexing and search from end to end over a small media folder."""

from __future__ import annotations

import json
import os
import threading
import time

import pytest
from fakes import OPENERS, Failing, Shown
from pyspark.sql import functions as F

from prismdex.operators import ingest
from prismdex.operators.retrieval import Filters
from prismdex.plans import engine as engine_module
from prismdex.plans import runners
from prismdex.plans.engine import Engine
from prismdex.settings import Settings
from prismdex.sources import committed
from prismdex.sources.embedders import PlainEmbedder
from prismdex.sources.listing import listing
from prismdex.sources.snapshots import Busy
from prismdex.streaming.catalogue import index_stream, listings, state_counts

SOLAR = "Solar panel installation for homeowners. The inverter turns the current of the panels into that of the house. " * 2
FILES = {
    "a/red.png": "IMG\n250 5 5", "a/blue.jpg": "IMG\n5 5 250", "b/red_copy.png": "IMG\n250 5 5", "a/solar.pdf": f"PDF\n{SOLAR}\n{SOLAR} Warranty.", "b/pasta.pdf": "PDF\nSpaghetti carbonara with eggs, cheese and pepper, a Roman dish. " + "Boil the water first. " * 3,
    "a/clip.mp4": "VID\n250 0 0\n250 0 0\n0 0 250\n0 0 250", "a/broken.jpg": "garbage", "a/notes.txt": "hello", "a/empty.png": "", "a/broken.pdf": "%PDF", "a/.hidden.png": "IMG\n0 0 0", "Thumbs.db": "x",
}


@pytest.fixture
def media(tmp_path):
    def write(files):
        for name, text in files.items():
            path = tmp_path / "media" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
        return tmp_path / "media"

    return write


@pytest.fixture
def make(spark, tmp_path):
    settings = Settings(workers=3, video_min_interval=2.0, video_max_frames=6)
    return lambda embedder=None: Engine(spark, str(tmp_path / "index"), settings, embedder or PlainEmbedder(), OPENERS, pause=0.0)


def states(engine):
    return {os.path.basename(r.path): (r.state, r.error) for r in engine.store.read("files").where("present").collect()}


def test_whole_run_and_searches(make, media):
    engine, folder = make(), media(FILES)
    summary = engine.index(str(folder))
    assert summary["scanned"] == 10 and summary["reused"] == 1 and summary["indexed"] == 5 and summary["failed"] == 3 and summary["unsupported"] == 1
    found = states(engine)
    assert {k for k, v in found.items() if v[0] == "done"} == {"red.png", "blue.jpg", "red_copy.png", "solar.pdf", "pasta.pdf", "clip.mp4"}
    assert found["broken.jpg"][0] == found["broken.pdf"][0] == "failed" and found["broken.jpg"][1].startswith("corrupt or unreadable: ")
    assert found["empty.png"] == ("failed", "corrupt or unreadable: empty file (0 bytes)") and found["notes.txt"][0] == "unsupported"
    assert engine.store.read("assets").where("status = 'ready'").count() == 5

    red = engine.search("a red picture")
    top = red["results"][0]
    assert (top["type"], top["duplicates"], len(top["files"])) == ("image", 1, 2) and top["name"].startswith("red") and top["confidence"] > 0.99
    assert red["intent"] == ["image"] and red["total"] == sum(red["facets"].values())
    blue = engine.search("blue video")["results"][0]
    assert blue["type"] == "video" and blue["match"]["kind"] == "frame" and blue["match"]["ref"] >= 2
    solar = engine.search("solar panel installation for homeowners")
    assert solar["results"][0]["name"] == "solar.pdf" and solar["results"][0]["text_match"]["snippet"] and solar["results"][0]["text_match"]["ref"] >= 1 and solar["facets"]["pdf"] >= 1
    assert [r["name"] for r in engine.search("carbonara", Filters(types=("pdf",)))["results"]] == ["pasta.pdf"]
    assert engine.search("carbonara", Filters(types=("image",)))["results"] == []
    inside = engine.search("red", Filters(folder="/B/"))
    assert inside["total"] == 1 and any("/b/" in f["path"] for f in inside["results"][0]["files"])
    for query, filters in (("zzzzqqqq nonsense", Filters()), ("magenta", Filters()), ("red", Filters(min_size=10**9))):
        assert engine.search(query, filters)["total"] == 0
    weak = engine.search("solar", Filters(types=("pdf",)))["results"][0]
    assert weak["score"] == 1.0 and weak["confidence"] < 0.9
    assert engine.search("red", Filters(min_size=10**9))["signals"] == {}
    with pytest.raises(ValueError):
        engine.search("  ")
    assert engine.raw_top("red")["clip"] > 0.99

    stats = engine.stats()
    assert stats["duplicate_groups"] == 1 and stats["by_type"]["image"]["files"] == 3 and stats["by_type"]["image"]["assets"] == 2
    assert len(engine.duplicates()) == 1 and {os.path.basename(r["path"]) for r in engine.files()} == {"broken.jpg", "notes.txt", "empty.png", "broken.pdf"}

    again = engine.index(str(folder))
    assert again["queued"] == again["indexed"] == again["reused"] == 0 and again["unchanged"] >= 8
    os.utime(folder / "a/red.png", (2e9, 2e9))
    touched = engine.index(str(folder))
    assert (touched["queued"], touched["indexed"], touched["reused"]) == (1, 0, 1)
    forced = engine.index(str(folder), force=True)
    assert forced["queued"] == 9 and forced["reused"] == 6 and forced["indexed"] == 0
    assert engine.index(str(folder), force=True, reanalyse=True)["indexed"] == 5


def test_changed_new_and_missing_files(make, media):
    engine, folder = make(), media({k: FILES[k] for k in ("a/red.png", "a/blue.jpg", "b/pasta.pdf")})
    engine.index(str(folder))
    media({"a/blue.jpg": "IMG\n5 250 5 ", "b/new.png": "IMG\n250 250 5"})
    summary = engine.index(str(folder))
    assert (summary["queued"], summary["indexed"]) == (2, 2)
    assets, files = engine.store.read("assets"), engine.store.read("files")
    assert assets.count() == 4 and assets.join(files, "asset_id", "left_anti").count() == 0
    assert engine.store.read("vectors").join(assets, "asset_id", "left_anti").count() == 0
    os.remove(folder / "b/pasta.pdf")
    engine.index(str(folder))
    assert engine.search("carbonara")["total"] == 0
    for path in folder.rglob("*.*"):
        path.unlink()
    engine.index(str(folder))
    assert engine.store.read("files").where("present").count() == 3


def test_embedder_failures_can_be_retried(make, media):
    folder = media({"a/red.png": FILES["a/red.png"], "a/t.pdf": "PDF\n" + "plain text about gardening and tomatoes. " * 4})
    engine = make(Failing())
    engine.index(str(folder))
    assert {v[0] for v in states(engine).values()} == {"failed"} and states(engine)["red.png"][1].startswith("AI processing failed: ")
    engine = make()
    assert engine.index(str(folder))["queued"] == 0
    assert engine.index(str(folder), retry_failed=True)["indexed"] == 2
    assert {v[0] for v in states(engine).values()} == {"done"}


def test_margin_cuts_the_tail(make, media):
    embedder = PlainEmbedder()
    engine = make(embedder)
    engine.index(str(media({"a/red.png": "IMG\n250 5 5", "a/nearly.png": "IMG\n240 40 40"})))
    assert engine.search("red")["total"] == 2
    embedder.margins = {"clip": 0.01, "text": 0.6}
    assert engine.search("red")["total"] == 1


def test_settings_change_the_cuts_of_a_search(spark, media, tmp_path):
    folder = media({"a/red.png": "IMG\n250 5 5", "a/nearly.png": "IMG\n240 40 40", "a/clip.mp4": FILES["a/clip.mp4"]})
    run = lambda **env: Engine(spark, str(tmp_path / "index"), Settings.from_env({"VIDEO_MIN_INTERVAL": "1", **env}, None), PlainEmbedder(), OPENERS, pause=0.0)
    assert run().index(str(folder))["indexed"] == 3
    assert run().search("red")["total"] == 3 and run(CLIP_MARGIN="0.01").search("red")["total"] == 2 and run(CLIP_MIN_SCORE="1.01").search("red")["total"] == 0


def test_thumbnails_and_speech(spark, media, tmp_path):
    folder = media({"a/red.png": "IMG\n250 5 5", "b/red.png": "IMG\n250 5 5", "a/clip.mp4": FILES["a/clip.mp4"]})
    openers = OPENERS | {"image": Shown, "speech": lambda path, settings: [(1.26, "a talk about gardens"), (3.0, "  ")]}
    engine = lambda openers: Engine(spark, str(tmp_path / "index"), Settings(enable_asr=True, thumb_size=7), PlainEmbedder(), openers, pause=0.0)
    assert engine(openers).index(str(folder))["indexed"] == 2
    top = engine(openers).search("red picture")["results"][0]
    assert engine(openers).thumbnail(top["thumb"]) == b"JPEG of 7" and engine(openers).thumbnail("none") is None
    for _ in range(2):
        engine(openers).export_thumbnails(str(tmp_path / "thumbs"))
    files = {r.name: bytes(r.content) for r in committed.latest(engine(openers).spark, str(tmp_path / "thumbs")).collect()}
    assert files == {r.path: bytes(r.jpeg) for r in engine(openers).store.read("thumbs").collect()} and files[top["thumb"]] == b"JPEG of 7" and len(os.listdir(tmp_path / "thumbs")) == 1
    talk = engine(openers).search("gardens")["results"][0]
    assert talk["type"] == "video" and talk["thumb"] is None and talk["text_match"]["kind"] == "transcript" and talk["text_match"]["ref"] == 1.3
    (folder / "a/red.png").unlink(), (folder / "b/red.png").unlink()
    media({"a/clip.mp4": FILES["a/clip.mp4"] + "\n0 250 0"})
    engine(OPENERS).index(str(folder))
    warnings = [w for r in engine(OPENERS).store.read("assets").where("type = 'video'").collect() for w in r.warnings]
    assert warnings == ["speech: there is no recogniser, only frames are searched"]


def test_evaluation_calibration_and_report(make, media, tmp_path):
    engine, folder = make(), media(FILES)
    engine.settings = Settings(media_dir=str(folder))
    engine.index(str(folder))
    queries = [{"id": "1", "query": "a red picture", "expect_types": ["image"], "relevant_regex": "red.*square"}, {"id": "2", "query": "zzz nothing", "expect_types": [], "relevant_regex": "x"}, {"id": "3", "query": "solar panel", "expect_types": ["pdf"], "relevant_regex": "sun"}]
    (tmp_path / "q.json").write_text(json.dumps(queries))
    (tmp_path / "m.json").write_text(json.dumps({"b/red_copy.png": {"title": "A RED", "categories": ["square"], "description": ""}, "a/solar.pdf": {"title": "The sun", "categories": [], "description": "y"}}))
    (tmp_path / "c.json").write_text(json.dumps({"One": ["a red picture", "<<< later >>>"], "Two": [{"query": "solar panel", "types": ["pdf"]}, {"query": "solar", "types": ["video"]}]}))
    each, means = runners.evaluate(engine, str(tmp_path / "q.json"), str(tmp_path / "m.json"))
    rows = {r.qid: (r.p_at_5, r.recall, r.first_rank, r.negative) for r in each.collect()}
    assert rows == {"1": (0.2, 1.0, 1, False), "2": (0.0, None, None, True), "3": (0.2, 1.0, 1, False)} and means.first().mrr == 1.0
    found = {r.signal: r for r in runners.calibrate(engine, str(tmp_path / "q.json"), ("magenta", "underwater")).collect()}
    assert found["clip"].n_positive == 2 and 0 < found["clip"].highest_negative < found["clip"].floor
    text = runners.report(engine, str(tmp_path / "c.json")).split("\n")
    assert [x for x in text if x.startswith("#")] == ["## One", "### 1. a red picture", "### 2. <<< later >>>", "## Two", "### 3. solar panel", "### 4. solar"]
    assert any(x.startswith("1. **red") and "2 copies" in x for x in text) and any(x.startswith("1. **solar.pdf**") and "2 pages" in x for x in text) and "No results." in text


def test_recovery_and_new_pipeline(spark):
    files = spark.createDataFrame([("p", "processing", "x", 3, True), ("q", "done", "x", 1, True), ("r", "done", "y", 1, True), ("s", "done", "x", 1, False)], "path string, state string, asset_id string, attempts int, present boolean")
    assert {r.path: r.state for r in ingest.recovered(files).collect()}["p"] == "pending"
    assets = spark.createDataFrame([("x", "old"), ("y", "new")], "asset_id string, pipeline string")
    again = {r.path: (r.state, r.attempts) for r in ingest.requeue_stale(files, assets, "new").collect()}
    assert again == {"p": ("processing", 3), "q": ("pending", 0), "r": ("done", 1), "s": ("done", 1)}


def test_listing(spark, media):
    folder = media(FILES | {"_x/deep/er/one.PNG": "", "c/.git/two.png": ""})
    rows = {os.path.relpath(r.path, folder): r for r in listing(spark, str(folder)).collect()}
    assert set(rows) == set(FILES) - {"a/.hidden.png", "Thumbs.db"} | {"_x/deep/er/one.PNG"}
    assert rows["_x/deep/er/one.PNG"].ext == ".png" and rows["a/empty.png"].size == 0 and rows["a/notes.txt"].mtime_ns == os.stat(folder / "a/notes.txt").st_mtime_ns


def test_stream_of_listings(spark, make, media, tmp_path):
    engine, folder = make(), media({"a/red.png": FILES["a/red.png"]})
    listing(spark, str(folder)).coalesce(1).write.mode("append").parquet(str(tmp_path / "arrivals"))
    run = lambda: index_stream(listings(spark, str(tmp_path / "arrivals")), engine, str(tmp_path / "offsets")).awaitTermination(120)
    assert run() and states(engine) == {"red.png": ("done", None)}
    media({"a/blue.jpg": FILES["a/blue.jpg"]})
    listing(spark, str(folder)).coalesce(1).write.mode("append").parquet(str(tmp_path / "arrivals"))
    assert run() and set(states(engine)) == {"red.png", "blue.jpg"} and engine.store.read("runs").count() == 2


def test_counts_of_late_changes(spark, tmp_path):
    path = str(tmp_path / "changes")
    at = lambda *rows: [(f"2024-01-01 {t}", s) for t, s in rows]
    # A batch drops what was late at the end of the batch before the last one.
    batches = [at(("00:10:00", "done"), ("00:20:00", "done"), ("09:00:00", "failed")), at(("09:10:00", "failed")), at(("01:00:00", "done"), ("15:00:00", "done"))]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, state string").coalesce(1).select(F.col("ts").cast("timestamp").alias("ts"), "state").write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema("ts timestamp, state string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(path)
    state_counts(stream).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(str(r.start), r.state): r.n for r in spark.table("counted").collect()} == {("2024-01-01 00:00:00", "done"): 2, ("2024-01-01 09:00:00", "failed"): 2}


class Slow(PlainEmbedder):
    """Waits for a file to be there, at most two minutes, before it looks at a red picture."""

    def __init__(self, gate):
        self.gate = gate

    def pictures(self, pictures):
        ends = time.monotonic() + 120
        while any(p[0, 0, 0] > 200 > p[0, 0, 1] for p in pictures) and not os.path.exists(self.gate) and time.monotonic() < ends:
            time.sleep(0.1)
        return super().pictures(pictures)


def test_a_run_is_cancelled_and_the_next_one_does_the_rest(spark, media, tmp_path):
    folder = media({f"a/{k}.png": f"IMG\n{k} 5 250" for k in range(6)} | {"b/slow.mp4": "VID\n250 0 0\n250 0 0", "b/t.pdf": "PDF\n" + "plain text about gardening and tomatoes. " * 4})
    settings, gate = Settings(workers=2, video_min_interval=1.0), tmp_path / "gate"
    engine = Engine(spark, str(tmp_path / "index"), settings, Slow(str(gate)), OPENERS, pause=0.0, batch=3)
    other = Engine(spark, str(tmp_path / "index"), settings, PlainEmbedder(), OPENERS, pause=0.0)
    out = {}
    run = threading.Thread(target=lambda: out.update(engine.index(str(folder))))
    run.start()
    while sum(v[0] == "done" for v in states(other).values()) < 7:
        assert run.is_alive()
        time.sleep(1)
    told = engine.status()
    assert told["running"] and told["total"] == 8 and told["done"] in (6, 7, 8) and told["rate"] > 0 and other.status()["running"]
    with pytest.raises(Busy):
        other.index(str(folder))
    assert engine.cancel() and not other.cancel()
    run.join(120)
    assert out["status"] == "cancelled" and out["indexed"] == 7 and not engine.status()["running"]
    assert {k for k, v in states(other).items() if v[0] != "done"} == {"slow.mp4"} and other.search("gardening")["total"] == 1
    gate.write_text("")
    again = engine.index(str(folder))
    assert (again["status"], again["queued"], again["indexed"]) == ("finished", 1, 1) and {v[0] for v in states(other).values()} == {"done"}
    assert [r.status for r in other.store.read("runs").orderBy("run_id").collect()] == ["cancelled", "finished"]
    assert set(again) == {"status", "scanned", "new", "changed", "unchanged", "queued", "unsupported", "processed", "reused", "indexed", "failed"}


def test_a_failed_run_gives_its_claim_back_and_deltas_stay_small(spark, media, tmp_path, monkeypatch):
    folder = media({f"a/{k}.png": f"IMG\n{k} 5 250" for k in range(40)})
    engine = Engine(spark, str(tmp_path / "index"), Settings(), PlainEmbedder(), OPENERS, pause=0.0)
    engine.index(str(folder))
    media({"a/3.png": "IMG\n3 5 251 "})
    with monkeypatch.context() as m:
        m.setattr(engine_module.analysis, "analysed", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.index(str(folder))
    assert not engine.status()["running"]
    assert engine.index(str(folder))["indexed"] == 1
    last = {name: spark.read.parquet(layers[-1]["rows"]).count() for name, layers in engine.store.manifest().items() if len(layers) > 1}
    assert last["files"] == 1 and all(n <= 1 for n in last.values())
    assert engine.store.read("assets").count() == engine.store.read("vectors").count() == 40


def test_packed_vectors_find_the_same(spark, media, tmp_path):
    folder = media({f"a/{k}.png": f"IMG\n{250 - k} {k} 5" for k in range(30)})
    plain, packed = (Engine(spark, str(tmp_path / "index"), Settings(), PlainEmbedder(), OPENERS, pause=0.0, packed=size) for size in (1 << 40, 0))
    plain.index(str(folder))
    for query in ("red", "green picture"):
        one, two = plain.search(query, limit=100), packed.search(query, limit=100)
        assert one["results"] == two["results"] and one["total"] == two["total"] == (30 if query == "red" else 0)
    assert len([x for x in os.listdir(tmp_path / "index" / "packed") if not x.startswith(".")]) == 1
