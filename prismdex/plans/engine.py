"""The engine: indexing runs from snapshot to snapshot, and searches, over the operators."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prismdex import schemas
from prismdex.functions import text as text_
from prismdex.functions.stems import porter, stemmed_words
from prismdex.operators import catalogue, ingest, retrieval, text_index
from prismdex.operators.path_index import PathIndex
from prismdex.operators.vector_store import VectorStore
from prismdex.plans import analysis
from prismdex.settings import Settings
from prismdex.sources import listing as listing_
from prismdex.sources import committed, scratch
from prismdex.sources.decoders import PAUSE
from prismdex.sources.embedders import Embedder
from prismdex.sources.embedders import embedder as make_embedder
from prismdex.sources.snapshots import Claim, Delta, Snapshots

#: Contents that are analysed between two commits; share of withdrawn texts from which the text index is built anew.
BATCH, WORN = 50_000, 0.3
#: Bytes of vectors, or of the table of files, from which searches go through packed blocks or the index of paths; fewer are scanned.
PACKED = 64 << 20


class Engine:
    """``openers`` and ``embedder`` are sent to the executors; by default those of the libraries found there.

    One run at a time writes to ``root``: a second one is refused (``snapshots.Busy``), whichever process it is in.  A run commits after every ``batch`` contents, so a
    run that is cancelled or dies leaves what it has done, and the next one does the rest.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embedder: Embedder | None = None, openers: dict[str, Callable] | None = None, pause: float = PAUSE, batch: int = BATCH, packed: int = PACKED):
        self.spark, self.settings, self.store = spark, settings or Settings(), Snapshots(spark, root)
        self.embedder, self.openers, self.pause, self.batch, self.packed = embedder or make_embedder(self.settings.model_backend), openers, pause, batch, packed
        self._stop, self._tag, self._progress = threading.Event(), None, {}

    # ------------------------------------------------------------ indexing
    def index(self, media_dir: str | None = None, retry_failed: bool = False, force: bool = False, reanalyse: bool = False) -> dict:
        return self.apply(listing_.listing(self.spark, media_dir or self.settings.media_dir), retry_failed, force, reanalyse)

    def apply(self, listing: DataFrame, retry_failed: bool = False, force: bool = False, reanalyse: bool = False, complete: bool = True) -> dict:
        """One run over a listing: classify, hash, reuse, analyse, store, collect garbage; returns its counters and status.

        force queues every supported file, but content that is ready is linked and not analysed again unless ``reanalyse`` is set too.  Files that a complete listing
        lacks are gone; one of arrivals says nothing about others.
        """
        run = _Run(self, self.store.claim())
        context = self.spark.sparkContext
        self._stop.clear()
        self._tag, self._progress = f"prismdex-{run.claim.owner}", {"began": run.began, "total": None, "done": 0}
        context.addJobTag(self._tag)
        try:
            run.classify(listing, retry_failed, force, reanalyse, complete)
            for part in run.parts():
                if self._stop.is_set():
                    break
                run.batch(*part)
            return run.finish("cancelled" if self._stop.is_set() else "finished")
        except Exception:
            if self._stop.is_set():  # a job was cut off; what was committed stays
                context.removeJobTag(self._tag)
                return run.finish("cancelled")
            self.store.release(run.claim)
            raise
        finally:
            if self._tag in context.getJobTags():
                context.removeJobTag(self._tag)
            self._tag = None

    def cancel(self) -> bool:
        """Ends the run of this engine, from another thread: its jobs are cut off, and nothing after the last commit is kept.  Whether there was one."""
        tag = self._tag
        if tag is None:
            return False
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(tag)
        return True

    def status(self) -> dict:
        """running (here or elsewhere), since (epoch seconds), and of a run of this engine: done and total contents, rate (a second) and eta (seconds)."""
        claimed = self.store.claimed()
        out = {"running": claimed is not None, "since": claimed and claimed["began"], "done": None, "total": None, "rate": None, "eta": None}
        if self._tag and self._progress.get("total") is not None:
            p = self._progress
            done = p["done"] + p.get("batch", 0) * self._share_of_tasks()
            rate = done / max(time.time() - p["analysing"], 1e-3)
            out |= {"done": int(done), "total": p["total"], "rate": rate, "eta": (p["total"] - done) / rate if rate else None}
        return out

    def _share_of_tasks(self) -> float:
        """Tasks that have ended, of the stages that are running."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [x for k in tracker.getActiveStageIds() if (x := tracker.getStageInfo(k))]
        return sum(x.numCompletedTasks for x in stages) / max(sum(x.numTasks for x in stages), 1)

    @staticmethod
    def stemmed(vectors: DataFrame) -> DataFrame:
        """(vid, asset_id, words) of the texts among vectors."""
        return vectors.where("space = 'text' AND text IS NOT NULL").select("vid", "asset_id", stemmed_words(F.col("text")).alias("words"))

    # ------------------------------------------------------------ queries
    def thumbnail(self, path: str) -> bytes | None:
        """The JPEG that a result names as its ``thumb``."""
        found = self.store.read("thumbs").where(F.col("path") == path).select("jpeg").first()
        return found and bytes(found.jpeg)

    def export_thumbnails(self, folder: str) -> None:
        """The JPEG files of the newest version as one batch of a folder, named after the version: done once for it, and in place of batches before it."""
        version = max(self.store.versions(), default=0)
        committed.write(self.store.read("thumbs").where("jpeg IS NOT NULL").select(F.col("path").alias("name"), F.col("jpeg").alias("content")), folder, "files", f"v{version:012d}", "overwrite")

    def _cuts(self, signal: str) -> tuple[float, float]:
        """Floor and margin of a signal: those of the settings, else of the embedder."""
        floor, margin = getattr(self.settings, f"{signal}_min_score"), getattr(self.settings, f"{signal}_margin")
        return self.embedder.floors[signal] if floor is None else floor, self.embedder.margins[signal] if margin is None else margin

    def _spaces(self, *queries: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        assets, vectors = self.store.read("assets"), self.store.read("vectors")
        current = catalogue.current_vectors(vectors, assets, self.embedder.pipeline)
        rows = self.spark.createDataFrame(list(enumerate(queries)), "qid int, text string")
        asked = {s: rows.select("qid", x["vector"].alias("vector")) for s, x in (("clip", self.embedder.visual_query(F.col("text"))), ("text", self.embedder.text(F.col("text"))))}
        return {s: current.where(F.col("space") == s) for s in asked}, asked

    def _nearest(self, signal: str, vectors: DataFrame, asked: DataFrame, allowed: DataFrame) -> DataFrame:
        """Candidates of a signal: by a scan where vectors are few, else from packed blocks, which are made once for a version of the vectors."""
        layers = self.store.manifest()
        if sum(x["bytes"] for x in layers["vectors"]) < self.packed:
            return retrieval.nearest(vectors, asked, allowed)
        depends = json.dumps([signal, self.embedder.pipeline, layers["vectors"], layers["assets"]])
        store = VectorStore.opened(vectors.select("vid", "asset_id", "vector"), f"{self.store.root}/packed", hashlib.sha256(depends.encode()).hexdigest()[:32])
        return store.nearest(asked, allowed)[0]

    def _find(self) -> Callable[[str], DataFrame] | None:
        """Present files by a part of their path, from an index that is made once for a version of the files; None where they are few."""
        layers = self.store.manifest()["files"]
        if sum(x["bytes"] for x in layers) < self.packed:
            return None
        files = self.store.read("files").where("present").select("path", "asset_id")
        return PathIndex.opened(files, f"{self.store.root}/paths", hashlib.sha256(json.dumps(layers).encode()).hexdigest()[:32]).find

    def search(self, query: str, filters: retrieval.Filters = retrieval.Filters(), limit: int = 24, offset: int = 0) -> dict:
        """The envelope of a search: query, total, offset, limit, intent, facets, signals, took_ms and results."""
        query, began = (query or "").strip(), time.perf_counter()
        if not query:
            raise ValueError("empty query")
        assets, files, vectors = (self.store.read(n) for n in ("assets", "files", "vectors"))
        allowed = retrieval.allowed_assets(assets, files, self.embedder.pipeline, filters, self._find() if filters.folder else None).persist()
        spaces, asked = self._spaces(query)
        hits = {}
        if allowed.limit(1).count():
            for s in ("clip", "text"):
                if not spaces[s].isEmpty():
                    hits[s] = retrieval.cut_and_rank(retrieval.best_per_asset(self._nearest(s, spaces[s], asked[s], allowed), 9), *self._cuts(s)).persist()
            one = self.spark.createDataFrame([(0, query)], "qid int, text string")
            terms = [porter(t) for t in one.select(text_.query_terms(F.col("text")).alias("t")).first().t]
            if terms and self.store.versions():
                asked_terms = self.spark.createDataFrame([(0, t) for t in terms], "qid int, term string")
                scored = text_index.search(self.store.read("text_index"), asked_terms, allowed, self.store.read("text_places"), self.store.read("text_counts"))
                hits["kw"] = retrieval.keyword_cut(scored).persist()
        intents = self.spark.createDataFrame([(0, query)], "qid int, text string").select("qid", text_.intents(F.col("text")).alias("intents"))
        out = {"query": query, "total": 0, "offset": offset, "limit": limit, "intent": [] if filters.types else intents.first().intents, "facets": {}, "signals": {}, "results": []}
        if hits:
            rows = retrieval.ranked(retrieval.boost_intent(retrieval.fuse(hits, self.embedder.bounds), assets, None if filters.types else intents)).persist()
            out |= {"total": rows.count(), "facets": {r.type: r.n for r in retrieval.facets(rows).collect()}, "signals": dict.fromkeys(hits, 0) | {r.signal: r.n for r in retrieval.signal_sizes(hits).collect()}}
            out["results"] = [r.asDict(True) for r in catalogue.hydrated(retrieval.page(rows, limit, offset), assets, files, vectors).collect()]
            for x in (rows, *hits.values()):
                x.unpersist()
        allowed.unpersist()
        return out | {"took_ms": round((time.perf_counter() - began) * 1000, 1)}

    def raw_tops(self, queries: list[str]) -> DataFrame:
        """(qid: place in the list, signal, top): the highest similarity of each, without floor or filter."""
        spaces, asked = self._spaces(*queries)
        return retrieval.raw_tops({s: retrieval.nearest(spaces[s], asked[s], most=1, per_asset=False, digits=None) for s in spaces})

    def raw_top(self, query: str) -> dict[str, float]:
        return {r.signal: r.top for r in self.raw_tops([query]).collect()}

    def stats(self) -> dict:
        assets, files, vectors = (self.store.read(n) for n in ("assets", "files", "vectors"))
        return {
            "by_type": {r.type: r.asDict() for r in catalogue.stats_by_type(assets, files).collect()}, "states": {r.state: r.n for r in catalogue.files_by_state(files).collect()}, "duplicate_groups": catalogue.duplicate_count(files).first()[0],
            "total_bytes": catalogue.total_bytes(files).first()[0], "vectors": {r.space: r.n for r in catalogue.vectors_by_space(vectors).collect()}, "ready": {r.type: r.n for r in catalogue.ready_assets_by_type(assets).collect()},
        }

    def files(self, states: list[str] | None = None, limit: int = 200, offset: int = 0) -> list[dict]:
        return [r.asDict() for r in catalogue.listed_files(self.store.read("files"), states, limit, offset).collect()]

    def duplicates(self) -> list[dict]:
        return [r.asDict() for r in catalogue.duplicate_groups(self.store.read("files")).orderBy(F.col("n").desc(), "asset_id").collect()]


class _Run:
    """The steps of a run, which hold its claim, counters and tables."""

    def __init__(self, engine: Engine, claim: Claim):
        self.engine, self.store, self.claim, self.began = engine, engine.store, claim, time.time()
        self.spark, self.counters, self.first = engine.spark, {}, True

    def classify(self, listing: DataFrame, retry_failed: bool, force: bool, reanalyse: bool, complete: bool) -> None:
        """What has changed, and which contents are to be analysed; counted while it is written."""
        self.pipeline = self.engine.embedder.pipeline
        self.old, self.assets = self.store.read("files"), self.store.read("assets")
        files = ingest.requeue_stale(ingest.recovered(self.old), self.assets, self.pipeline)
        seen, found = Observation(), Observation()
        classified = scratch.written(ingest.classified(files, listing, retry_failed, force).observe(seen, *ingest.counters()), "classified")
        self.counters |= seen.get
        self.files = ingest.mark_missing(classified) if complete else classified
        pending = self.files.where("present AND state = 'pending'").select("path", "ext", "size")
        self.pending = scratch.written(listing_.hashed(pending), "pending")
        reused, work = ingest.split_reuse(self.pending.where("sha256 IS NOT NULL"), self.assets.limit(0) if reanalyse else self.assets, self.pipeline)
        self.reused = reused.select("path", "reused_asset")
        counts = [F.count_if(F.col("priority") == k).alias(f"n{k}") for k in range(4)]
        self.work = scratch.written(work.select("sha256", "path", "ext", "size", "priority").observe(found, F.count("*").alias("n"), *counts), "work")
        self.counts = found.get
        self.engine._progress |= {"total": self.counts["n"], "analysing": time.time()}

    def parts(self) -> list[tuple[DataFrame, float]]:
        """Batches of contents, pictures first, each with its number of contents in the mean; all in one where they are few.  An empty one lets copies and other changes be stored."""
        if self.counts["n"] <= self.engine.batch:
            return [(self.work, self.counts["n"])]
        out = []
        for k in range(4):
            of = -(-self.counts[f"n{k}"] // self.engine.batch)
            out += [(self.work.where((F.col("priority") == k) & (F.pmod(F.xxhash64("sha256"), F.lit(of)) == i)), self.counts[f"n{k}"] / of) for i in range(of)]
        return out

    def batch(self, work: DataFrame, number: float) -> None:
        """Analyses contents and commits them with their files; the first batch brings all other changes of files along."""
        engine, counted = self.engine, Observation()
        engine._progress["batch"] = number
        found = analysis.analysed(work, engine.settings, engine.embedder, engine.openers, engine.pause) if self.counts["n"] else None
        told = found.outcome if found else self.spark.createDataFrame([], "sha256 string, path string, ok boolean, error_kind string, error string")
        queued = self.pending.join(work.select("sha256"), "sha256", "left_semi") if not self.first else self.pending.join(self.work.select("sha256"), "sha256", "left_anti").unionByName(self.pending.join(work.select("sha256"), "sha256", "left_semi"))
        outcome = queued.select("path", "sha256").join(self.reused, "path", "left").join(told.select("sha256", F.col("path").alias("analysed"), "ok", "error_kind", "error"), "sha256", "left")
        done, gone = F.col("reused_asset").isNotNull() | F.coalesce("ok", F.lit(False)), F.col("sha256").isNull()
        state = ingest.error_state(F.col("error_kind"), F.col("error"))
        outcome = outcome.select(
            "path", F.when(done | (F.col("error_kind") == "embedder"), F.coalesce("reused_asset", "sha256")).alias("new_asset"), (F.col("reused_asset").isNotNull() | (done & (F.col("path") != F.col("analysed")))).alias("was_reused"),
            F.when(done, "done").when(gone, "failed").otherwise(state["state"]).alias("new_state"), F.when(gone, "file has vanished").when(~done, state["error"]).alias("new_error"), gone.alias("gone"),
        )
        outcome = scratch.written(outcome.observe(counted, *ingest.outcome_counters()), "outcome")
        for k, n in counted.get.items():
            self.counters[k] = self.counters.get(k, 0) + n
        touched = F.col("new_state").isNotNull()
        joined = self.files.join(outcome, "path", "left" if self.first else "inner")
        files = joined.select(
            "path", "folder", "name", "ext", "size", "mtime_ns", F.coalesce("new_asset", "asset_id").alias("asset_id"), F.coalesce("new_state", "state").alias("state"), F.when(touched, F.col("new_error")).otherwise(F.col("error")).alias("error"),
            F.when(touched, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(F.col("gone"), False).otherwise(F.col("present")).alias("present"),
        )
        was = self.old.select(F.col("path").alias("was_path"), F.struct(*self.old.columns).alias("was"))
        files = files.join(was, F.col("path") == F.col("was_path"), "left").where(~F.struct(*self.old.columns).eqNullSafe(F.col("was"))).select(*self.old.columns)
        changes = {"files": Delta(files, "path")}
        assets, vectors, thumbs = analysis.tables(found, self.pipeline, self.began) if found else (None, None, None)
        if found and not assets.isEmpty():
            fresh = scratch.written(ingest.updated_assets(self.store.read("assets"), assets), "assets")
            ready = fresh.where("status = 'ready'").select(F.col("asset_id").alias("key"))
            new = scratch.written(vectors, "vectors")
            changes |= {"assets": Delta(fresh, "asset_id"), "vectors": Delta(new, "asset_id", ready), "thumbs": Delta(thumbs.select("path", "asset_id", "jpeg"), "asset_id", ready)}
            changes |= self._texts(new, self.store.read("vectors").join(ready, F.col("asset_id") == F.col("key"), "left_semi"))
        self.claim = self.store.commit(changes, claim=self.claim, go_on=True)
        self.first = False
        engine._progress["done"] += engine._progress.pop("batch")

    def _texts(self, new: DataFrame, old: DataFrame) -> dict[str, Delta]:
        """Changes of the text index: texts of ``new`` vectors come, those of ``old`` ones go."""
        out = {"text_index": Delta(text_index.built(self.engine.stemmed(new), self.claim.version))}
        if not old.isEmpty():
            places, counts = text_index.withdrawn(self.store.read("text_index"), scratch.written(self.engine.stemmed(old), "withdrawn"))
            out |= {"text_places": Delta(places), "text_counts": Delta(counts)}
        return out

    def finish(self, status: str) -> dict:
        """Records the run; a finished one takes out what no file refers to and builds the text index anew where much of it was withdrawn."""
        changes: dict[str, DataFrame | Delta] = {}
        if status == "finished" and self.counters.get("processed"):  # else no file has got another content
            assets, files, vectors = (self.store.read(n) for n in ("assets", "files", "vectors"))
            orphans = scratch.written(catalogue.orphans(assets, files).select(F.col("asset_id").alias("key")), "orphans")
            if not orphans.isEmpty():
                lost = vectors.join(orphans, F.col("asset_id") == F.col("key"), "left_semi")
                changes = {n: Delta(self.store.read(n).limit(0), "asset_id", orphans) for n in ("assets", "vectors", "thumbs")} | self._texts(vectors.limit(0), lost)
            texts = self.store.read("text_index").where("term IS NULL").agg(F.sum("n")).first()[0] or 0
            if self.store.read("text_places").count() > WORN * texts:
                kept = vectors.join(orphans, F.col("asset_id") == F.col("key"), "left_anti")
                changes |= {"text_index": text_index.built(self.engine.stemmed(kept), self.claim.version)} | {n: self.store.read(n).limit(0) for n in ("text_places", "text_counts")}
        zero = dict.fromkeys(("scanned", "new", "changed", "unchanged", "queued", "unsupported", "processed", "reused", "indexed", "failed", "refused"), 0)
        summary = zero | self.counters
        summary["unsupported"] += summary.pop("refused")
        row = (int(self.began * 1000), self.began, time.time(), status, json.dumps(summary))
        self.store.commit(changes | {"runs": Delta(self.spark.createDataFrame([row], schemas.RUNS))}, claim=self.claim)
        return summary | {"status": status}
