"""Every registered query over the sample tables, with its SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismdex.functions import media, stems, text as text_, vectors
from prismdex.operators import catalogue, evaluation, folds, ingest, retrieval, text_index
from prismdex.plans import oracles as o
from prismdex.operators.path_index import PathIndex
from prismdex.operators.vector_store import VectorStore
from prismdex.plans import sample, search
from prismdex.sources import scratch
from prismdex.sources.snapshots import Delta, Snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _hits(df: DataFrame) -> DataFrame:
    return df.select("qid", "asset_id", "vid", F.round("raw", 6).alias("raw"), "rank")


def _hits_sql(ctes: str, name: str) -> str:
    return f"WITH {ctes} SELECT qid, asset_id, vid, round(raw, 6) AS raw, rank FROM {name}"


# ------------------------------------------------------------------ search
@query(f"WITH RECURSIVE {o.FUSED} SELECT qid, place, asset_id, type, best_signal, round(score, 9) AS score, round(confidence, 6) AS confidence FROM placed WHERE place < 24")
def hybrid_search(spark, d):
    """Metadata filter, three signals, cuts, rank fusion, intent boost and the first page, for every benchmark passage."""
    return retrieval.page(search.hybrid(spark, d), 24).select("qid", "place", "asset_id", "type", "best_signal", F.round("score", 9).alias("score"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH RECURSIVE {o.FUSED} SELECT qid, place, asset_id, round(relative, 6) AS relative FROM placed WHERE place >= 5 AND place < 15")
def paged_results(spark, d):
    return retrieval.page(search.hybrid(spark, d), 10, 5).select("qid", "place", "asset_id", F.round("relative", 6).alias("relative"))


@query(f"WITH RECURSIVE {o.FUSED} SELECT qid, type, count(*) AS n FROM placed GROUP BY ALL")
def search_facets(spark, d):
    return retrieval.facets(search.hybrid(spark, d))


@query(f"WITH RECURSIVE {o.FUSED} SELECT qid, count(*) AS total, round(max(score), 9) AS top FROM placed GROUP BY qid")
def search_totals(spark, d):
    return search.hybrid(spark, d).groupBy("qid").agg(F.count("*").alias("total"), F.round(F.max("score"), 9).alias("top"))


@query(f"WITH RECURSIVE {o.FUSED} SELECT qid, asset_id, round(score, 9) AS score, round(confidence, 4) AS confidence, best_signal FROM fused")
def rrf_fusion(spark, d):
    return retrieval.fuse(search.signals(spark, d), search.BOUNDS).select("qid", "asset_id", F.round("score", 9).alias("score"), F.round("confidence", 4).alias("confidence"), "best_signal")


@query(f"WITH RECURSIVE {o.SIGNALS} SELECT qid, 'clip' AS signal, count(*) AS n FROM clip GROUP BY qid UNION ALL SELECT qid, 'text', count(*) FROM text GROUP BY qid UNION ALL SELECT qid, 'kw', count(*) FROM kw GROUP BY qid")
def signal_sizes(spark, d):
    return retrieval.signal_sizes(search.signals(spark, d))


@query(f"""WITH RECURSIVE {o.FUSED}, own AS (SELECT asset_id, list(path ORDER BY path) AS paths FROM files WHERE present GROUP BY asset_id)
SELECT p.qid, place, p.asset_id, round(relative, 4) AS score, paths[1] AS first_path, CAST(len(paths) - 1 AS INT) AS duplicates,
  CASE WHEN length(c.text) > 300 THEN substr(c.text, 1, 300) || '…' ELSE c.text END AS snippet
FROM placed p JOIN own USING (asset_id) LEFT JOIN text t ON t.qid = p.qid AND t.asset_id = p.asset_id LEFT JOIN kw k ON k.qid = p.qid AND k.asset_id = p.asset_id LEFT JOIN chunks c ON c.vid = coalesce(t.vid, k.vid) WHERE place < 24""")
def hydrated_page(spark, d):
    """The first page with files and text matches."""
    none = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    page = scratch.written(retrieval.page(search.hybrid(spark, d), 24), "page")
    every = sample.chunks(spark, d, only=page).select("vid", "asset_id", F.lit("chunk").alias("kind"), F.lit(None).cast("double").alias("ref"), "text", *none("thumb"))
    assets = sample.assets(spark, d).select("*", *none("width", "height", "duration", "pages", "mime", "thumb", "warnings", "meta"))
    rows = catalogue.hydrated(page, assets, sample.files(spark, d), every)
    return rows.select("qid", "place", "asset_id", "score", F.col("files")[0]["path"].alias("first_path"), "duplicates", F.col("text_match.snippet").alias("snippet"))


@query(_hits_sql(f"{o.LABELLED}, {o.SIMS}, {o.hits('sims', 'h', 'true')}", "h") + " WHERE rank < 10")
def vector_topk(spark, d):
    """The ten nearest of all embeddings for every hundredth one."""
    sims = retrieval.nearest(sample.labelled(spark, d), sample.picture_queries(spark, d), most=10, per_asset=False, digits=None)
    return _hits(retrieval.cut_and_rank(sims, most=10))


@query(_hits_sql(f"{o.LABELLED}, {o.SIMS}, {o.best('sims', 'b')}, {o.hits('b', 'h', 'true')}", "h"))
def vector_best_per_asset(spark, d):
    sims = retrieval.nearest(sample.labelled(spark, d), sample.picture_queries(spark, d))
    return _hits(retrieval.cut_and_rank(retrieval.best_per_asset(sims, 9)))


@query(_hits_sql(f"{o.ALLOWED}, {o.PICTURES}, {o.ASKED}, {o.SIMS}, s AS (SELECT * FROM sims SEMI JOIN allowed USING (asset_id)), {o.best('s', 'b')}, {o.hits('b', 'h', o.near(0.15, 0.2))}", "h"))
def vector_floor_margin(spark, d):
    sims = retrieval.nearest(sample.pictures(spark, d), sample.queries(spark, d), search.allowed(spark, d))
    return _hits(retrieval.cut_and_rank(retrieval.best_per_asset(sims, 9), 0.15, 0.2))


@query(ORACLES["vector_topk"])
def vector_store_topk(spark, d):
    """The same rows from packed blocks, of which those that cannot matter are not read."""
    store = VectorStore.opened(sample.labelled(spark, d), scratch.new_path(spark, "vectors"), "embeddings")
    return _hits(retrieval.cut_and_rank(store.nearest(sample.picture_queries(spark, d), most=10, per_asset=False, digits=None)[0], most=10))


@query(ORACLES["vector_floor_margin"])
def vector_store_hits(spark, d):
    """Filtered hits from packed blocks."""
    store = VectorStore.opened(sample.pictures(spark, d), scratch.new_path(spark, "vectors"), "pictures")
    found, _ = store.nearest(sample.queries(spark, d), search.allowed(spark, d))
    return _hits(retrieval.cut_and_rank(retrieval.best_per_asset(found), 0.15, 0.2))


@query(f"WITH {o.DOCS}, {o.PICTURES}, {o.ASKED}, {o.SIMS} SELECT qid, 'clip' AS signal, round(max(raw), 6) AS top FROM sims GROUP BY qid")
def raw_top(spark, d):
    sims = retrieval.nearest(sample.pictures(spark, d), sample.queries(spark, d), most=1, per_asset=False, digits=None)
    return retrieval.raw_tops({"clip": sims}).withColumn("top", F.round("top", 6))


@query(f"WITH RECURSIVE {o.DOCS}, {o.CHUNKS}, {o.ASKED}, {o.buckets('chunks', 'vid, asset_id', 'cb')}, {o.buckets('asked', 'qid', 'qb')}, tsims AS (SELECT qid, asset_id, vid, sum(cb.weight * qb.weight) AS raw FROM cb JOIN qb USING (bucket) GROUP BY qid, asset_id, vid), {o.best('tsims', 'b')}, {o.hits('b', 'h', o.near(0.15, 0.6))} SELECT qid, asset_id, vid, round(raw, 6) AS raw, rank FROM h")
def text_vector_hits(spark, d):
    """Hashed word vectors of all chunks against those of the queries."""
    found = retrieval.nearest(sample.bucketed(sample.chunks(spark, d), "vid", "asset_id"), sample.bucketed(sample.queries(spark, d), "qid"), matrix=retrieval.hashed)
    return _hits(retrieval.cut_and_rank(retrieval.best_per_asset(found, 9), 0.15, 0.6))


_BM = f"{o.ALLOWED}, {o.CHUNKS}, {o.ASKED}, {o.TERMS}, {o.POSTINGS}, {o.BM25}"


@query(f"WITH RECURSIVE {_BM} SELECT qid, asset_id, vid, round(raw, 6) AS raw FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, vid, asset_id) <= 50")
def bm25_scores(spark, d):
    """The fifty best chunks of each query."""
    scored = retrieval.bm25_best(sample.worded(sample.chunks(spark, d)), sample.terms(sample.queries(spark, d)), most=50, per_asset=False)
    return retrieval.cut_and_rank(scored, most=50).select("qid", "asset_id", "vid", F.round("raw", 6).alias("raw"))


@query(f"WITH RECURSIVE {_BM}, s AS (SELECT * FROM bm SEMI JOIN allowed USING (asset_id)), {o.best('s', 'b')}, {o.hits('b', 'h', 'raw >= 0.5 * first')} SELECT qid, asset_id, vid, round(raw, 6) AS raw, rank FROM h")
def bm25_keyword(spark, d):
    return _hits(retrieval.keyword_cut(retrieval.bm25_best(sample.worded(sample.chunks(spark, d)), sample.terms(sample.queries(spark, d)), search.allowed(spark, d))))


@query(ORACLES["bm25_keyword"])
def bm25_postings(spark, d):
    """The same over a table of postings, as the engine keeps one."""
    posted, lengths = sample.postings(sample.chunks(spark, d))
    posted = scratch.written(posted, "postings")
    return _hits(retrieval.keyword_cut(retrieval.bm25_posted(posted, lengths, sample.terms(sample.queries(spark, d)), search.allowed(spark, d))))


@query(ORACLES["bm25_keyword"])
def text_index_keyword(spark, d):
    """The same from an index of blocks with bounds."""
    index = scratch.written_by_bytes(text_index.built(sample.worded(sample.chunks(spark, d))), "text-index")
    return _hits(retrieval.keyword_cut(text_index.search(index, sample.terms(sample.queries(spark, d)), search.allowed(spark, d))))


@query(ORACLES["bm25_keyword"])
def text_index_deltas(spark, d):
    """The same from an index that was built from two thirds of the assets, some with other texts, and brought up to date by withdrawing and adding."""
    texts = scratch.written_by_bytes(sample.worded(sample.chunks(spark, d)), "words")
    other = F.when(F.col("asset_id") % 5 == 0, F.trim(F.concat("words", F.lit(" outdated the")))).otherwise(F.col("words"))
    old = texts.where("asset_id % 3 <> 0").withColumn("words", other)
    first = scratch.written_by_bytes(text_index.built(old, 1), "text-index")
    places, counts = (scratch.written(x, "withdrawn") for x in text_index.withdrawn(first, old.where("asset_id % 5 = 0").withColumn("words", text_.split_tokens(F.col("words")))))
    index = first.union(scratch.written_by_bytes(text_index.built(texts.where("asset_id % 3 = 0 OR asset_id % 5 = 0"), 2), "text-index"))
    return _hits(retrieval.keyword_cut(text_index.search(index, sample.terms(sample.queries(spark, d)), search.allowed(spark, d), places, counts)))


@query(f"WITH RECURSIVE {_BM}, firsts AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, vid) <= 600), s AS (SELECT * FROM firsts SEMI JOIN allowed USING (asset_id)), {o.best('s', 'b')}, {o.hits('b', 'h', 'raw >= 0.5 * first')} SELECT qid, asset_id, vid, round(raw, 6) AS raw, rank FROM h")
def bm25_limit_first(spark, d):
    """The original order of steps: 600 rows first, the filter after."""
    scored = retrieval.bm25_best(sample.worded(sample.chunks(spark, d)), sample.terms(sample.queries(spark, d)), most=600, per_asset=False)
    return _hits(retrieval.keyword_hits(scored, search.allowed(spark, d), 600))


@query()
def bm25_stemmed(spark, d):
    """BM25 over Porter stems of Unicode words; the tests compare it with an independent full-text engine."""
    words = sample.chunks(spark, d).select("vid", "asset_id", stems.stemmed_words(F.col("text")).alias("words"))
    asked = sample.queries(spark, d).select("qid", F.explode(stems.stemmed_words(F.array_join(text_.query_terms(F.col("text")), " "))).alias("term"))
    return _hits(retrieval.keyword_cut(retrieval.bm25_best(words, asked, search.allowed(spark, d))))


@query(f"WITH {o.ASSETS} SELECT asset_id FROM assets a WHERE status = 'ready' AND pipeline = 'p2' AND type IN ('pdf', 'image') AND ext IN ('.jpg', '.pdf') AND size BETWEEN 200 AND 5000 AND indexed_ts BETWEEN 1700010000 AND 1702000000 AND EXISTS (SELECT 1 FROM files f WHERE f.asset_id = a.asset_id AND present AND contains(translate(path, {o.UPPER}, {o.LOWER}), 'src1'))")
def metadata_filter(spark, d):
    return search.allowed(spark, d, retrieval.Filters(("pdf", "image"), ("jpg", ".pdf"), 200, 5000, "SRC1", 1700010000.0, 1702000000.0))


@query(f"WITH {o.ALLOWED} SELECT asset_id FROM allowed a WHERE EXISTS (SELECT 1 FROM files f WHERE f.asset_id = a.asset_id AND present AND contains(path, '/en/1'))")
def folder_substring(spark, d):
    return search.allowed(spark, d, retrieval.Filters(folder="/EN/1"))


@query(f"""WITH {o.FILES}, asked AS (
  SELECT doc_id AS qid, CASE doc_id // 100 % 4 WHEN 0 THEN '/' || upper(lang) || '/' || doc_id % 97 WHEN 1 THEN right(CAST(doc_id AS VARCHAR), 2) || '.J' WHEN 2 THEN '.p' ELSE source END AS pattern FROM documents WHERE doc_id % 100 = 0)
SELECT qid, count(*) AS n, min(path) AS first_path, count(DISTINCT asset_id) AS assets FROM asked JOIN files ON present AND contains(translate(path, {o.UPPER}, {o.LOWER}), translate(pattern, {o.UPPER}, {o.LOWER})) GROUP BY qid""")
def path_index_substrings(spark, d):
    """Files by parts of their paths, from the index of paths; the parts follow from every hundredth document: beginnings of names, ends, two characters, folders."""
    index = PathIndex.opened(sample.files(spark, d).where("present").select("path", "asset_id"), scratch.new_path(spark, "paths"), "v")
    kind, digits = F.floor(F.col("doc_id") / 100) % 4, F.col("doc_id").cast("string")
    pattern = F.when(kind == 0, F.concat(F.lit("/"), F.upper("lang"), F.lit("/"), (F.col("doc_id") % 97).cast("string"))).when(kind == 1, F.concat(F.right(digits, F.lit(2)), F.lit(".J"))).when(kind == 2, ".p").otherwise(F.col("source"))
    asked = sample.table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), pattern.alias("pattern"))
    found = index.matches(asked).groupBy("pattern").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.count_distinct("asset_id").alias("assets"))
    return asked.join(found, retrieval.ascii_lower(asked["pattern"]) == found["pattern"]).select("qid", "n", "first_path", "assets")


@query(ORACLES["folder_substring"])
def path_index_folder(spark, d):
    """The assets of ``folder_substring`` with the files from the index of paths."""
    files = sample.files(spark, d)
    index = PathIndex.opened(files.where("present").select("path", "asset_id"), scratch.new_path(spark, "paths"), "v")
    return retrieval.allowed_assets(sample.assets(spark, d), files, sample.PIPELINE, retrieval.Filters(folder="/EN/1"), index.find)


# ------------------------------------------------------------------ catalogue
@query(f"WITH {o.FILES} SELECT state, count(*) AS n FROM files WHERE present GROUP BY state")
def files_by_state(spark, d):
    return catalogue.files_by_state(sample.files(spark, d))


@query(f"WITH {o.ASSETS} SELECT type, count(DISTINCT a.asset_id) AS assets, count(*) AS files, CAST(sum(a.size) AS BIGINT) AS bytes FROM files f JOIN assets a USING (asset_id) WHERE present GROUP BY type")
def stats_by_type(spark, d):
    return catalogue.stats_by_type(sample.assets(spark, d), sample.files(spark, d))


@query(f"WITH {o.ASSETS} SELECT type, count(*) AS n FROM assets WHERE status = 'ready' GROUP BY type")
def ready_assets_by_type(spark, d):
    return catalogue.ready_assets_by_type(sample.assets(spark, d))


@query(f"WITH {o.FILES} SELECT count(*) AS duplicate_groups FROM (SELECT asset_id FROM files WHERE present GROUP BY asset_id HAVING count(*) > 1)")
def duplicate_count(spark, d):
    return catalogue.duplicate_count(sample.files(spark, d))


@query(f"WITH {o.FILES} SELECT asset_id, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM files WHERE present GROUP BY asset_id HAVING count(*) > 1 ORDER BY n DESC, asset_id LIMIT 200")
def duplicate_groups(spark, d):
    return catalogue.duplicate_groups(sample.files(spark, d)).withColumn("paths", F.array_join("paths", "|"))


@query(f"WITH {o.FILES} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM files WHERE present")
def total_bytes(spark, d):
    return catalogue.total_bytes(sample.files(spark, d))


@query(f"WITH RECURSIVE {o.DOCS}, {o.CHUNKS}, {o.PICTURES} SELECT 'text' AS space, count(*) AS n FROM chunks UNION ALL SELECT 'clip', count(*) FROM pictures")
def vectors_by_space(spark, d):
    both = sample.chunks(spark, d).select(F.lit("text").alias("space")).union(sample.pictures(spark, d).select(F.lit("clip")))
    return catalogue.vectors_by_space(both)


@query(f"WITH {o.FILES} SELECT path, state, error FROM files WHERE present AND state IN ('failed', 'unsupported') ORDER BY state, path LIMIT 50 OFFSET 10")
def listed_files(spark, d):
    return catalogue.listed_files(sample.files(spark, d), None, 50, 10).select("path", "state", "error")


@query(f"WITH {o.ASSETS} SELECT asset_id FROM assets a WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.asset_id = a.asset_id AND doc_id % 3 <> 0)")
def orphan_assets(spark, d):
    return catalogue.orphans(sample.assets(spark, d), sample.files(spark, d).where("doc_id % 3 <> 0")).select("asset_id")


@query(f"WITH {o.ASSETS}, {o.PICTURES} SELECT vid, asset_id FROM pictures p WHERE EXISTS (SELECT 1 FROM files f WHERE f.asset_id = p.asset_id AND doc_id % 3 <> 0)")
def collected_garbage(spark, d):
    kept = catalogue.without_orphans(sample.assets(spark, d), sample.files(spark, d).where("doc_id % 3 <> 0"), sample.pictures(spark, d))
    return kept[1].select("vid", "asset_id")


@query(f"WITH {o.ASSETS}, {o.PICTURES} SELECT count(*) AS n, coalesce(max(vid), 0) AS last, 'p2' AS pipeline FROM pictures p JOIN assets a USING (asset_id) WHERE pipeline = 'p2' AND status = 'ready'")
def cache_signature(spark, d):
    return catalogue.signature(catalogue.current_vectors(sample.pictures(spark, d), sample.assets(spark, d), sample.PIPELINE), sample.PIPELINE)


# ------------------------------------------------------------------ ingest
def _changes(spark, d, **options) -> DataFrame:
    return ingest.classified(sample.files(spark, d), sample.listing(spark, d), **options)


@query(f"WITH {o.changes(False, False)} SELECT path, change, state, error, attempts, size, present FROM next")
def change_classification(spark, d):
    return _changes(spark, d).select("path", "change", "state", "error", "attempts", "size", "present")


@query(f"WITH {o.changes(False, False)} SELECT path, state, error, attempts, size, present FROM next")
def snapshot_deltas(spark, d):
    """Files after a listing, stored as the rows that it changed and merged with the version before on reading."""
    store = Snapshots(spark, scratch.new_path(spark, "snapshots"), most_share=1.0)
    store.commit({"files": sample.files(spark, d).select(*ingest.FILE_COLUMNS)})
    was = store.read("files").select(F.col("path").alias("was_path"), F.struct(*ingest.FILE_COLUMNS).alias("was"))
    now = _changes(spark, d).select(*ingest.FILE_COLUMNS)
    changed = now.join(was, F.col("path") == F.col("was_path"), "left").where(~F.struct(*ingest.FILE_COLUMNS).eqNullSafe(F.col("was")))
    store.commit({"files": Delta(changed.select(*ingest.FILE_COLUMNS), "path")})
    return store.read("files").select("path", "state", "error", "attempts", "size", "present")


@query(f"WITH {o.changes(True, False)} SELECT change, state, count(*) AS n FROM next GROUP BY ALL")
def change_retry_failed(spark, d):
    return _changes(spark, d, retry_failed=True).groupBy("change", "state").agg(F.count("*").alias("n"))


@query(f"WITH {o.changes(False, True)} SELECT change, state, count(*) AS n FROM next GROUP BY ALL")
def change_force(spark, d):
    return _changes(spark, d, force=True).groupBy("change", "state").agg(F.count("*").alias("n"))


@query(f"WITH {o.changes(False, False)} SELECT path, CASE WHEN change = 'unseen' THEN false ELSE present END AS present FROM next")
def missing_files(spark, d):
    return ingest.mark_missing(_changes(spark, d)).select("path", "present")


@query(f"""WITH {o.changes(False, False)} SELECT count(*) FILTER (change <> 'unseen') AS scanned, count(*) FILTER (change IN ('new', 'new_unsupported')) AS new, count(*) FILTER (change = 'changed') AS changed,
count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change IN ('new', 'changed', 'redone')) AS queued, count(*) FILTER (change IN ('unsupported', 'new_unsupported')) AS unsupported FROM next""")
def run_counters(spark, d):
    return ingest.run_counters(_changes(spark, d))


@query(f"WITH {o.ASSETS} SELECT path, CASE WHEN f.state = 'processing' THEN 'pending' WHEN f.state = 'done' AND present AND pipeline <> 'p2' THEN 'pending' ELSE f.state END AS state FROM files f JOIN assets a USING (asset_id)")
def stale_requeue(spark, d):
    return ingest.requeue_stale(ingest.recovered(sample.files(spark, d)), sample.assets(spark, d), sample.PIPELINE).select("path", "state")


@query(f"WITH {o.ASSETS}, p AS (SELECT f.* FROM files f WHERE present AND state = 'pending') SELECT path, 'reused' AS what, 1 AS copies FROM p JOIN assets a USING (sha256) WHERE status = 'ready' AND pipeline = 'p2' UNION ALL SELECT min(path), 'work', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.sha256 = p.sha256 AND status = 'ready' AND pipeline = 'p2') GROUP BY sha256")
def hash_dedup(spark, d):
    """Pending files: content that is known, and one file for each content that is not."""
    pending = sample.files(spark, d).where("present AND state = 'pending'")
    reused, work = ingest.split_reuse(pending, sample.assets(spark, d), sample.PIPELINE)
    return reused.select("path", F.lit("reused").alias("what"), F.lit(1).cast("long").alias("copies")).union(work.select("path", F.lit("work"), "copies"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unsupported' ELSE 'failed' END AS state, CASE doc_id % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'corrupt or unreadable: empty file (0 bytes)' WHEN 2 THEN 'corrupt or unreadable: no' WHEN 3 THEN 'AI processing failed: no' ELSE 'unexpected error: no' END AS error FROM documents""")
def error_states(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("unsupported", "empty", "corrupt", "embedder", "other")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return sample.table(spark, d, "documents").select("doc_id", ingest.error_state(kind, F.lit("no")).alias("s")).select("doc_id", "s.state", "s.error")


@query(f"WITH {o.ASSETS} SELECT asset_id, sha256, size + CASE WHEN asset_id % 4 = 0 THEN 7 ELSE 0 END AS size, CAST(CASE WHEN asset_id % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS indexed, CAST(0 AS DOUBLE) AS created_ts FROM assets")
def asset_upsert(spark, d):
    """A quarter of the assets is stored again; ids and creation times stay."""
    old = sample.assets(spark, d).select("asset_id", "sha256", "size", F.lit(0.0).alias("indexed"), F.lit(0.0).alias("created_ts"))
    new = old.where("asset_id % 4 = 0").select((-F.col("asset_id")).alias("asset_id"), "sha256", (F.col("size") + 7).alias("size"), F.lit(1.0).alias("indexed"), F.lit(1.0).alias("created_ts"))
    return ingest.merged_assets(old, new)


@query(f"WITH {o.FILES} SELECT path, CASE WHEN ext IN ('.jpg', '.png') THEN 0 WHEN ext = '.pdf' THEN 1 WHEN ext = '.mp4' THEN 2 ELSE 3 END AS priority FROM files")
def processing_priority(spark, d):
    return sample.files(spark, d).select("path", ingest.priority(F.col("ext")).alias("priority"))


# ------------------------------------------------------------------ folds and texts
@query(o.folded(0.10))
def frame_dedup(spark, d):
    rows = sample.table(spark, d, "embeddings")
    return folds.distinct_frames(rows, "label", "vec_id", "embedding", 0.10).select("label", "vec_id")


@query("SELECT label, vec_id FROM (SELECT *, embedding[1] AS dev, bool_or(embedding[1] > 0.25) OVER (PARTITION BY label) AS has_one FROM embeddings) WHERE dev > 0.25 OR NOT has_one")
def blank_frames(spark, d):
    rows = sample.table(spark, d, "embeddings").withColumn("dev", F.col("embedding")[0].cast("double"))
    return folds.drop_blank_frames(rows, "label", "dev", 0.25).select("label", "vec_id")


@query(o.TRANSCRIPT)
def transcript_fold(spark, d):
    return folds.transcript_buffers(sample.table(spark, d, "conversations"), "conv_id", "turn", "turn", "text")


@query(f"WITH RECURSIVE {o.DOCS}, {o.CHUNKS} SELECT vid, asset_id, md5(text) AS digest, CAST(length(text) AS INT) AS n FROM chunks")
def text_chunks(spark, d):
    return sample.chunks(spark, d).select("vid", "asset_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("SELECT doc_id, CAST(len(w) AS INT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def tokenize(spark, d):
    w = text_.tokens(F.col("text"))
    return sample.table(spark, d, "documents").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query(f"SELECT item_id, CAST(count(*) AS INT) AS n, md5(string_agg(term, ' ' ORDER BY k)) AS digest FROM (SELECT item_id, term, min(k) AS k FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)) WHERE length(term) > 1 AND NOT list_contains(string_split('{o.STOPS}', ' '), term) GROUP BY ALL) GROUP BY item_id")
def query_terms(spark, d):
    w = text_.query_terms(F.col("text"))
    return sample.table(spark, d, "benchmark").select("item_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("digest")).where("n > 0")


@query("WITH t AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' photos' WHEN 1 THEN ' Manual footage' ELSE '' END AS x FROM conversations), w AS (SELECT conv_id, turn, regexp_extract_all(lower(x), '[a-z]+') AS w FROM t) SELECT conv_id, turn, CASE WHEN list_has_any(w, ['image', 'images', 'photo', 'photos', 'picture', 'pictures', 'pic', 'pics']) THEN 'image ' ELSE '' END || CASE WHEN list_has_any(w, ['brochure', 'brochures', 'pdf', 'pdfs', 'document', 'documents', 'flyer', 'flyers', 'catalog', 'catalogue', 'report', 'manual']) THEN 'pdf ' ELSE '' END || CASE WHEN list_has_any(w, ['video', 'videos', 'clip', 'clips', 'footage']) THEN 'video ' ELSE '' END AS intents FROM w")
def intents(spark, d):
    more = F.when(F.col("turn") % 4 == 0, " photos").when(F.col("turn") % 4 == 1, " Manual footage").otherwise("")
    found = text_.intents(F.concat("text", more))
    return sample.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("", F.transform(found, lambda x: F.concat(x, F.lit(" ")))).alias("intents"))


@query(f"WITH d AS (SELECT doc_id, text FROM documents), {o.buckets('d', 'doc_id', 'b')} SELECT doc_id, bucket, round(weight, 9) AS weight FROM b")
def hashed_words(spark, d):
    rows = sample.weighted_buckets(sample.table(spark, d, "documents"), ["doc_id"])
    return rows.select("doc_id", "bucket", F.round("weight", 9).alias("weight"))


@query("WITH a AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), c AS (SELECT item_id, b, len(list_filter(w, lambda x : CAST('0x' || substr(md5(x), 31, 2) AS INT) = b)) AS n FROM a, (SELECT unnest(range(256)) AS b)) SELECT item_id, CAST(b AS INT) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 9) AS weight FROM c QUALIFY sum(n * n) OVER (PARTITION BY item_id) > 0")
def hashed_vector(spark, d):
    """The same as dense vectors of an expression."""
    rows = sample.table(spark, d, "benchmark").select("item_id", F.posexplode(vectors.hashed_words(F.col("text"))).alias("bucket", "weight"))
    return rows.select("item_id", "bucket", F.round("weight", 9).alias("weight"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' WHEN length(text) > 0 THEN text END AS snippet FROM documents")
def snippets(spark, d):
    return sample.table(spark, d, "documents").select("doc_id", text_.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:55], ' ') AS words FROM documents")
def truncate_words(spark, d):
    return sample.table(spark, d, "documents").select("doc_id", text_.first_words(F.col("text")).alias("words"))


@query("SELECT doc_id, regexp_replace(text, '(the|and|ion)', '<mark>\\1</mark>', 'gi') AS marked FROM documents")
def highlight(spark, d):
    return sample.table(spark, d, "documents").select("doc_id", text_.highlighted(F.col("text"), F.lit("the, and of ion!")).alias("marked"))


@query(
    r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'),
  '^\s+|\s+$', '', 'g')) AS digest FROM pages"""
)
def html_text(spark, d):
    return sample.table(spark, d, "pages").select("page_id", F.md5(text_.without_tags(F.col("html"))).alias("digest"))


@query("SELECT doc_id, CASE WHEN s >= 1000000 THEN printf('%.1f MB', s / 1e6) WHEN s >= 1000 THEN printf('%.0f KB', round_even(s / 1e3, 0)) ELSE s || ' B' END AS size, printf('%d:%02d', CAST(n_chars // 60 AS INT), CAST(n_chars % 60 AS INT)) AS time FROM (SELECT *, n_chars * 101 + 7 AS s FROM documents)")
def display_forms(spark, d):
    rows = sample.table(spark, d, "documents")
    return rows.select("doc_id", text_.display_size(F.col("n_chars") * 101 + 7).alias("size"), text_.minutes(F.col("n_chars").cast("double")).alias("time"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'frame at ' || printf('%d:%02d', CAST(n_chars // 60 AS INT), CAST(n_chars % 60 AS INT)) WHEN 1 THEN 'speech at ' || printf('%d:%02d', CAST(n_chars // 60 AS INT), CAST(n_chars % 60 AS INT)) WHEN 2 THEN 'page ' || n_chars WHEN 3 THEN 'page ' || n_chars ELSE 'image' END AS label FROM documents")
def match_labels(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("frame", "transcript", "page", "chunk", "image")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return sample.table(spark, d, "documents").select("doc_id", text_.match_label(kind, F.col("n_chars").cast("double")).alias("label"))


@query("SELECT doc_id, i AS at, round((i + 0.5) * dur / n, 6) AS t FROM (SELECT doc_id, n_chars / 10.0 AS dur, greatest(1, least(24, CAST(floor(n_chars / 10.0 / 8.0) AS INT))) AS n FROM documents), LATERAL (SELECT CAST(unnest(range(n)) AS INT) AS i)")
def sample_times(spark, d):
    rows = sample.table(spark, d, "documents").select("doc_id", F.posexplode(media.sample_times(F.col("n_chars") / 10.0, 24, 8.0)).alias("at", "t"))
    return rows.select("doc_id", "at", F.round("t", 6).alias("t"))


@query("SELECT doc_id, CAST(p AS INT) AS frame FROM (SELECT doc_id, unnest(list_filter(range(n_chars), lambda i : i % 200 = 0)[1:24]) AS p FROM documents)")
def sequential_frames(spark, d):
    return sample.table(spark, d, "documents").select("doc_id", F.explode(media.sequential_picks(F.col("n_chars").cast("int"), F.lit(25.0), 8.0, 24)).alias("frame"))


@query("SELECT DISTINCT doc_id, CAST(round_even(i * (n - 1) / greatest(k - 1, 1), 0) AS INT) AS page FROM (SELECT doc_id, n_chars % 40 AS n, least(n_chars % 40, 8) AS k FROM documents), LATERAL (SELECT unnest(range(k)) AS i)")
def page_picks(spark, d):
    return sample.table(spark, d, "documents").select("doc_id", F.explode(media.page_picks((F.col("n_chars") % 40).cast("int"), 8)).alias("page"))


@query(f"WITH {o.FILES} SELECT path, ext AS ending, {o.MEDIA} AS kind, CASE ext WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.mp4' THEN 'video/mp4' WHEN '.pdf' THEN 'application/pdf' END AS mime, folder, name, substr(folder, 2) AS top FROM files")
def path_parts(spark, d):
    f = sample.files(spark, d).select("path")
    own = media.ending(F.col("path"))
    return f.select("path", own.alias("ending"), media.media_type(own).alias("kind"), media.mime_type(own).alias("mime"), media.folder(F.col("path")).alias("folder"), media.base_name(F.col("path")).alias("name"), media.top_folders(F.substring(media.folder(F.col("path")), 2, 1000)).alias("top"))


@query("WITH t AS (SELECT item_id, ['red green', 'Blue sky, blue sea', 'white', 'nothing', 'YELLOW and magenta'][CAST(item_id % 5 + 1 AS INT)] AS x FROM benchmark), v AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN [1.0, 1, 0] WHEN 1 THEN [0.0, 0, 2] WHEN 2 THEN [1.0, 1, 1] WHEN 3 THEN [0.0, 0, 0] ELSE [2.0, 1, 1] END AS v FROM t) SELECT item_id, round(v[1] / n, 6) AS r, round(v[2] / n, 6) AS g, round(v[3] / n, 6) AS b FROM (SELECT item_id, v, CASE WHEN list_dot_product(v, v) > 0 THEN sqrt(list_dot_product(v, v)) ELSE 1 END AS n FROM v)")
def colour_vectors(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("red green", "Blue sky, blue sea", "white", "nothing", "YELLOW and magenta")]), (F.col("item_id") % 5 + 1).cast("int"))
    rows = sample.table(spark, d, "benchmark").select("item_id", vectors.colour_words(said).alias("v"))
    return rows.select("item_id", *[F.round(F.col("v")[k], 6).alias(c) for k, c in enumerate("rgb")])


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return sample.table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'jpg|png' WHEN 1 THEN NULL ELSE 'pdf' END AS items, chr(CAST(65 + event_id % 26 AS INT)) || 'vc1' AS code FROM events")
def parsed_lists(spark, d):
    """Comma-separated lists and codec numbers."""
    text = F.when(F.col("event_id") % 3 == 0, " JPG ,,png").when(F.col("event_id") % 3 == 1, " , ").otherwise("Pdf")
    code = F.lit((ord("v") << 8) | (ord("c") << 16) | (ord("1") << 24)) + 65 + F.col("event_id") % 26
    return sample.table(spark, d, "events").select("event_id", F.array_join(text_.listed(text), "|").alias("items"), text_.fourcc(code.cast("int")).alias("code"))


# ------------------------------------------------------------------ evaluation
def _eval(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results by path, relevant paths, queries): each good document is relevant to one of the queries, by its number, so that all queries have some."""
    good = sample.table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    files = sample.files(spark, d).where("present")
    relevant = files.join(good, "doc_id").select("path", "doc_id")
    asked = sample.queries(spark, d).select("qid", (F.col("qid") % 8 == 7).alias("negative"))
    number = asked.agg(F.count("*").alias("n"))  # one row
    relevant = relevant.crossJoin(F.broadcast(number)).withColumn("qid", F.pmod("doc_id", "n")).join(asked.select("qid"), "qid").select("qid", "path")
    results = search.hybrid(spark, d).select("qid", "place", "asset_id").join(files.select("asset_id", "path"), "asset_id")
    return results, relevant, asked


_EVAL = f"""WITH RECURSIVE {o.FUSED}, good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), rel AS (SELECT doc_id % (SELECT count(*) FROM asked) AS qid, path FROM files SEMI JOIN good USING (doc_id) WHERE present AND doc_id % (SELECT count(*) FROM asked) IN (SELECT qid FROM asked)),
h AS (SELECT t.qid, t.place, max(CASE WHEN r.path IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM placed t JOIN files f ON f.asset_id = t.asset_id AND f.present LEFT JOIN rel r ON r.qid = t.qid AND r.path = f.path WHERE t.place < 10 GROUP BY ALL),
m AS (SELECT a.qid, a.qid % 8 = 7 AS negative, coalesce(sum(CASE WHEN h.place < 5 THEN hit END), 0) / 5 AS p_at_5, coalesce(sum(hit), 0) / 10 AS p_at_k, coalesce(sum(hit), 0) / (SELECT nullif(count(*), 0) FROM rel r WHERE r.qid = a.qid) AS recall, min(CASE WHEN hit = 1 THEN h.place + 1 END) AS first_rank FROM asked a LEFT JOIN h ON h.qid = a.qid GROUP BY a.qid)"""


@query(f"{_EVAL} SELECT qid, negative, p_at_5, p_at_k, round(recall, 9) AS recall, CAST(first_rank AS INT) AS first_rank, round(coalesce(1 / first_rank, 0), 9) AS mrr FROM m")
def eval_metrics(spark, d):
    rows = evaluation.metrics(*_eval(spark, d))
    return rows.select("qid", "negative", "p_at_5", "p_at_k", F.round("recall", 9).alias("recall"), "first_rank", F.round("mrr", 9).alias("mrr"))


@query(f"{_EVAL} SELECT round(avg(p_at_5), 9) AS p_at_5, round(avg(p_at_k), 9) AS p_at_k, round(avg(recall), 9) AS recall, round(avg(coalesce(1 / first_rank, 0)), 9) AS mrr FROM m WHERE NOT negative")
def eval_means(spark, d):
    means = evaluation.mean_metrics(evaluation.metrics(*_eval(spark, d)))
    return means.select(*[F.round(c, 9).alias(c) for c in means.columns])


@query(f"WITH {o.FILES}, q(qid, type, rx) AS (VALUES (1, 'image', 'th(e|an) .*ion'), (2, 'pdf', 'eau|oi'), (2, 'video', 'eau|oi')) SELECT DISTINCT qid, path FROM (SELECT f.path, {o.MEDIA} AS kind, d.text FROM files f JOIN documents d USING (doc_id) WHERE f.present), q WHERE kind = q.type AND regexp_matches(text, rx, 'i')")
def weak_labels(spark, d):
    asked = spark.createDataFrame([(1, ["image"], "th(e|an) .*ion"), (2, ["pdf", "video"], "eau|oi")], "qid int, expect_types array<string>, pattern string")
    texts = sample.table(spark, d, "documents").select("doc_id", "text")
    own = sample.files(spark, d).where("present").select("doc_id", "path", media.media_type(F.col("ext")).alias("type")).join(texts, "doc_id")
    return evaluation.weak_labels(asked, own)


@query(f"WITH {o.DOCS}, {o.PICTURES}, {o.ASKED}, {o.SIMS}, t AS (SELECT qid, qid % 4 = 3 AS negative, max(raw) * CASE WHEN qid % 4 = 3 THEN 0.5 ELSE 1 + qid % 2 * -0.7 END AS top FROM sims GROUP BY qid), n AS (SELECT max(top) FILTER (negative) AS hi, count(*) FILTER (NOT negative) AS n_positive FROM t) SELECT 'clip' AS signal, round(hi + 0.01, 6) AS floor, round(hi, 6) AS highest_negative, n_positive, (SELECT count(*) FROM t WHERE NOT negative AND top < hi + 0.01) AS n_weak FROM n")
def calibration_floor(spark, d):
    tops = retrieval.raw_tops({"clip": retrieval.nearest(sample.pictures(spark, d), sample.queries(spark, d), most=1, per_asset=False, digits=None)})
    factor = F.when(F.col("qid") % 4 == 3, 0.5).otherwise(1 + F.col("qid") % 2 * -0.7)
    rows = evaluation.calibration(tops.select("qid", "signal", (F.col("top") * factor).alias("top"), (F.col("qid") % 4 == 3).alias("negative")))
    return rows.select("signal", F.round("floor", 6).alias("floor"), F.round("highest_negative", 6).alias("highest_negative"), "n_positive", F.size("weak").cast("long").alias("n_weak"))


@query(f"WITH {o.FILES}, l AS (SELECT coalesce({o.MEDIA}, 'unsupported/other') AS kind, substr(folder, 2) AS top, size FROM files) SELECT 'type' AS section, kind AS name, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM l GROUP BY kind UNION ALL SELECT 'folder', top, count(*), CAST(sum(size) AS BIGINT) FROM l GROUP BY top UNION ALL SELECT 'total', 'total', count(*), CAST(sum(size) AS BIGINT) FROM l")
def dataset_summary(spark, d):
    rows = sample.files(spark, d).withColumn("folder", F.substring("folder", 2, 1000))
    return evaluation.dataset_summary(rows.select("folder", "name", "ext", "size"))


@query("SELECT item_id, CAST(row_number() OVER (ORDER BY item_id % 5, item_id) AS INT) AS case_no, item_id % 10 = 3 AS placeholder FROM benchmark")
def report_cases(spark, d):
    cases = sample.table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 5).alias("section_no"), F.col("item_id").alias("position"), F.when(F.col("item_id") % 10 == 3, "<<< later >>>").otherwise(F.col("text")).alias("query"))
    return evaluation.numbered_cases(cases).select("item_id", "case_no", "placeholder")
