"""A text of more than 1,000 chunks, whose later chunks have the numbers of the next asset's."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from prismdex.operators import catalogue, retrieval
from prismdex.plans import sample


def test_chunks_that_share_a_vid(spark, tmp_path):
    long_ = " ".join(f"w{i:07d}" for i in range(86_000))
    rows = [(1, long_, "en", "a", len(long_)), (2, "zebra crossing of the second text", "en", "a", 33)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = sample.chunks(spark, str(tmp_path)).collect()
    chunks = {(r.asset_id, r.vid): r.text.split() for r in found}
    assert len(chunks) == len(found) > 1001 and (1, 2000) in chunks and (2, 2000) in chunks
    term = chunks[1, 2000][60]
    asked = spark.createDataFrame([(0, "zebra"), (1, term)], "qid int, term string")
    posted, lengths = sample.postings(sample.chunks(spark, str(tmp_path)))
    scored = retrieval.bm25(posted, lengths, asked)
    mean = sum(map(len, chunks.values())) / len(chunks)
    want = {}
    for qid, word in ((0, "zebra"), (1, term)):
        hits = {k: w.count(word) for k, w in chunks.items() if word in w}
        idf = math.log((len(chunks) - len(hits) + 0.5) / (len(hits) + 0.5))
        want |= {(qid, *k): idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(chunks[k]) / mean)) for k, tf in hits.items()}
    got = {(r.qid, r.asset_id, r.vid): r.raw for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_snippets_of_chunks_that_share_a_vid(spark):
    kw = F.struct(F.lit(2000).alias("vid"), F.lit(1.0).alias("raw"))
    none = F.lit(None).cast("struct<vid:int,raw:double>")
    hits = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "qid int, place int, asset_id long").select("*", F.lit("pdf").alias("type"), F.lit("kw").alias("best_signal"), F.lit(1.0).alias("relative"), F.lit(1.0).alias("confidence"), none.alias("clip"), none.alias("text"), kw.alias("kw"))
    assets = spark.createDataFrame([(1,), (2,)], "asset_id long").select("*", *[F.lit(None).cast("string").alias(c) for c in "type ext size width height duration pages mime thumb warnings meta indexed_ts".split()])
    files = spark.createDataFrame([(1, "/1", "1", "/", True), (2, "/2", "2", "/", True)], "asset_id long, path string, name string, folder string, present boolean")
    vectors = spark.createDataFrame([(1, 2000, "first"), (2, 2000, "second")], "asset_id long, vid int, text string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("kind", "ref", "thumb")])
    rows = catalogue.hydrated(hits, assets, files, vectors).collect()
    assert [(r.asset_id, r.text_match.snippet, r.match.snippet) for r in rows] == [(1, "first", "first"), (2, "second", "second")]
