"""Words as one string: the same as lists of them, made once for both text signals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prismdex.functions import text as text_
from prismdex.functions.chunks import word_lists
from prismdex.functions.vectors import word_buckets
from prismdex.operators import retrieval
from prismdex.plans import sample, search

DATA = "/root/testdata/sf0.001"
ODD = ["", " ", "...", "One two  two", "-a-b.c- ", "ÉK1\tÜx Y_z9", "İstanbul", "é ü", None, "x"]


def test_spaced_tokens_are_the_tokens(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(ODD)], "k int, text string").select("k", text_.tokens(F.col("text")).alias("w"), text_.spaced_tokens(F.col("text")).alias("s"))
    rows = rows.withColumn("l", text_.split_tokens(F.col("s"))).orderBy("k").collect()
    assert [r.l for r in rows] == [r.w for r in rows] and rows[3].w == ["one", "two", "two"]
    column = pa.array([r.s for r in rows], pa.string())
    assert word_lists(column).to_pylist() == [r.w for r in rows] and word_lists(column.slice(3, 6)).to_pylist() == [r.w for r in rows][3:9]
    lists = pa.array([r.w for r in rows], pa.list_(pa.string()))
    assert word_lists(lists) is lists and word_lists(column.slice(0, 0)).to_pylist() == []


def test_hashed_words_are_hashed_buckets(spark):
    rows = spark.createDataFrame([(x,) for x in [*ODD, "red red car 7"]], "text string").select(word_buckets(F.col("text")).alias("b"), text_.spaced_tokens(F.col("text")).alias("s")).collect()
    assert np.array_equal(retrieval.hashed(pa.array([r.b for r in rows], pa.list_(pa.int32()))), retrieval.hashed_words(pa.array([r.s for r in rows], pa.string())))


def test_counts_of_lists_and_strings(spark):
    texts = spark.createDataFrame([(1, 1, ["a", "b", "a"]), (2, 1, []), (3, 2, None), (4, 2, ["c", "a"]), (5, 3, ["d"] * 4)], "vid long, asset_id long, words array<string>")
    terms = spark.createDataFrame([(1, "a"), (1, "c"), (2, "d"), (2, "zz")], "qid int, term string")
    posted = texts.where("words IS NOT NULL").select("vid", "asset_id", F.explode("words").alias("term")).groupBy("vid", "asset_id", "term").agg(F.count("*").alias("tf"))
    lengths = texts.where("words IS NOT NULL").select("vid", "asset_id", F.size("words").alias("len"))
    rows = lambda df: sorted((r.qid, r.asset_id, r.vid, round(r.raw, 8)) for r in df.collect())
    want = rows(retrieval.bm25(posted, lengths, terms).where("raw > 0"))
    strings = texts.withColumn("words", F.array_join("words", " "))
    marked = strings.withColumn("marked", F.col("asset_id") < 3)
    assert rows(retrieval.bm25_best(texts, terms, per_asset=False)) == rows(retrieval.bm25_best(strings, terms, per_asset=False)) == want and len(want) == 3
    assert rows(retrieval.bm25_best(marked, terms, F.col("marked"), per_asset=False)) == [r for r in want if r[1] < 3]
    assert retrieval.bm25_best(strings.where("vid = 3"), terms).count() == retrieval.bm25_best(strings.limit(0), terms).count() == 0


def test_texts_are_cut_once_for_both_signals(spark):
    found = search.signals(spark, DATA)
    for name in ("text", "kw"):
        plan = found[name]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "/documents.parquet" not in plan, name  # scores only, over the table of words


def test_chunks_of_some_assets(spark):
    every = sample.chunks(spark, DATA)
    some = every.select("asset_id").distinct().where("asset_id % 3 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sample.chunks(spark, DATA, only=some.union(some))) == rows(every.where("asset_id % 3 = 0"))
    assert rows(sample.chunks(spark, DATA, some.union(some)).select("vid", "asset_id", "text", "marked")) == rows(every.withColumn("marked", F.col("asset_id") % 3 == 0))
