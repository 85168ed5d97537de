"""Hybrid search of many queries over the sample tables as one plan, and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismdex.functions import text as text_
from prismdex.operators import retrieval
from prismdex.plans import sample
from prismdex.sources import scratch

FLOORS = {"clip": 0.2, "text": 0.15}
MARGINS = {"clip": 0.75, "text": 0.6}
BOUNDS = {"clip": (0.18, 0.32), "text": (0.25, 0.60)}


def allowed(spark: SparkSession, sf_dir: str, filters: retrieval.Filters = retrieval.Filters()) -> DataFrame:
    return retrieval.allowed_assets(sample.assets(spark, sf_dir), sample.files(spark, sf_dir), sample.PIPELINE, filters)


def signals(spark: SparkSession, sf_dir: str, filters: retrieval.Filters = retrieval.Filters()) -> dict[str, DataFrame]:
    """Hits of the three signals for every query.

    Texts are cut into chunks and words once: the table of words is written, counted and then scored for both text signals.
    """
    asked, ok = sample.queries(spark, sf_dir), allowed(spark, sf_dir, filters)
    chunks = scratch.written_by_bytes(sample.worded(sample.chunks(spark, sf_dir, ok)), "words")
    clip = retrieval.nearest(sample.pictures(spark, sf_dir), asked, ok)
    texts = chunks.select("vid", "asset_id", "marked", F.col("words").alias("vector"))
    text = retrieval.nearest(texts, asked.select("qid", text_.spaced_tokens(F.col("text")).alias("vector")), F.col("marked"), matrix=retrieval.hashed_words)
    words = retrieval.bm25_best(chunks, sample.terms(asked), F.col("marked"))
    return {
        "clip": retrieval.cut_and_rank(retrieval.best_per_asset(clip, 9), FLOORS["clip"], MARGINS["clip"]),
        "text": retrieval.cut_and_rank(retrieval.best_per_asset(text, 9), FLOORS["text"], MARGINS["text"]),
        "kw": retrieval.keyword_cut(words),
    }


def hybrid(spark: SparkSession, sf_dir: str, filters: retrieval.Filters = retrieval.Filters()) -> DataFrame:
    """Every result of every query, ranked, before paging."""
    asked = sample.queries(spark, sf_dir).select("qid", text_.intents(F.col("text")).alias("intents"))
    fused = retrieval.fuse(signals(spark, sf_dir, filters), BOUNDS)
    return retrieval.ranked(retrieval.boost_intent(fused, sample.assets(spark, sf_dir), None if filters.types else asked))
