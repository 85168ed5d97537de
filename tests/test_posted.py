"""Candidates from a table of postings, against the scores of every text."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from prismdex.operators import retrieval
from prismdex.plans import sample


def test_candidates_of_postings_are_those_of_all_scores(spark):
    rng = random.Random(8)
    texts = [(k, k // 3, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(30)))) for k in range(300)]
    posted, lengths = sample.postings(spark.createDataFrame(texts, "vid long, asset_id long, text string").repartition(3))
    assert "Exchange" not in posted.where("tf > 0")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "").replace("Exchange SinglePartition", "")
    assert {(r.vid, r.term, r.tf) for r in posted.collect()} == {(v, t, x.split().count(t)) for v, _, x in texts for t in x.split()}
    asked = spark.createDataFrame([(1, "aa"), (1, "bb"), (1, "bb"), (2, "cc"), (3, "none")], "qid int, term string")
    allowed = spark.range(0, 100, 2).select(F.col("id").alias("asset_id"))
    want = retrieval.keyword_hits(retrieval.bm25(posted, lengths, asked), allowed)
    got = retrieval.keyword_cut(retrieval.bm25_posted(posted, lengths, asked, allowed))
    rows = lambda df: sorted((r.qid, r["rank"], r.vid, r.asset_id, round(r.raw, 6)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) > 20
    assert retrieval.bm25_posted(posted.limit(0), lengths.limit(0), asked).count() == 0
