"""The text index: the same scores as a full scan, blocks left out, counts after additions, changes and withdrawals."""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismdex.operators import retrieval, text_index

TEXT = "vid string, asset_id long, words array<string>"


def corpus(n=700, seed=5):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.03)), 250)}"
    return [(f"t{k}", k // 3, [word() for _ in range(rng.randint(1, 60))]) for k in range(n)]


def asked(spark):
    rng = random.Random(8)
    return spark.createDataFrame([(q, f"w{rng.randint(0, 120)}") for q in range(14) for _ in range(rng.randint(1, 6))] + [(99, "unknown"), (3, "w1"), (3, "w1")], "qid int, term string")


def hits(found, most):
    return sorted((r.qid, r.rank, r.asset_id, r.vid, round(r.raw, 8)) for r in retrieval.cut_and_rank(retrieval.best_per_asset(found, 9), share=0.3, most=most).collect())


@pytest.mark.parametrize("filtered", [False, True])
@pytest.mark.parametrize("size", [1 << 14, 50])
def test_equal_to_a_full_scan(spark, monkeypatch, filtered, size):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 6)
    texts = spark.createDataFrame([*corpus(), ("none", 900, None), ("empty", 901, []), ("long", 902, ["w7", "w8"] * 40_000)], TEXT).repartition(3)
    allowed = spark.createDataFrame([(k,) for k in range(0, 950, 4)], "asset_id long") if filtered else None
    index = text_index.built(texts, most_texts=size).persist()
    assert index.where("term IS NULL").agg(F.sum("n")).first()[0] == 702
    for most in (200, 15):
        got = hits(text_index.search(index, asked(spark), allowed, most=most), most)
        assert got == hits(retrieval.bm25_best(texts, asked(spark), allowed, most=most), most) and len(got) > 100


def test_counts_follow_deltas(spark):
    rows = corpus()
    first, added = rows[:500], rows[500:]
    gone = [r for r in rows[:600] if r[1] % 5 == 0]
    changed = [(v, a, [*w, "w3", "new"]) for v, a, w in gone if a % 2]
    index = text_index.built(spark.createDataFrame(first, TEXT), 1).union(text_index.built(spark.createDataFrame(added, TEXT), 2)).persist()
    places, counts = text_index.withdrawn(index, spark.createDataFrame(gone, TEXT))
    index = index.union(text_index.built(spark.createDataFrame(changed, TEXT), 3))
    rebuilt = spark.createDataFrame([r for r in rows if r not in gone] + changed, TEXT)
    terms = asked(spark).union(spark.createDataFrame([(50, "new"), (50, "w5")], "qid int, term string"))
    assert hits(text_index.search(index, terms, places=places, counts=counts), 200) == hits(retrieval.bm25_best(rebuilt, terms), 200)
    none = text_index.search(text_index.built(spark.createDataFrame([], TEXT)), terms)
    assert none.collect() == [] and none.columns == ["qid", "asset_id", "vid", "raw"]


def test_blocks_that_cannot_matter_are_left_out():
    rng = np.random.default_rng(2)
    n, mean = 4096, 50.0
    lengths = rng.integers(20, 90, n).astype(np.int32)

    def postings(places, counts):
        blocks = [(places[i : i + 128], counts[i : i + 128]) for i in range(0, len(places), 128)]
        return text_index.Postings([(c.max(), lengths[p].min(), p.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()) for p, c in blocks])

    rare, common = np.sort(rng.choice(n, 60, False)), np.arange(n)
    terms = [(9.0, postings(rare, rng.integers(1, 5, 60))), (0.1, postings(common, rng.integers(1, 9, n)))]
    scores, read = text_index.best_texts(terms, lengths, np.arange(n), None, mean, 20)
    full, every = text_index.best_texts(terms, lengths, np.arange(n), None, mean, n)
    top = np.argsort(-full, kind="stable")[:20]
    assert np.allclose(scores[top], full[top]) and np.array_equal(np.argsort(-scores, kind="stable")[:20], top)
    assert every == 33 and read <= 33 and scores[np.setdiff1d(common, rare)].max() == 0


def test_blocks_of_one_list_are_left_out():
    lengths = np.full(2000, 40, np.int32)
    counts = np.ones(2000, np.int32)
    counts[:128] = 30
    rows = [(counts[i : i + 128].max(), 40, np.arange(i, min(i + 128, 2000), dtype=np.int32).tobytes(), counts[i : i + 128].tobytes()) for i in range(0, 2000, 128)]
    other = text_index.Postings([(30, 40, np.arange(128, dtype=np.int32).tobytes(), np.full(128, 30, np.int32).tobytes())])
    _, read = text_index.best_texts([(2.0, other), (1.0, text_index.Postings(rows))], lengths, np.arange(2000), None, 40.0, 50)
    assert read == 2


def test_an_index_is_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame(corpus(), TEXT).mapInArrow(counted, TEXT)
    text_index.built(texts, most_texts=100).write.format("noop").mode("overwrite").save()
    assert seen.value == 700


def test_rows_of_a_segment_are_columns():
    rng = random.Random(3)
    texts = [[f"w{int(rng.expovariate(0.002))}" for _ in range(rng.randrange(80))] for _ in range(900)] + [["often"]] * 300
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = "segment bigint, term string, n int, words bigint, top int, least int, places binary, counts binary, lengths binary, vids array<bigint>, asset_ids array<bigint>"
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])
    ids, words = pa.array(range(1200)), pa.array(texts)
    objects = sys.getallocatedblocks()
    table = text_index._inverted(ids, ids, words, 7, schema)
    assert sys.getallocatedblocks() - objects < table.num_rows  # no Python object for each row
    head, *rows = table.to_pylist()
    assert head["n"] == 1200 and head["words"] == sum(map(len, texts)) and head["vids"] == head["asset_ids"] == list(range(1200)) and np.array_equal(np.frombuffer(head["lengths"], np.int32), [len(x) for x in texts])
    found: dict = {}
    for r in rows:
        places, counts = np.frombuffer(r["places"], np.int32), np.frombuffer(r["counts"], np.int32)
        assert r["segment"] == 7 and len(places) == len(counts) == r["n"] <= text_index.BLOCK and r["top"] == counts.max() and r["least"] == min(len(texts[k]) for k in places)
        found.setdefault(r["term"], []).extend(zip(places.tolist(), counts.tolist(), strict=True))
    want: dict = {}
    for k, x in enumerate(texts):
        for w in sorted(set(x)):
            want.setdefault(w, []).append((k, x.count(w)))
    assert found == want and sum(r["term"] == "often" for r in rows) == 3
    none = text_index._inverted(pa.array([1]), pa.array([1]), pa.array([[]], pa.list_(pa.string())), 0, schema)
    assert none.num_rows == 1 and none["words"].to_pylist() == [0]
