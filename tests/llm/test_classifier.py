"""The quality classifier: features against a plain version, accuracy on labels that it has not seen, odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prismdex.llm import classifier as c
from prismdex.llm import textblocks as tb

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def test_features_against_a_plain_version():
    texts = ["", "one", "one  two\nüne tür\t", None, "a", " ", "aa aa bb aa aa", "日本語 テキスト ab cd", "x" * 700 + " y"]
    raw, off = next(tb.blocks(pa.array(texts)))
    found = [Counter() for _ in texts]
    for text, bucket in c.features(raw, off):
        for t in text.tolist():
            found[t]["n"] += 1
        for t, b in zip(text.tolist(), bucket.tolist(), strict=True):
            found[t][b] += 1
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [g for w in words for w in [f" {w} "] for n in c.GRAMS for i in range(len(w) - n + 1) for g in [w[i : i + n]]]
        like = sum(words[i] == words[i - b] for b in (1, 2, 3) for i in range(b, len(words)))
        assert found[k]["n"] == len(words) + max(len(words) - 1, 0) + like + len(grams)
        own = Counter(c.counts(*next(tb.blocks(pa.array([t]))))[0][0].tolist())
        assert set(own) == {b for b in found[k] if b != "n"}
    again = [dict(zip(*map(np.ndarray.tolist, p), strict=True)) for p in c.counts(raw, off)]
    assert again == [{b: n for b, n in f.items() if b != "n"} for f in found]


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    ones = label.sum()
    return (order[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_held_out_accuracy(spark):
    rows = c.op13_classifier(spark, DATA)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    found = {r.doc_id: r for r in rows.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    own = [(r.score, labels[i]) for i, r in found.items() if r.held_out and i in labels]
    score, label = np.array([x for x, _ in own]), np.array([x for _, x in own])
    assert len(own) > 60 and auc(score, label) > 0.95 and ((score >= 0.7) == label).mean() > 0.93
    again = {r.doc_id: r.score for r in c.op13_classifier(spark, DATA).collect()}
    assert again == {i: r.score for i, r in found.items()}


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    how = c.Training(epochs=2)
    model = c.fit(docs, labels.where(~c.held_out(F.col("doc_id"))), how=how)
    turned = labels.withColumn("quality", F.when(c.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = c.fit(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "score": F.lit(1)}).repartition(7), turned.where(~c.held_out(F.col("doc_id"))), how=how)
    assert np.array_equal(model.vectors, other.vectors) and np.array_equal(model.output, other.output)


def test_shards_and_sample(spark):
    rng = random.Random(1)
    word = lambda kind: rng.choice(("good", "fine", "well", "calm") if kind else ("b&d", "w#rse", "b&dly", "cr%p"))
    rows = [(i, " ".join(word(i % 2) if rng.random() < 0.3 else f"w{rng.randint(0, 300)}" for _ in range(60))) for i in range(240)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    for most, shard in ((8000, 1000), (120, 40)):
        model = c.fit(docs, labels, most=most, shard=shard)
        found = c.classify(docs.where("doc_id >= 160"), model).collect()
        assert all((r.score > 0.5) == r.doc_id % 2 for r in found)


def test_odd_rows(spark):
    rows = [(None, None), (None, "good text here"), (1, "good text here"), (1, "good text here"), (1, "another text"), (2, ""), (3, None), (4, "w " * 300_000), (5, "bad bad bad")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "label": F.lit(1), "known": F.lit(2), "quality": F.lit(0), "a.b": F.lit(3)})
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 0), (5, 0), (9, 1)], "doc_id long, quality int")
    model = c.fit(docs, labels, how=c.Training(epochs=2))
    done = c.classify(docs, model)
    found = done.collect()
    assert done.columns == docs.columns and len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    none = {r.score for r in found if not r.text}
    assert len(none) == 1 and len({r.score for r in found if r.text == "good text here"}) == 1
    empty = c.fit(docs, labels.limit(0))
    assert {r.score for r in c.classify(docs, empty).collect()} == {0.5}
    assert c.classify(docs.limit(0), model).collect() == [] and c.classify(docs, c.fit(docs.limit(0), labels)).count() == len(rows)
