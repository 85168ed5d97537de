"""The near-duplicate stage against brute force on planted near copies."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from prismdex.llm import near_copies
from prismdex.llm.simhash import fingerprint

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def roots_by_hand(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def planted(seed=7):
    """Texts of 60 to 400 words with near copies of several similarities, chains of copies of copies, and texts that share half."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(25):
        words = [word() for _ in range(rng.randint(60, 400))]
        out.append(words)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            out.append([word() if rng.random() < share else w for w in words])
        out.append(out[-1][: len(words) * 9 // 10])
        out.append(words[: len(words) // 2] + [word() for _ in range(len(words) // 2)])
    out += [[], ["one"], ["One"], ["a", "b", "c", "d"], ["a", "b", "c", "e"]]
    rng.shuffle(out)
    return {i: (" \n" if i % 2 else " ").join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize("group", [1000, 4])
def test_stage_removes_planted_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(near_copies, "GROUP", group)
    texts = planted()
    docs = spark.createDataFrame([*texts.items()], SCHEMA).repartition(3).withColumns({"id": F.lit(1), "root": F.lit("x"), "least": F.lit(2)})
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    roots = roots_by_hand(texts)
    want = sorted(i for i, r in roots.items() if i == r)
    assert kept.columns == docs.columns and 30 < len(want) < 110
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_stage_tells_rows_apart_by_doc_id_and_text(spark):
    rng = random.Random(3)
    one, two, three, four = ([f"{k}{rng.randrange(900)}" for _ in range(80)] for k in "abcd")
    near = lambda words: " ".join([*words[:-1], "end"])
    full = " ".join
    rows = [(1, full(one)), (5, full(two)), (5, near(one)), (5, full(two)), (None, full(three)), (None, near(three)), (None, full(four)), (7, near(four)), (None, near(two)), (8, full(one))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "").collect()
    own = sorted((str(r.doc_id), r.text) for r in kept if r.doc_id is not None)
    assert own == sorted([("1", full(one)), ("5", full(two)), ("7", near(four))])
    assert [r.text in (full(three), near(three)) for r in kept if r.doc_id is None] == [True]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Every name that a plan of the stages uses or used, and names with dots, blanks and quotes."""
    names = """__quality quality row q __key __size __copy __copies __at __source __bucket __target __doc __id __kept a.b id key size copies at of source_size target epochs shares buckets bucket cut rest before
    digest place least root node known weight draw copy words d l keys band group part a b `tick` 'quote' row.text""".split()
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(90)) + ".", "en", f"s{k % 3}", k, *[f"{n}-{k}" for n in names]) for k in range(40)]
    schema = StructType([StructField("doc_id", LongType()), *[StructField(c, StringType()) for c in ("text", "lang", "source")], StructField("n_chars", LongType()), *[StructField(n, StringType()) for n in names]])
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(k, k % 2) for k in range(0, 40, 3)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = {r[0]: r for r in rows}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for entered in (docs, kept):
            done = stage(spark, entered, str(tmp_path))
            assert done.schema.names == docs.schema.names, name
            found = done.collect()
            assert len(found) > 25 and all(tuple(r) == given[r[0]] for r in found), name
        kept = done
    assert 5 not in {r[0] for r in kept.select("doc_id").collect()}
    assert corpus_pipeline.tokens(spark, kept, str(tmp_path)).count() == kept.count()


def test_chance_meetings_do_not_chain(spark):
    """A chain in which neighbours share a bucket but are not near copies: every text stays, and no group of the whole chain is compared."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10_000)}" for _ in range(60 * 20 + 200)]
    docs = spark.createDataFrame([(k, " ".join(words[20 * k : 20 * k + 200])) for k in range(60)], SCHEMA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(i for i, r in roots_by_hand(texts).items() if i == r)


def test_walk_leaves_out_pairs_of_one_group():
    flat, first = np.array([1, 2, 3, 4, 9, 1, 2, 3, 4, 50, 51, 1, 2, 3, 4], np.uint64), np.array([0, 5, 9, 11, 15])
    links = near_copies.spanning_links(flat, first)
    assert {tuple(sorted(x)) for x in links} in ({(0, 1), (0, 3)}, {(0, 1), (1, 3)}, {(0, 3), (1, 3)})
    assert near_copies.spanning_links(flat, first, np.array([7, 7, 8, 7])) == []
    assert len(near_copies.spanning_links(flat, first, np.array([7, 7, 8, 9]))) == 1


def test_stage_links_texts_whose_fingerprints_meet(spark):
    """Fingerprints within 2 bits link, as in op1, also where the similarity of sets of shingles is far below 0.8."""
    rng = random.Random(11)
    other = lambda k: " ".join(f"{k}{rng.randrange(9000)}" for _ in range(30))
    same = "red green blue " * 60
    texts = {k: same + other(f"n{k}x") for k in range(4)} | {k: other(f"m{k}y") for k in range(4, 8)}
    prints = {r.doc_id: r.print for r in spark.createDataFrame([*texts.items()], SCHEMA).select("doc_id", fingerprint(F.col("text")).alias("print")).collect()}
    far = [(a, b) for a in texts for b in texts if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() > 2]
    assert {(a, b) for a in texts for b in texts if a < b} - set(far) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
    assert len(shingles(texts[0]) & shingles(texts[1])) * 5 < len(shingles(texts[0]) | shingles(texts[1]))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([*texts.items()], SCHEMA).repartition(3), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5, 6, 7]
