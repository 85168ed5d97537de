"""Stems, BM25 and folds against an independent full-text engine and plain loops."""

from __future__ import annotations

import random
import sqlite3

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from prismdex.functions import text as text_
from prismdex.functions.chunks import chunked
from prismdex.functions.stems import WORD, folded, porter, stemmed_words
from prismdex.operators import folds, retrieval
from prismdex.settings import Settings
from prismdex.sources import documents

UNICODE_WORD = regex.compile(WORD)


def words(text):
    return [folded(w) for w in UNICODE_WORD.findall(text)]


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(80).collect()] + ["Café cafe CAFÉ naïve", "panels panel relational conditional hopping falling ponies caresses agreed feed sky happy"]


@pytest.fixture(scope="module")
def full_text(texts):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(texts)))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    return con


def test_stems_equal_those_of_a_full_text_engine(spark, texts, full_text):
    wanted: dict[int, list] = {}
    for term, doc, place in full_text.execute("SELECT term, doc, offset FROM v"):
        wanted.setdefault(doc, []).append((place, term))
    rows = spark.createDataFrame(list(enumerate(texts)), "vid int, text string").select("vid", stemmed_words(F.col("text")).alias("w")).collect()
    for r in rows:
        assert r.w == [t for _, t in sorted(wanted.get(r.vid, []))], texts[r.vid][:80]
    assert [porter(w) for w in words("Relational ponies")] == ["relat", "poni"]


def test_bm25_equals_that_of_a_full_text_engine(spark, texts, full_text):
    own = spark.createDataFrame(list(enumerate(texts)), "vid int, text string").select("vid", F.col("vid").alias("asset_id"), stemmed_words(F.col("text")).alias("w"))
    posted = own.select("vid", "asset_id", F.explode("w").alias("term")).groupBy("vid", "asset_id", "term").agg(F.count("*").alias("tf"))
    queries = ["panel panels", "café", "the licence of this software", texts[3].split()[0] + " " + texts[5].split()[-1], "nothingatall"]
    asked = spark.createDataFrame([(q, porter(w)) for q, text in enumerate(queries) for w in words(text)], "qid int, term string")
    got = {(r.qid, r.vid): r.raw for r in retrieval.bm25(posted, own.select("vid", F.size("w").alias("len")), asked).collect()}
    best = retrieval.bm25_best(own.withColumnRenamed("w", "words"), asked, per_asset=False, digits=12)
    assert {(r.qid, r.vid): r.raw for r in best.collect()} == pytest.approx(got, rel=1e-9)
    assert retrieval.bm25_best(own.withColumnRenamed("w", "words").limit(0), asked).count() == 0
    wanted = {}
    for q, text in enumerate(queries):
        phrase = " OR ".join(f'"{w}"' for w in words(text))
        wanted |= {(q, doc): -score for doc, score in full_text.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (phrase,))}
    assert got == pytest.approx(wanted, rel=1e-9) and len(got) > 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n ", max_size=3000), st.integers(20, 60))
def test_chunks_follow_the_rule(text, size):
    flat, out, i = " ".join(text.split()), [], 0
    if len(flat) <= size:
        out = [flat]
    else:
        while True:
            j = min(i + size, len(flat))
            if j < len(flat):
                k = flat.rfind(". ", i + size // 2, j)
                j = k + 1 if k != -1 else j
            out.append(flat[i:j].strip())
            if j >= len(flat):
                break
            i = max(j - 10, i + 1)
    assert chunked(flat, size, 10, 5) == [c for c in out if len(c) >= 5]


def test_chunks_and_transcripts_as_expressions(spark, texts):
    rng = random.Random(4)
    own = texts + ["", "short", "x" * 2000, *["".join(rng.choice("abc. \n") for _ in range(rng.randint(0, 4000))) for _ in range(40)]]
    rows = spark.createDataFrame(list(enumerate(own)), "i int, text string").select("i", text_.chunks(F.col("text")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: chunked(" ".join(t.split())) for i, t in enumerate(own)}
    said = [(g, k, float(k) * 1.5, rng.choice(["", "  ", "word " * rng.randint(1, 60)])) for g in range(6) for k in range(40)]
    found: dict[int, list] = {}
    for r in sorted(folds.transcript_buffers(spark.createDataFrame(said, "g int, k int, t double, x string"), "g", "k", "t", "x").collect(), key=lambda r: (r.g, r.ordinal)):
        found.setdefault(r.g, []).append((r.ref, r.text))
    for g in found:
        want, held = [], []
        for x in [x.strip() for h, _, _, x in said if h == g and x.strip()]:
            held.append(x)
            if sum(len(y) + 1 for y in held) > 500:
                want, held = [*want, " ".join(held)], []
        assert [x for _, x in found[g]] == want + ([" ".join(held)] if held else [])


def test_frames_are_compared_with_the_last_one_kept(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frames = spark.createDataFrame([(i % 3, i, [float(x) for x in v[i]]) for i in range(60)], "g int, i int, v array<double>")
    want = set()
    for g in range(3):
        last = None
        for i in range(g, 60, 3):
            if last is None or float(v[i] @ v[last]) < 0.4:
                want.add((g, i))
                last = i
    assert {(r.g, r.i) for r in folds.distinct_frames(frames, "g", "i", "v", 0.4).collect()} == want


def test_documents(spark, tmp_path):
    (tmp_path / "cases.json").write_text('{"One": ["a red car", {"query": "solar", "types": ["pdf"]}], "Two": ["<<< later >>>"]}')
    rows = documents.report_cases(spark, str(tmp_path / "cases.json")).orderBy("section_no", "position").collect()
    assert [(r.section, r.query, r.types) for r in rows] == [("One", "a red car", None), ("One", "solar", ["pdf"]), ("Two", "<<< later >>>", None)]
    (tmp_path / "m.json").write_text('{"a/x.png": {"title": "X", "categories": ["c", "d"], "description": "y"}}')
    assert documents.metadata_text(documents.manifest(spark, str(tmp_path / "m.json"))).first().text == "X c d y"
    schema = "n int, name string, type string, confidence double, size bigint, duration double, pages int, duplicates int, match struct<kind:string,ref:double>, said struct<ref:double,snippet:string>"
    shown = [
        (1, "a.png", "image", 0.995, 900, None, None, 2, ("image", None), (None, None)), (2, "b.mp4", "video", 0.5, 2_500_000, 75.0, None, 0, ("frame", 61.5), (None, None)), (3, "c.mp4", "video", 0.4, 999, 5.0, None, 0, ("transcript", 1.0), (1.0, "said")),
        (4, "d.pdf", "pdf", 0.9, 1500, None, 1, 0, ("page", 1.0), (3.0, " two\n words " + "x" * 200)), (5, "e.pdf", "pdf", 0.9, 1500, None, 4, 1, ("meta", None), (None, "title")),
    ]
    lines = [r.line for r in spark.createDataFrame(shown, schema).select("n", documents.report_line(F.col("n")).alias("line")).orderBy("n").collect()]
    assert lines[0] == "1. **a.png** — Image **100%** — 900 B — 3 copies" and lines[1] == "2. **b.mp4** — Video **50%** — 2.5 MB — 1:15 — match at **1:02**" and lines[2].endswith("0:05 — match n/a")
    assert lines[3] == '4. **d.pdf** — PDF **90%** — 2 KB — 1 page — visual match on page 1 — text on page 3: "two words ' + "x" * 150 + '…"' and lines[4].endswith('4 pages — text on page -: "title…" — 2 copies')
    table = documents.markdown_table(spark.createDataFrame([(1, None)], "a int, b string"))
    assert table.splitlines() == ["| a | b |", "| --- | --- |", "| 1 |  |"]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# note\nWORKERS=7\nCLIP_MARGIN='0.2'\nENABLE_ASR=true\nTHUMB_SIZE=1\n")
    found = Settings.from_env({"WORKERS": "9"}, tmp_path / ".env")
    assert (found.workers, found.clip_margin, found.enable_asr, found.thumb_size) == (9, 0.2, True, 320)


def test_nearest_in_blocks_equals_all_products(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, q = rng.integers(-3, 4, (500, 6)) / 2.0, rng.integers(-3, 4, (40, 6)) / 2.0
    rows = spark.createDataFrame([(i, i % 37, [float(x) for x in v[i]]) for i in range(500)], "vid int, asset_id int, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(k, [float(x) for x in q[k]]) for k in range(40)], "qid int, vector array<float>")
    raw = v @ q.T
    want = set()
    for k in range(40):
        best = sorted((-max(raw[i, k] for i in range(a, 500, 37)), min((i for i in range(a, 500, 37)), key=lambda i: (-raw[i, k], i)), a) for a in range(37))
        want |= {(k, a, vid, -score, rank) for rank, (score, vid, a) in enumerate(best[:5])}
    for block, cells in ((1000, 1 << 22), (7, 300)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        found = retrieval.cut_and_rank(retrieval.best_per_asset(retrieval.nearest(rows, asked, most=5), 9), most=5)
        assert {(r.qid, r.asset_id, r.vid, r.raw, r["rank"]) for r in found.collect()} == want
    plain = retrieval.cut_and_rank(retrieval.nearest(rows, asked, most=4, per_asset=False), most=4)
    assert sorted(r.raw for r in plain.collect()) == sorted(np.sort(raw, axis=0)[-4:].ravel().tolist())
    assert retrieval.nearest(rows.limit(0), asked).count() == 0 and retrieval.nearest(rows, asked.limit(0)).count() == 0
