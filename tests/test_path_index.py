"""The index of paths against plain loops over them."""

from __future__ import annotations

import random

import pytest
from fakes import OPENERS
from pyspark.sql import functions as F

from prismdex.operators import path_index
from prismdex.operators.path_index import PathIndex
from prismdex.operators.retrieval import Filters
from prismdex.plans.engine import Engine
from prismdex.settings import Settings
from prismdex.sources.embedders import PlainEmbedder

ODD = ["/A/Foo.JPG", "/a/foo.jpg", "/É/é.png", "/x\0y", "", "a", "ab", "/50%_off\\now.pdf", "/\U0001f600/smile.mp4", "/a/foo.jpg", None, "/" + "long" * 500, "/aaaa/aaaaa"]
PATTERNS = ["foo", "FOO", "/", "a", "AB", "É", "é", "\0", "x\0y", "%_", "50%_OFF\\", "\U0001f600/s", "ngl", "aaaaaa", "nowhere", "zz", ".jp", "e/4", "", None]


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


@pytest.fixture(scope="module")
def paths():
    draw = random.Random(3)
    return ODD + [f"/{draw.choice('abcé')}e/{draw.randrange(60)}/{draw.choice(['IMG', 'img', 'scan'])}_{draw.randrange(900)}{draw.choice(['.jpg', '.PNG', '.pdf'])}" for _ in range(700)]


@pytest.fixture(scope="module")
def index(spark, paths, tmp_path_factory):
    kept, path_index.PLACES, path_index.SEGMENTS = (path_index.PLACES, path_index.SEGMENTS), 5, 2  # many segments and folders
    files = spark.createDataFrame(list(enumerate(paths)), "asset_id long, path string")
    yield PathIndex.opened(files, str(tmp_path_factory.mktemp("paths")), "v1")
    path_index.PLACES, path_index.SEGMENTS = kept


def test_many_patterns(spark, paths, index):
    found = index.search(spark.createDataFrame(list(enumerate(PATTERNS)), "qid int, pattern string"))
    rows = sorted((r.qid, r.asset_id) for r in found.collect())
    assert rows == [(q, k) for q, pattern in enumerate(PATTERNS) if pattern for k, p in enumerate(paths) if p is not None and lower(pattern) in lower(p)]


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if p is not None])
def test_one_pattern(paths, index, pattern):
    assert sorted(r.asset_id for r in index.find(pattern).collect()) == [k for k, p in enumerate(paths) if pattern and p is not None and lower(pattern) in lower(p)]


def test_candidates_are_few(spark, paths, index):
    few = index.candidates(spark.createDataFrame([(0, "img_77")], "qid int, pattern string")).count()
    assert few <= 2 * sum("img_77" in lower(p or "") for p in paths) + 2


def test_a_signature_is_read_again_and_no_rows_are_an_index(spark, index, tmp_path):
    root, signature = index.root.rsplit("/", 1)
    other = spark.createDataFrame([(1, "/other")], "asset_id long, path string")
    assert PathIndex.opened(other, root, signature).find("/other").count() == 0 and PathIndex.opened(other, root, "v2").find("/other").count() == 1
    empty = PathIndex.opened(other.limit(0), str(tmp_path), "v")
    assert empty.find("oth").count() == 0 and empty.search(other.select(F.col("asset_id").alias("qid"), F.col("path").alias("pattern"))).count() == 0


def test_searches_of_the_engine_use_it(spark, tmp_path):
    root = tmp_path / "media"
    for k, name in enumerate(("Trip/one.png", "home/trip.png", "home/two.png")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"IMG\n250 {k} 5")
    engine = Engine(spark, str(tmp_path / "index"), Settings(), PlainEmbedder(), OPENERS, pause=0.0, packed=0)
    engine.index(str(root))
    assert {r["name"] for r in engine.search("red", Filters(folder="TRIP"))["results"]} == {"one.png", "trip.png"} and (tmp_path / "index" / "paths").exists()


def test_a_pattern_that_is_asked_often_is_looked_up_once(spark, paths, index, monkeypatch):
    looked = []
    monkeypatch.setattr(PathIndex, "candidates", lambda self, patterns, own=PathIndex.candidates: looked.append(patterns.count()) or own(self, patterns))
    asked = spark.createDataFrame([(q, ".JP" if q % 2 else ".jp") for q in range(50)] + [(50, None), (51, "")], "qid int, pattern string")
    rows = sorted((r.qid, r.asset_id) for r in index.search(asked).collect())
    own = [k for k, p in enumerate(paths) if ".jp" in lower(p or "")]
    assert rows == [(q, k) for q in range(50) for k in own] and len(looked) == 1 and looked[0] <= 3
