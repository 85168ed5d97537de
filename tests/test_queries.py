"""Every query of the engine against its SQL, and the entry points with and without the corpus subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from prismdex.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    result = tables.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    by_text = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=by_text) == sorted(wanted, key=by_text)


def test_entry_points_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'hybrid_search' in e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())"
    env = os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True, timeout=120)
