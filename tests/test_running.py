"""What a task of a search holds and puts out, against plain loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismdex.operators import retrieval


@pytest.mark.parametrize(("assets", "levels", "positive"), [(200, 10_000, False), (200, 3, True), (4, 50, False), (200, 1, True)])
def test_running_best_of_parts(assets, levels, positive):
    rng = np.random.default_rng(assets + levels)
    scores, asset = rng.integers(-2 if levels > 1 else 1, levels + 1, (900, 3)) / 7, rng.integers(0, assets, 900)
    scores[:, 2] = np.where(np.arange(900) < 3, 1.0, -1.0)  # few for one query
    qids, rows = pa.array(["a", "b", "c"]), pa.table({"vid": np.arange(900), "asset_id": asset})
    for per_asset in (True, False):
        best, out = retrieval._Running(qids, 5, per_asset, positive), []
        for k in range(0, 900, 20):
            out += best.add(scores[k : k + 20], rows.slice(k, 20))
        best.cut()
        found = pa.Table.from_batches([*out, *best.rows()]).to_pylist()
        for q, name in enumerate("abc"):
            every = sorted((-s, v, a) for v, (s, a) in enumerate(zip(scores[:, q], asset.tolist(), strict=True)) if s > 0 or not positive)
            own, seen, want = sorted((-r["raw"], r["vid"], r["asset_id"]) for r in found if r["qid"] == name), set(), []
            for s, v, a in every:
                if not per_asset or a not in seen:
                    want.append((s, v, a))
                    seen.add(a)
            got, seen = [], set()
            for s, v, a in own:
                if not per_asset or a not in seen:
                    got.append((s, v, a))
                    seen.add(a)
            assert got[:5] == want[:5]


def test_a_task_puts_out_its_best_rows_once(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(3000).coalesce(1).select(F.col("id").alias("vid"), F.col("id").alias("asset_id"), F.array(F.rand(1), F.rand(2)).alias("vector"))
        asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.3, 1.0])], "qid int, vector array<double>")
        assert retrieval.nearest(rows, asked, most=5, digits=None).count() == 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
