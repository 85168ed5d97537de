"""Order-dependent folds, whose state depends on what was kept: not a lag.

Rows are dealt by group and sorted within the partitions, and each task streams over its batches with the state of the open group only: the last kept
vector or the open buffer.  No group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from prismdex.functions import fixed


def distinct_frames(frames: DataFrame, group: str, order: str, vector: str, threshold: float) -> DataFrame:
    """The rows that stay when each frame is dropped that is as similar as ``threshold`` to the last frame kept before it.

    Ties in ``order`` must not occur; rows without a vector are dropped.
    """
    own, by = frames.columns.index(vector), frames.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, object()
        for batch in batches:
            keep = []
            for name, v in zip(batch.column(by).to_pylist(), batch.column(own), strict=True):
                v = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                last = last if name == open_ else None
                keep.append(last is None or float(v @ last) < threshold)
                last, open_ = v if keep[-1] else last, name
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = frames.where(F.col(vector).isNotNull()).repartition(group).sortWithinPartitions(group, order)
    return rows.mapInArrow(run, frames.schema)


def transcript_buffers(segments: DataFrame, group: str, order: str, start: str, text: str, over: int = fixed.TRANSCRIPT_OVER) -> DataFrame:
    """(group, ordinal, ref, text): segments of a recording joined until more than ``over`` characters have come together.

    Blank segments are skipped; each adds a space and itself; ref is the start of the first, to one decimal; a rest is a buffer too.
    """
    said = segments.select(group, order, F.col(start).cast("double").alias("ref"), F.trim(text).alias("text")).where("text <> ''")
    rows = said.repartition(group).sortWithinPartitions(group, order).select(group, "ref", "text")
    kind = dict(rows.dtypes)[group]
    names, first = [group, "ordinal", "ref", "text"], to_arrow_schema(rows.select(group).schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, number, begin, held, size = object(), 0, 0.0, [], 0
        for batch in batches:
            out = []
            for name, ref, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != open_:
                    if held:
                        out.append((open_, number, begin, " ".join(held)))
                    open_, number, held, size = name, 0, [], 0
                begin = begin if held else ref
                held.append(x)
                size += len(x) + 1
                if size > over:
                    out.append((name, number, begin, " ".join(held)))
                    number, held, size = number + 1, [], 0
            yield _batch(out)
        yield _batch([(open_, number, begin, " ".join(held))] if held else [])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((first, pa.int32(), pa.float64(), pa.string()))], names)

    found = rows.mapInArrow(run, f"`{group}` {kind}, ordinal int, ref double, text string")
    return found.withColumn("ref", F.round("ref", 1))


def drop_blank_frames(frames: DataFrame, group: str, deviation: str, over: float = 2.0) -> DataFrame:
    """Frames whose grey deviation is over the limit; all of a video if none is."""
    any_ = frames.groupBy(group).agg(F.max(F.col(deviation) > over).alias("__some"))
    return frames.join(any_, group).where((F.col(deviation) > over) | ~F.col("__some")).drop("__some")
