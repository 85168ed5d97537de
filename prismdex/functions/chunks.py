"""Overlapping chunks of texts, in time in proportion to their length."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prismdex.functions import fixed

SENTENCE_END = re.compile(r"\.(?= )")
#: Bytes of texts that are cut together; a longer text is cut alone.
HELD = 1 << 20


def bounds(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Where the chunks of a text begin and end.

    A chunk spans ``size`` characters, or fewer where a full stop before a space stands in its second half: it then ends after the last such stop.  The next one
    begins ``overlap`` before that end, the last one ends with the text.
    """
    stops = [m.end() for m in SENTENCE_END.finditer(text)] if len(text) > size else []
    left = 0
    while len(text) - left > size:
        last = bisect_right(stops, left + size - 1)  # the space belongs to the span too
        right = stops[last - 1] if last and stops[last - 1] > left + size // 2 else left + size
        yield left, right
        left = max(left + 1, right - overlap)
    yield left, len(text)


def chunked(text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, least: int = fixed.CHUNK_LEAST) -> list[str]:
    """The chunks of a text whose white space is collapsed; those shorter than ``least`` are dropped."""
    found = (text[a:b].strip(" ") for a, b in bounds(text, size, overlap))
    return [c for c in found if len(c) >= least]


def chunk_lists(size: int, overlap: int, least: int):
    """An Arrow function from texts to their chunks; a null text has null.  Only ``HELD`` bytes of a batch are Python strings at a time."""
    kind = pa.list_(pa.string())

    def run(column: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else chunked(x, size, overlap, least) for x in part.to_pylist()], kind) for part in slices(column, HELD)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def chunk_rows(size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, least: int = fixed.CHUNK_LEAST):
    """A function from Arrow batches (keys..., text) to batches (keys..., n, text), a row for each chunk, that leave the task as they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            *keys, text = batch.columns
            for part in slices(text, HELD):
                lists = [() if x is None else chunked(x, size, overlap, least) for x in part.to_pylist()]
                own = pa.array([at + k for k, x in enumerate(lists) for _ in x], pa.int64())
                numbers, texts = pa.array([n for x in lists for n in range(len(x))], pa.int32()), pa.array([c for x in lists for c in x], pa.string())
                yield pa.RecordBatch.from_arrays([*[k.take(own) for k in keys], numbers, texts], [*batch.schema.names[:-1], "n", "text"])
                at += len(part)

    return run


def word_lists(column: pa.Array) -> pa.ListArray:
    """Lists of words, from such lists (as they are) or from strings of words with single spaces between them."""
    if not pa.types.is_string(column.type):
        return column
    lists = pc.split_pattern(column, " ")
    values, many = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    blank = pc.equal(column, "").fill_null(False)
    if pc.any(blank).as_py():
        values, many = values.filter(pc.not_equal(values, "")), np.where(blank.to_numpy(zero_copy_only=False), 0, many)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), values, mask=column.is_null())


def slices(column: pa.Array, held: int) -> Iterator[pa.Array]:
    """The column in order, in parts of up to ``held`` bytes of text (a longer text alone)."""
    ends = pc.cumulative_sum(pc.binary_length(column).fill_null(0).cast(pa.int64())).to_numpy()
    at, done = 0, 0
    while at < len(column):
        upto = max(at + 1, int(ends.searchsorted(done + held, "right")))
        yield column.slice(at, upto - at)
        at, done = upto, int(ends[upto - 1])
