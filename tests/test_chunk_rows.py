"""Chunks as rows, against the chunks of each text."""

from __future__ import annotations

import random

import pyarrow as pa

from prismdex.functions import chunks


def test_chunks_leave_a_few_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(chunks, "HELD", 5000)
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(99)}." for _ in range(rng.randrange(700))) for _ in range(60)] + [None, "", "x" * 20_000, "é" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"]).slice(1)
    out = list(chunks.chunk_rows()([batch]))
    want = [(k, n, c) for k, x in enumerate(texts) if k and x is not None for n, c in enumerate(chunks.chunked(x))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want and len(out) > 20
    assert chunks.chunk_lists(900, 150, 20)(batch.column(1)).to_pylist() == [None if x is None else chunks.chunked(x) for x in texts[1:]]
