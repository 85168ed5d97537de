"""Repeated strings of the greatest lengths, whose common prefixes go beyond 255 columns."""

from __future__ import annotations

import random

import numpy as np
import pytest

from prismdex.llm import suffix_dedup


def removed_by_hand(texts, length):
    seen, out = set(), []
    for text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if text[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(text[p : p + length])
        out.append(sum(gone))
    return out


@pytest.mark.parametrize("length", [144, 200])
def test_common_prefixes_of_256_columns_and_more(length):
    width, n = 2 * length - 32, length - 32
    cols = np.random.default_rng(4).integers(97, 123, width, dtype=np.uint8).repeat(2).reshape(width, 2)
    cols[: width - 256, 1] = 65  # the second piece agrees over the last 256 columns exactly
    again = suffix_dedup.repeated_strings(cols, np.zeros(2, np.int64), np.full(2, n), length)
    want = [bool((cols[k : k + length, 0] == cols[k : k + length, 1]).all()) for k in range(n)]
    assert again[1, :n].tolist() == want and any(want) and not again[0].any()


@pytest.mark.parametrize("length", [144, 200])
def test_remove_repeats_of_great_lengths(spark, length):
    rng = random.Random(6)
    some = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    shared = [some(k) for k in (length, length + 40, 2 * length - 40, 2 * length, 700)]
    texts = [some(rng.randrange(40)) + s[rng.randrange(3) :] + some(rng.randrange(40)) for s in shared for _ in range(8)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: sum(s.b - s.a for s in r.spans) for r in suffix_dedup.remove_repeats(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_hand([t.encode() for t in texts], length)


def test_a_long_periodic_text(spark):
    text = "abc" * 300_000
    rows = spark.createDataFrame([(1, text), (2, "x" * 70 + text[:500]), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), [(s.a, s.b) for s in r.spans]) for r in suffix_dedup.remove_repeats(rows).collect()}
    assert got == {1: (b"abc", [(3, 900_000)]), 2: (b"x" * 70, [(70, 570)]), 3: (b"", [])}
