"""What workers hold: kept pieces of the encoder without objects of Python, and Arrow batches of texts by bytes."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismdex.llm import textblocks as tb
from prismdex.llm import token_files
from prismdex.llm.tables import small_batches

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(encode, texts):
    ((raw, off),) = tb.blocks(pa.array(texts))
    ids, first = encode(raw, off)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_kept_pieces_are_small():
    words = [f"{k:x}q{k * 7919 % 99991:x}" for k in range(30_000)]
    text = " ".join(words)
    encode = token_files.Encoder(PATH)
    tracemalloc.start()
    encoded(encode, [text])
    held = tracemalloc.get_traced_memory()[0] + sum(x.nbytes for x in vars(encode).values() if isinstance(x, pa.Array))
    tracemalloc.stop()
    assert held < 80 * len(words)


@pytest.mark.parametrize("one_hash", [False, True])
def test_kept_pieces_are_told_apart_by_their_bytes(monkeypatch, one_hash):
    if one_hash:
        monkeypatch.setattr(tb, "span_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["one two three.", "two  one", "", "three, one\ntwo", "\ttab one", "eins zwei drei one", " one one"]
    library, encode = Tokenizer.from_file(PATH), token_files.Encoder(PATH)
    for part in (texts[:3], texts[3:], texts, texts[::-1]):
        assert encoded(encode, part) == [library.encode(x, add_special_tokens=False).ids for x in part]


def test_batches_of_texts_follow_their_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows, name = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), F.lit(5000)).alias("text")), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark):
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 20_000_000 and max(found) < 5_000_000
    assert spark.conf.get(name) == before
