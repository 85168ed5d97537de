"""Quality classifier by supervised subword embeddings.

Words, pairs of words and character n-grams of a text (with a blank at the edges of words) are hashed into ``BUCKETS`` rows of a table of
learned vectors; their mean is the document, a softmax over two classes its label.  Vectors and output weights are trained by numpy stochastic gradient descent,
one document a step, over a sample of labelled documents of bounded size: shards of it in tasks of their own, averaged after each epoch.

The output is linear in the mean, so after training each bucket needs one number, its vector times the difference of the output weights: that table is what
is broadcast (4 bytes a bucket, whatever the corpus), and a text is scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm import textblocks as tb
from prismdex.llm.tables import release, table, written

BITS = 16
BUCKETS = 1 << BITS
#: Lengths of character n-grams, in code points.
GRAMS = (3, 4)
#: Documents that are learned from at most: those of the least hashes of their ids.
SAMPLE = 4000
#: Documents that are trained from in one task.
SHARD = 500
#: A label, buckets, and how often each occurs.
Row = tuple[int, np.ndarray, np.ndarray]
_STEP, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Training:
    dim: int = 8
    epochs: int = 6
    #: Rate of the first epoch, falling to a tenth at the last; a step moves the mean of its document as far as it would move a single vector.
    rate: float = 0.5
    seed: int = 7


def _buckets(x: np.ndarray, kind: int) -> np.ndarray:
    return (tb.mix(x * _STEP + np.uint64(kind * int(_ODD) % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)


def features(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every feature of a block of texts, kind by kind."""
    starts, ends, first = tb.word_spans(tb.SPACE[raw], off)
    if not len(starts):
        return
    owner = tb.spread(first)
    names, distinct = tb.named(raw, starts, ends)
    words = tb.span_hashes(*tb.bytes_of(distinct))[names]
    yield owner, _buckets(words, 0)
    same = owner[1:] == owner[:-1]
    yield owner[1:][same], _buckets((words[:-1] * _STEP + words[1:])[same], 1)
    for back in range(1, 4):  # a word like one of the three before it is a feature, whatever the word is
        like = (names[back:] == names[:-back]) & (owner[back:] == owner[:-back])
        yield owner[back:][like], np.full(like.sum(), _buckets(np.zeros(1, np.uint64), 16 + back)[0])
    # Code points of the words, a blank in front of each and one at the end.
    chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    begin, length = points[starts], points[ends] - points[starts]
    at = np.concatenate([[0], np.cumsum(length + 1)])
    line = np.full(at[-1] + 1, 32, np.uint64)
    inside = np.ones(at[-1] + 1, bool)
    inside[at] = False
    line[inside] = chars[np.repeat(begin - at[:-1] - 1, length) + np.flatnonzero(inside)]
    text = np.append(np.repeat(owner, length + 1), owner[-1])
    rolling = line + np.uint64(1)
    for size in range(2, max(GRAMS) + 1):
        n = len(line) - size + 1
        if n <= 0:
            break
        rolling = rolling[:n] * _STEP + tb.mix(line[size - 1 :] + _ODD)
        if size in GRAMS:
            whole = np.ones(n, bool)  # no blank within
            for k in range(1, size - 1):
                whole &= inside[k : k + n]
            yield text[:n][whole], _buckets(rolling[whole], size)


def counts(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how often) of each text of a block."""
    found = [text * BUCKETS + bucket for text, bucket in features(raw, off)]
    both, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    edge = np.searchsorted(both, np.arange(len(off)) * BUCKETS)
    return [(both[i:j] % BUCKETS, n[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for raw, off in tb.blocks(batch.column("text"), tb.SMALL):
            pairs = counts(raw, off)
            lists = [_lists([p[k] for p in pairs]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(pairs)) for c in ("known", "label", "shard")], *lists], ["known", "label", "shard", "buckets", "often"])
            at += len(pairs)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """The documents of a shard as one row, by id."""
    rows = rows.sort_by("known").combine_chunks()
    columns = {"labels": rows["label"], "sizes": pa.array([len(x) for x in rows["buckets"]], pa.int32()), "buckets": rows["buckets"].combine_chunks().flatten(), "often": rows["often"].combine_chunks().flatten()}
    return pa.table({k: _lists([np.asarray(v)]) for k, v in columns.items()})


def _unpacked(batch: pa.RecordBatch, at: int) -> list[Row]:
    labels, sizes, buckets, often = (batch.column(k)[at].values.to_numpy() for k in ("labels", "sizes", "buckets", "often"))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return [(int(x), buckets[i:j], often[i:j]) for x, i, j in zip(labels, edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """The log odds of label 1 of each bucket alone, and of a text without words."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def start(how: Training) -> Model:
    """Small vectors given by the seed; every score is a half."""
    rng = np.random.default_rng(how.seed)
    return Model(rng.uniform(-1 / how.dim, 1 / how.dim, (BUCKETS, how.dim)).astype(np.float32), np.zeros((2, how.dim), np.float32), np.zeros(2, np.float32))


def epoch(model: Model, rows: list[Row], number: int, how: Training) -> Model:
    """The model after one step for each of the rows (label, buckets, how often), in an order given by the seed."""
    vectors, output, bias = model.vectors.copy(), model.output.copy(), model.bias.copy()
    rate = np.float32(how.rate * (1 - 0.9 * number / max(how.epochs - 1, 1)))
    for k in np.random.default_rng([how.seed, number]).permutation(len(rows)):
        label, at, often = rows[k]
        share = often / np.float32(max(often.sum(), 1))
        own = vectors[at]
        mean = share @ own
        z = output @ mean + bias
        odds = np.exp(z - z.max())
        error = odds / odds.sum()
        error[label] -= 1
        back = error @ output
        output -= rate * np.outer(error, mean)
        bias -= rate * np.float32(0.1) * error
        if len(at):
            own -= np.outer(share / (share @ share), rate * back)
            vectors[at] = own
    return Model(vectors, output, bias)


def averaged(models: list[tuple[Model, int]]) -> Model:
    """Mean of models that were trained apart, by their numbers of rows."""
    total = sum(n for _, n in models)
    return Model(*[sum(getattr(m, k) * np.float32(n / total) for m, n in models) for k in ("vectors", "output", "bias")])


def _trained(sent, number: int, how: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = _unpacked(batch, at)
                model = epoch(sent.value, rows, number, how)
                yield pa.RecordBatch.from_pydict({"n": [len(rows)], **{k: [getattr(model, k).tobytes()] for k in _PARTS}})

    return run


_PARTS = ("vectors", "output", "bias")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, shard: int = SHARD, how: Training = Training()) -> Model:
    """A model of at most ``most`` labelled documents, those of least hashes of their ids; without any its scores are a half.

    Labels over 0 count as 1; null labels, and ids that are null or have both labels, are left out; repeated labels count once, and of documents
    that share an id the least text.  Shards of about ``shard`` documents are trained apart, an epoch at a time, and averaged; only
    their models (a megabyte for 30,000 buckets of 8 numbers) go through the driver.
    """
    spark = docs.sparkSession
    marked = labels.where(f"doc_id IS NOT NULL AND `{label}` IS NOT NULL").groupBy(F.col("doc_id").alias("known")).agg(F.min(F.col(label) > 0).alias("low"), F.max(F.col(label) > 0).alias("high"))
    chosen = marked.where("low = high").orderBy(F.xxhash64(F.lit(how.seed), "known"), "known").limit(most)
    chosen = written(chosen.select("known", F.col("high").cast("int").alias("label")), "labels")
    shards = max(1, -(-chosen.count() // shard))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("known")).groupBy("known", "label").agg(F.min("text").alias("text"))  # at most ``most`` rows of two numbers
    texts = texts.select("known", "label", F.pmod(F.xxhash64("known"), F.lit(shards)).cast("int").alias("shard"), "text")
    kind = "array<int>"
    packed = texts.mapInArrow(_counted, f"known {dict(chosen.dtypes)['known']}, label int, shard int, buckets {kind}, often {kind}").groupBy("shard").applyInArrow(_packed, f"labels {kind}, sizes {kind}, buckets {kind}, often {kind}")
    rows, model = written(packed, "features"), start(how)
    for number in range(how.epochs):
        sent = spark.sparkContext.broadcast(model)
        found = rows.mapInArrow(_trained(sent, number, how), "n long, vectors binary, output binary, bias binary").orderBy("n", F.xxhash64("vectors")).collect()
        sent.unpersist()
        if found:
            model = averaged([(Model(*[np.frombuffer(x[k], np.float32).reshape(getattr(model, k).shape) for k in _PARTS]), x.n) for x in found])
    release(chosen, rows)
    return model


def scores(raw: np.ndarray, off: np.ndarray, odds: np.ndarray, none: float) -> np.ndarray:
    total, n = np.zeros(len(off) - 1), np.zeros(len(off) - 1, np.int64)
    for text, bucket in features(raw, off):
        total += np.bincount(text, odds[bucket], len(off) - 1)
        n += np.bincount(text, minlength=len(off) - 1)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + none, -40, 40)))


def scored(spark, model: Model, text: Column) -> Column:
    """The probability of label 1 of each text; null and empty texts have that of a text without words."""
    odds, none = model.folded()
    sent = spark.sparkContext.broadcast(odds)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        parts = [scores(raw, off, sent.value, none) for raw, off in tb.blocks(text, tb.SMALL)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(text)


def classify(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Each row of ``docs`` with its score (0 to 1) in the column ``into``, which is replaced if there; no shuffle.

    Only the text is looked at: repeated rows have one score, whatever their other columns; a very long text is scored whole, in a block of its own; an empty table gives an empty one.
    """
    return docs.withColumn(into, scored(docs.sparkSession, model, F.col("text")))


def held_out(doc_id: Column) -> Column:
    """Whether labels of the id are kept from training; null ids have none and count as no digits."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op13_classifier(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    found = classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
