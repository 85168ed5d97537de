"""Benchmark decontamination over a distributed positional inverted index.

Index: each task turns its documents into segments of postings: the words of the segment in the order of their 64-bit hashes, and
for each the positions at which it stands.  Every token is posted, whatever the benchmark; documents are set apart by a gap, so no
phrase can cross from one into the next.  Segments are a table in the shared folder that any number of benchmarks can query.

Query: the benchmark is cut into pieces of bounded size and these into blocks of about ``block_words`` words, each
of which is sent to the tasks in turn.  Within a segment, the words of a block are looked up by hash and confirmed by their letters;
each window whose words all occur starts from the posting list of its rarest term there, shifted by the term's offset, and is intersected with
the shifted lists of the next rarest terms until none is left.  With ``slop`` a term may also stand up to that many words from its place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm import textblocks as tb
from prismdex.llm.tables import release, table, written

WINDOW = 10
#: Positions between two documents of a segment; slop is below it.
GAP = 64
SEGMENT_WORDS = 1 << 18
PIECE = 1000
CANDIDATES = 1 << 20
#: Row groups of a few segments, so that writer and reader hold no more of them.
ROW_GROUPS = {"parquet.block.size": str(1 << 23), "parquet.page.size.row.check.min": "1"}

#: lexicon: the words, a line end after each; hashes and sizes (of postings) as int64 and int32, positions as int32, all little-endian.
_INDEX = "segment long, doc_ids array<bigint>, text_keys array<bigint>, n_words array<bigint>, lexicon binary, hashes binary, sizes binary, positions binary"


def lower_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """(name of each word, distinct words, first): A-Z lower-cased, words of digits, letters and all beyond ASCII."""
    low = tb.LOWER[raw]
    starts, ends, first = tb.word_spans(tb.NON_WORD[low], off)
    return *tb.named(low, starts, ends), first


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, at = batch.column(0), 0
        for raw, off in tb.blocks(batch.column(1)):
            names, distinct, first = lower_words(raw, off)
            for k in range(len(off) - 1):
                own = names[first[k] : first[k + 1]]
                for p in range(0, max(len(own) - WINDOW + 1, min(len(own), 1)), PIECE):
                    words = distinct.take(pa.array(own[p : p + PIECE + WINDOW - 1]))
                    yield pa.RecordBatch.from_arrays([ids.slice(at + k, 1), pa.array([p], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], ["item_id", "part", "words"])
            at += len(off) - 1


def benchmark_pieces(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, words): at most PIECE windows each; their words overlap, so every window is in one piece."""
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(_pieces, "item_id string, part long, words array<string>")


def _segment(name: int, docs: list, keys: list, sizes: list, blocks: list) -> pa.RecordBatch:
    """blocks: (names, distinct words, positions)."""
    both = pa.chunked_array([d for _, d, _ in blocks]).combine_chunks().dictionary_encode()  # the words of all blocks under one set of names
    shared, words = both.indices.to_numpy(), both.dictionary
    starts = np.cumsum([0, *[len(d) for _, d, _ in blocks]])
    t = np.concatenate([shared[starts[k] : starts[k + 1]][n] for k, (n, _, _) in enumerate(blocks)])
    p = np.concatenate([x for _, _, x in blocks]).astype(np.int32)
    raw, begin, end = tb.bytes_of(words)
    hashes = tb.span_hashes(raw, begin, end).view(np.int64)
    by_hash = np.argsort(hashes, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[by_hash] = np.arange(len(words))
    rank = rank[t]
    order = np.argsort(rank << 32 | np.arange(len(rank)))  # all different, so any sort keeps places in order
    lines = "\n".join([*words.take(pa.array(by_hash)).to_pylist(), ""]).encode()
    binary = [lines, hashes[by_hash].astype("<i8").tobytes(), np.bincount(rank, minlength=len(words)).astype("<i4").tobytes(), p[order].astype("<i4").tobytes()]
    lists = [pa.concat_arrays(docs), pa.concat_arrays(keys), pa.array(np.concatenate(sizes), pa.int64())]
    arrays = [pa.array([name], pa.int64()), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], *[pa.array([x], pa.binary()) for x in binary]]
    return pa.RecordBatch.from_arrays(arrays, ["segment", "doc_ids", "text_keys", "n_words", "lexicon", "hashes", "sizes", "positions"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, fresh = TaskContext.get().partitionId() << 32, lambda: ([], [], [], [], 0)
    docs, keys, sizes, blocks, base = fresh()
    for batch in batches:
        at = 0
        for raw, off in tb.blocks(batch.column(2)):
            n = len(off) - 1
            names, distinct, first = lower_words(raw, off)
            own = np.diff(first)
            begins = base + np.concatenate([[0], np.cumsum(own + GAP)])
            blocks.append((names, distinct, np.arange(len(names)) + np.repeat(begins[:-1] - first[:-1], own)))
            docs.append(batch.column(0).slice(at, n))
            keys.append(batch.column(1).slice(at, n))
            sizes.append(own)
            at, base = at + n, int(begins[-1])
            if base >= SEGMENT_WORDS:
                yield _segment(name, docs, keys, sizes, blocks)
                name += 1
                docs, keys, sizes, blocks, base = fresh()
    if docs:
        yield _segment(name, docs, keys, sizes, blocks)


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text): segments of postings, written to the shared folder; ``matches`` reads it as often as wanted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return written(rows.mapInArrow(_indexed, _INDEX), "postings", **ROW_GROUPS)


class Windows:
    """The distinct windows of a block of benchmark pieces."""

    def __init__(self, rows: list):
        grid, owner, length = [], [], []
        items: dict[str | None, int] = {}
        known: dict[str, int] = {}
        for row in rows:
            words = np.array([known.setdefault(w, len(known)) for w in row.words], np.int64)
            size = min(len(words), WINDOW)
            view = np.lib.stride_tricks.sliding_window_view(words, size)
            padded = np.zeros((len(view), WINDOW), np.int64)
            padded[:, :size] = view
            grid.append(padded)
            length.append(np.full(len(view), size))
            owner.append(np.full(len(view), items.setdefault(row.item_id, len(items))))
        self.items = list(items)
        both, inverse = np.unique(np.column_stack([np.concatenate(length), np.concatenate(grid)]), axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([inverse.ravel(), np.concatenate(owner)]), axis=0)
        self.length, self.term = both[:, 0], both[:, 1:]
        self.item_first, self.item = np.searchsorted(pairs[:, 0], np.arange(len(both) + 1)), pairs[:, 1]
        self.vocabulary = pa.array(list(known), pa.string())
        hashes = tb.span_hashes(*tb.bytes_of(self.vocabulary)).view(np.int64)
        self.by_hash = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.by_hash]

    def _postings(self, lexicon: bytes, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, count) in the segment's positions of every word of the vocabulary."""
        begin, count = np.zeros((2, len(self.hashes)), np.int64)
        low, high = np.searchsorted(hashes, self.hashes), np.searchsorted(hashes, self.hashes, "right")
        some = np.flatnonzero(high > low)
        if len(some):
            words, first = lexicon.decode().split("\n"), np.cumsum(sizes) - sizes
            asked = self.vocabulary.take(pa.array(self.by_hash[some])).to_pylist()
            for k, word, a, b in zip(self.by_hash[some].tolist(), asked, low[some].tolist(), high[some].tolist(), strict=True):
                for at in range(a, b):  # one, unless unlike words share a hash
                    if words[at] == word:
                        begin[k], count[k] = first[at], sizes[at]
        return begin, count

    def find(self, lexicon: bytes, hashes: np.ndarray, sizes: np.ndarray, positions: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every match in a segment."""
        source, count = self._postings(lexicon, hashes, sizes.astype(np.int64))
        inside = np.arange(WINDOW) < self.length[:, None]
        alive = np.flatnonzero(((count > 0)[self.term] | ~inside).all(1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if not len(alive):
            return found[0]
        used = np.unique(self.term[alive][inside[alive]])
        begin = np.zeros(len(count), np.int64)
        begin[used] = np.cumsum(count[used]) - count[used]
        at = np.arange(count[used].sum()) + np.repeat(source[used] - begin[used], count[used])
        keys = np.repeat(used, count[used]) << 32 | positions[at]
        rarity = np.where(inside[alive], count[self.term[alive]], np.iinfo(np.int64).max)
        offset = np.argsort(rarity, axis=1, kind="stable")
        term = np.take_along_axis(self.term[alive], offset, 1)
        rarest, length = term[:, 0], self.length[alive]
        load = np.cumsum(count[rarest])
        i = 0
        while i < len(alive):
            j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + CANDIDATES, "right")))
            many = count[rarest[i:j]]
            own = np.repeat(np.arange(i, j), many)
            start = (keys[np.repeat(begin[rarest[i:j]] - (np.cumsum(many) - many), many) + np.arange(len(own))] & 0xFFFFFFFF) - offset[own, 0]
            for k in range(1, WINDOW):
                need = (term[own, k] << 32) + start + offset[own, k]
                place = np.searchsorted(keys, need - slop)
                fits = (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] <= need + slop) | (k >= length[own])
                own, start = own[fits], start[fits]
                if not len(own):
                    break
            found.append((alive[own], start))
            i = j
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


_MATCH = "segment long, ordinal int, items array<string>, spans array<struct<a:int,b:int>>"


def _matcher(windows, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = windows.value
        for batch in batches:
            for r in range(batch.num_rows):
                sizes, lexicon = batch.column(1)[r].values.to_numpy(), batch.column(2)[r].as_py()
                hashes, counts, positions = (np.frombuffer(batch.column(k)[r].as_py(), kind) for k, kind in ((3, "<i8"), (4, "<i4"), (5, "<i4")))
                window, start = w.find(lexicon, hashes, counts, positions, slop)
                if not len(window):
                    continue
                begins = np.concatenate([[0], np.cumsum(sizes + GAP)])
                ordinal = np.searchsorted(begins, np.maximum(start, 0), "right") - 1
                a = np.maximum(start - begins[ordinal], 0)
                b = np.minimum(start - begins[ordinal] + w.length[window], sizes[ordinal])
                order = np.lexsort((a, ordinal))
                o, a, b = ordinal[order], a[order], b[order]
                reach = np.maximum.accumulate(o.astype(np.int64) << 32 | b)  # ends so far in the same document
                new = np.ones(len(o), bool)
                new[1:] = (o[1:] != o[:-1]) | (a[1:] > (reach[:-1] & 0xFFFFFFFF))
                head = np.flatnonzero(new)
                span_doc, span_a, span_b = o[head], a[head], reach[np.append(head[1:], len(o)) - 1] & 0xFFFFFFFF
                many = np.diff(w.item_first)[window]
                item = w.item[np.repeat(w.item_first[window], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                pairs = np.unique(np.column_stack([np.repeat(ordinal, many), item]), axis=0)
                docs = np.unique(o)
                cut, cut_items = np.searchsorted(span_doc, docs), np.searchsorted(pairs[:, 0], docs)
                names = pa.array([w.items[k] for k in pairs[:, 1]], pa.string())
                spans = pa.StructArray.from_arrays([pa.array(span_a.astype(np.int32)), pa.array(span_b.astype(np.int32))], ["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(docs), batch.column(0)[r].as_py(), np.int64)), pa.array(docs.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.append(cut_items, len(pairs)).astype(np.int32)), names),
                        pa.ListArray.from_arrays(pa.array(np.append(cut, len(span_doc)).astype(np.int32)), spans),
                    ],
                    ["segment", "ordinal", "items", "spans"],
                )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, slop: int = 0, block_words: int = 1_000_000, index: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key (XXH64 of the text), n_words, items, spans.

    items: the distinct item_ids (as strings, sorted) with a window in the document; spans: the merged word ranges
    [a, b) of all such windows.  slop 0: exact phrases; over 0: proximity matches too, in which each term of the window stands
    within that many words of its place (spans are then those of the place).  An item of fewer than ten words is one
    window; an item or document without words, or null, matches nothing.  A null item_id can hit but is not listed.
    Repeated documents or items are each looked at; an empty benchmark hits nothing; other columns are ignored.  A very long document is
    one segment (below 2**31 words); a very long item goes in pieces.  index: that of ``build_index(docs)``, which stays; by default one is built and removed.
    """
    if not 0 <= slop < GAP // 2:
        raise ValueError(f"slop must be from 0 to {GAP // 2 - 1}")
    spark = docs.sparkSession
    segments = index if index is not None else build_index(docs)
    pieces_ = written(benchmark_pieces(benchmark), "benchmark")
    total = pieces_.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first().n
    n_blocks = max(1, math.ceil(total / block_words))
    pieces = pieces_.withColumn("block", F.pmod(F.xxhash64("item_id", "part"), F.lit(n_blocks)))
    found = spark.createDataFrame([], _MATCH)
    for block in range(n_blocks if total else 0):
        rows = pieces.where(F.col("block") == block).select("item_id", "words").collect()  # about block_words words
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(Windows(rows))
        hits = written(segments.select("segment", "n_words", "lexicon", "hashes", "sizes", "positions").mapInArrow(_matcher(sent, slop), _MATCH), "matches")
        sent.unpersist()
        found = found.union(hits)
    rows = segments.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("ordinal", "d"))
    rows = written(rows.select("segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.n_words").alias("n_words")), "judged")
    release(pieces_, *[segments] * (index is None))
    found = found.groupBy("segment", "ordinal").agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("items"))))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    found = found.mapInArrow(_joined, _MATCH)
    rows = rows.join(found, ["segment", "ordinal"], "left")
    return rows.select("doc_id", "text_key", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of different blocks of the benchmark as one list of merged ranges."""
    for batch in batches:
        spans, first = [], [0]
        for row in batch.column(3):
            spans.append(np.column_stack(tb.merged(row.values.field("a").to_numpy(), row.values.field("b").to_numpy())))
            first.append(first[-1] + len(spans[-1]))
        both = np.concatenate([np.zeros((0, 2), np.int32), *spans])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(both[:, 0].astype(np.int32)), pa.array(both[:, 1].astype(np.int32))], ["a", "b"]))], ["segment", "ordinal", "items", "spans"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their columns; rows without doc_id are judged too."""
    bad = matches(docs, benchmark).where(F.size("spans") > 0).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    bad = written(bad, "contaminated")  # its size is known then, and texts need not be shuffled where it is small
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__doc"]) & (F.xxhash64(docs["text"]) == bad["__key"])
    return docs.join(bad, same, "left_anti")


def op7_decontaminate(spark, sf_dir) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["b"] - x["a"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
