"""Retrieval operators, each from DataFrames to a DataFrame, for a batch of queries at once.

Tables: assets (asset_id, type, ext, size, status, pipeline, indexed_ts, ...), files (path, asset_id, present, ...), vectors (vid, asset_id,
kind, ref, text, ...), postings (vid, asset_id, term, tf, len).  Hits: (qid, asset_id, vid, raw, rank).  Equal scores rank by vid,
then by asset_id; a vid is that of one text within its asset only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prismdex.functions import fixed
from prismdex.functions.chunks import word_lists

#: Queries that are sent to every task together, on average; more go in several passes over the texts or vectors.
QUERY_BLOCK = 1000
#: Scores that a task holds at once.
CELLS = 1 << 18


@dataclass(frozen=True)
class Filters:
    """Conditions of a search; None: no condition.  Sizes in bytes and times in epoch seconds, both ends included."""

    types: tuple[str, ...] | None = None
    exts: tuple[str, ...] | None = None
    min_size: float | None = None
    max_size: float | None = None
    folder: str | None = None
    after: float | None = None
    before: float | None = None


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def allowed_assets(assets: DataFrame, files: DataFrame, pipeline: str, filters: Filters = Filters(), find: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """asset_id of ready assets of the current pipeline with a present file, under the filters.

    folder: part of a path (file name included), without regard to the case of A-Z; ``find`` gives the present files whose path has it (an index), else all paths are
    read.  Filters reach the scans; files are a semi-join.
    """
    keep = (F.col("status") == "ready") & (F.col("pipeline") == pipeline)
    if filters.types:
        keep &= F.col("type").isin(*filters.types)
    if filters.exts:
        keep &= F.col("ext").isin(*[e if e.startswith(".") else f".{e}" for e in filters.exts])
    for column, low, high, whole in (("size", filters.min_size, filters.max_size, int), ("indexed_ts", filters.after, filters.before, float)):
        if low is not None:
            keep &= F.col(column) >= whole(low)
        if high is not None:
            keep &= F.col(column) <= whole(high)
    there = files.where("present")
    if filters.folder and find:
        there = find(filters.folder)
    elif filters.folder:
        there = there.where(F.contains(ascii_lower(F.col("path")), ascii_lower(F.lit(filters.folder))))
    return assets.where(keep).select("asset_id").join(there.select("asset_id"), "asset_id", "left_semi")


Matrix = Callable[[pa.Array], np.ndarray]


def dense(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; a null one is zero."""
    values, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), len(column)
    if not column.null_count:
        return values.reshape(n, -1) if n else np.zeros((0, 0))
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros((n, len(values) // max(len(there), 1)))
    out[there] = values.reshape(len(there), -1)
    return out


def hashed(column: pa.Array) -> np.ndarray:
    """Unit vectors of counts from lists of buckets; an empty list is zero."""
    lists = column.fill_null([]) if column.null_count else column
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    counts = np.bincount(owner * fixed.BUCKETS + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(lists) * fixed.BUCKETS).reshape(len(lists), fixed.BUCKETS).astype(np.float64)
    return counts / np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-300)


@lru_cache(1 << 17)
def _bucket(word: str) -> int:
    return hashlib.md5(word.encode(), usedforsecurity=False).digest()[-1]


def hashed_words(column: pa.Array) -> np.ndarray:
    """As ``hashed``, from lists of the words themselves: each distinct word of a batch is hashed once."""
    column = word_lists(column)
    coded = column.flatten().dictionary_encode()
    buckets = np.array([_bucket(w) for w in coded.dictionary.to_pylist()], np.int32)
    return hashed(pa.ListArray.from_arrays(_offsets(column), pa.array(buckets[coded.indices.to_numpy()])))


def _offsets(column: pa.Array) -> pa.Array:
    """Where the lists begin in the flattened values; null lists are empty."""
    return pa.array(np.append(0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))), pa.int32())


def _restricted(rows: DataFrame, allowed: DataFrame | Column | None) -> DataFrame:
    """Rows of allowed assets: those of a table (asset_id), or those that meet a condition."""
    if allowed is None:
        return rows
    return rows.where(allowed) if isinstance(allowed, Column) else rows.join(allowed, "asset_id", "left_semi")


def _best(scores: np.ndarray, rows: pa.Table, qids: pa.Array, most: int, per_asset: bool, positive: bool) -> pa.Table:
    """(qid, asset_id, vid, raw) of the ``most`` best rows of each query (a column of scores), equals of the last among them; per_asset: only the best of each asset, the smallest vid of equals."""
    n = rows.num_rows
    at = np.broadcast_to(np.arange(n)[:, None], scores.shape)
    if per_asset and n:
        order = pc.sort_indices(rows, [("asset_id", "ascending"), ("vid", "ascending")]).to_numpy()
        rows, scores = rows.take(pa.array(order)), scores[order]
        asset = rows["asset_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], asset[1:] != asset[:-1]]))
        best = np.maximum.reduceat(scores, heads, axis=0)
        same = scores == np.repeat(best, np.diff(np.append(heads, n)), axis=0)
        at = np.minimum.reduceat(np.where(same, at, n), heads, axis=0)
        scores = best
    keep = np.ones(scores.shape, bool)
    if len(scores) > most:
        keep = scores >= np.partition(scores, len(scores) - most, axis=0)[len(scores) - most]
    if positive:
        keep &= scores > 0
    i, q = np.nonzero(keep)
    found = rows.take(pa.array(at[i, q]))
    return pa.table([qids.take(pa.array(q)), found["asset_id"], found["vid"], pa.array(scores[i, q])], names=["qid", "asset_id", "vid", "raw"])


class _Running:
    """The best rows of each query among those of a task, as ``_best`` gives them, while parts of its rows come in.

    Rows below the ``most``-th best of the query so far are left out as they come.  Where equals of the last are so many that the rest is not small, what is held goes
    out and the bounds stay.
    """

    def __init__(self, qids: pa.Array, most: int, per_asset: bool, positive: bool) -> None:
        self.qids, self.most, self.per_asset, self.positive = qids, most, per_asset, positive
        self.low = np.full(len(qids), -np.inf)
        self.number = pa.array(np.arange(len(qids)))
        self.held: list[pa.Table] = []
        self.size, self.room = 0, 4 * most * max(len(qids), 1)

    def add(self, scores: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = scores >= self.low
        if self.positive:
            keep &= scores > 0
        if 4 * np.count_nonzero(keep) > keep.size:  # bounds are not there yet, or will not be, as assets are few
            self.held.append(_best(scores, rows, self.number, self.most, self.per_asset, self.positive))
        else:
            i, q = np.nonzero(keep)
            found = rows.take(pa.array(i))
            self.held.append(pa.table([pa.array(q), found["asset_id"], found["vid"], pa.array(scores[i, q])], names=["qid", "asset_id", "vid", "raw"]))
        self.size += self.held[-1].num_rows
        if self.size > self.room or len(self.held) == 1:
            self.cut()
            if 2 * self.size > self.room:
                yield from self.rows()

    def cut(self) -> None:
        if not self.held:
            return
        table = pa.concat_tables(self.held).combine_chunks()
        if self.per_asset:
            table = table.sort_by([("qid", "ascending"), ("asset_id", "ascending"), ("raw", "descending"), ("vid", "ascending")])
            q, asset = table["qid"].to_numpy(), table["asset_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            first = np.ones(len(q), bool)
            first[1:] = (q[1:] != q[:-1]) | (asset[1:] != asset[:-1])
            table = table.filter(pa.array(first))
        q, raw = table["qid"].to_numpy(), table["raw"].to_numpy()
        order = np.lexsort((-raw, q))
        edge = np.searchsorted(q[order], np.arange(len(self.qids) + 1))
        full = np.flatnonzero(np.diff(edge) >= self.most)
        self.low[full] = np.maximum(self.low[full], raw[order][edge[full] + self.most - 1])
        self.held = [table.filter(pa.array(raw >= self.low[q]))]
        self.size = self.held[0].num_rows

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is held, with ids of queries, and then nothing is held."""
        if self.size:
            table = pa.concat_tables(self.held).combine_chunks()
            yield from table.set_column(0, "qid", self.qids.take(table["qid"].combine_chunks())).to_batches(max_chunksize=1 << 16)
        self.held, self.size = [], 0


def _searched(rows: DataFrame, payload: str, queries: DataFrame, prepare: Callable, most: int, per_asset: bool, positive: bool, digits: int | None) -> DataFrame:
    """Candidates (qid, asset_id, vid, raw) among ``rows`` (vid, asset_id, payload): the best of each task, so that few rows are shuffled.

    prepare: from a block of queries as an Arrow table to (ids, scorer), the scorer (sent to the tasks) from a payload column to scores [row, query].  Queries go to the tasks in blocks of about
    ``QUERY_BLOCK``, at any number of them.
    """
    spark, kinds = rows.sparkSession, {f.name: f.dataType for f in [*rows.schema.fields, *queries.schema.fields]}
    schema = StructType([*[StructField(c, kinds[c]) for c in ("qid", "asset_id", "vid")], StructField("raw", DoubleType())])

    def tasks(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, scorer = sent.value
            step = max(1, CELLS // max(len(qids), 1))
            best = _Running(qids, most, per_asset, positive)
            for batch in batches:
                for k in range(0, batch.num_rows, step):
                    part = batch.slice(k, step)
                    scores = scorer(part.column(2))
                    scores = scores if digits is None else np.round(scores, digits)
                    yield from best.add(scores, pa.Table.from_batches([part]))
            best.cut()
            yield from best.rows()

        return run

    number = queries.select("qid").distinct().count()
    blocks = max(1, math.ceil(number / QUERY_BLOCK))
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k).toArrow().combine_chunks()
        if own.num_rows:
            found = rows.select("vid", "asset_id", payload).mapInArrow(tasks(spark.sparkContext.broadcast(prepare(own))), schema)
            out = found if blocks == 1 else out.union(found)
    return out


def _products(asked: np.ndarray, matrix: Matrix, column: pa.Array) -> np.ndarray:
    rows = matrix(column)
    return rows @ asked if rows.size else np.zeros((len(column), asked.shape[1]))


def nearest(vectors: DataFrame, queries: DataFrame, allowed: DataFrame | Column | None = None, most: int = fixed.CANDIDATES, per_asset: bool = True, digits: int | None = 9, matrix: Matrix = dense) -> DataFrame:
    """(qid, asset_id, vid, raw): for every query at least the ``most`` rows of highest dot product, by exact matrix products of parts of batches; filtered vectors are never scored.

    vectors (vid, asset_id, vector), queries (qid, vector), turned into numbers by ``matrix``: ``dense``, or ``hashed`` for lists of word buckets and ``hashed_words`` for lists of words (where
    rows without a common bucket are left out).  per_asset: one row of each asset and task, more where very many are equal.  More rows than asked for come back: ``cut_and_rank`` settles them.
    """
    own = _restricted(vectors, allowed).select("vid", "asset_id", "vector")

    def prepare(block: pa.Table):
        return block["qid"].combine_chunks(), partial(_products, matrix(block["vector"].combine_chunks()).T, matrix)

    return _searched(own, "vector", queries.select("qid", "vector"), prepare, most, per_asset, matrix in (hashed, hashed_words), digits)


def best_per_asset(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """(qid, asset_id, vid, raw): the best row of each asset, the smallest vid of equals; one aggregation, partial before the shuffle."""
    raw = F.col("raw") if digits is None else F.round("raw", digits)
    best = scored.groupBy("qid", "asset_id").agg(F.min(F.struct((-raw).alias("less"), "vid")).alias("b"))
    return best.select("qid", "asset_id", "b.vid", (-F.col("b.less")).alias("raw"))


def cut_and_rank(best: DataFrame, floor: float | None = None, margin: float | None = None, share: float | None = None, most: int = fixed.CANDIDATES) -> DataFrame:
    """Hits (qid, asset_id, vid, raw, rank from 0): the ``most`` best assets that are near enough to the best of their query.

    floor and margin: nothing if the best is below the floor, else those within the margin of the best and not below the floor.  share: those with
    that share of the best.  The best of a query is among its ``most`` best, so the cut looks at these only.
    """
    order = Window.partitionBy("qid").orderBy(F.col("raw").desc(), F.col("vid"), F.col("asset_id"))
    top = best.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most)
    first = F.max("raw").over(Window.partitionBy("qid"))
    top = top.withColumn("__first", first)
    if floor is not None:
        top = top.where((F.col("__first") >= floor) & (F.col("raw") >= F.greatest(F.lit(floor), F.col("__first") - margin)))
    if share is not None:
        top = top.where(F.col("raw") >= share * F.col("__first"))
    return top.select("qid", "asset_id", "vid", "raw", "rank")


def vector_hits(vectors: DataFrame, queries: DataFrame, allowed: DataFrame, floor: float, margin: float) -> DataFrame:
    return cut_and_rank(best_per_asset(nearest(vectors, queries, allowed), 9), floor, margin)


def _bm25_scores(vocabulary: pa.Array, first: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int, mean: float, column: pa.Array) -> np.ndarray:
    """Scores [text, query] of lists of words (or strings of them); term t of the vocabulary is in the queries first[t]:first[t + 1] with these weights."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    column = word_lists(column)
    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = column.flatten().dictionary_encode()
    known = pc.index_in(words.dictionary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    t = known[words.indices.to_numpy()]
    pairs, tf = np.unique((np.repeat(np.arange(len(column)), length) * len(vocabulary) + t)[t >= 0], return_counts=True)
    row, t = np.divmod(pairs, max(len(vocabulary), 1))
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
    many = first[t + 1] - first[t]
    at = np.repeat(first[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.bincount(np.repeat(row, many) * queries + query[at], np.repeat(part, many) * weight[at], len(column) * queries).reshape(len(column), queries)


def _prepared(scores: Callable, mean: float):
    """What ``_searched`` makes of a block of weights (qid, term, weight) for a function of scores."""

    def prepare(block: pa.Table):
        qid, term = (block[c].combine_chunks().dictionary_encode() for c in ("qid", "term"))
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        query, weight = qid.indices.to_numpy()[order].astype(np.int64), block["weight"].to_numpy()[order]
        first = np.searchsorted(term.indices.to_numpy()[order], np.arange(len(term.dictionary) + 1))
        return qid.dictionary, partial(scores, term.dictionary, first, query, weight, len(qid.dictionary), mean)

    return prepare


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, words) of each batch of lists of words: in how many texts a term is; a null term: texts and all their words."""
    for batch in batches:
        column = word_lists(batch.column(0).drop_null())
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = column.flatten().dictionary_encode()
        known = coded.is_valid().to_numpy(zero_copy_only=False)
        owner, term = np.repeat(np.arange(len(column)), lengths)[known], coded.indices.drop_null().to_numpy().astype(np.int64)
        pairs = np.unique(term * len(column) + owner)
        df = np.bincount(pairs // max(len(column), 1), minlength=len(coded.dictionary))
        zeros = np.zeros(len(df), np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(np.append(df, len(column)), pa.int64()), pa.array(np.append(zeros, lengths.sum()), pa.int64())], ["term", "df", "words"])


def bm25_best(texts: DataFrame, terms: DataFrame, allowed: DataFrame | Column | None = None, most: int = fixed.CANDIDATES, per_asset: bool = True, digits: int = 9) -> DataFrame:
    """Candidates (qid, asset_id, vid, raw) by BM25 for many queries at once: at least the ``most`` best of each, rounded so that sums in any order rank alike.

    texts (vid, asset_id, words: terms with repeats, as an array or a string with single spaces), terms (qid, term; repeats count).  One pass counts documents and lengths over all texts, the next scores
    those of allowed assets (a table of asset_id, or a condition on the texts), each batch as a sparse product of its term counts with the weights of the queries.  idf as in ``bm25``.
    """
    asked = terms.groupBy("qid", "term").agg(F.count("*").alias("times"))
    wanted = asked.select(F.col("term").alias("wanted")).union(texts.sparkSession.range(1).select(F.lit(None).cast("string"))).distinct()
    every = texts.select("words").mapInArrow(_word_counts, "term string, df long, words long")
    counts = every.join(wanted, F.col("term").eqNullSafe(F.col("wanted")), "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).persist()
    stats = counts.where("term IS NULL AND df > 0").select(F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl")).first()
    if stats is None:  # no texts
        return texts.join(terms.select("qid"), F.lit(False)).select("qid", "asset_id", "vid", F.lit(0.0).alias("raw"))
    df = counts.where("term IS NOT NULL").select("term", "df")
    idf = F.log((F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select("qid", "term", (F.col("times") * F.when(idf > 0, idf).otherwise(1e-6)).alias("weight"))

    return _searched(_restricted(texts, allowed), "words", weights, _prepared(_bm25_scores, stats.avgdl), most, per_asset, True, digits)


def bm25(postings: DataFrame, lengths: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, asset_id, vid, raw): BM25 of every text with a term of the query; (qid, term) may repeat and then counts so often.

    postings (vid, asset_id, term, tf) and lengths (vid, asset_id, len; asset_id may be left out where no two assets share a vid) cover the whole index, whatever a search is restricted to: so do document counts and
    the mean length.  idf is ln((N - df + 0.5) / (df + 0.5)), and 1e-6 where that is not positive.
    """
    asked = terms.groupBy("qid", "term").agg(F.count("*").alias("times"))
    found = postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # one posting for each text and term
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("qid", "term", (F.col("times") * F.when(idf > 0, idf).otherwise(1e-6)).alias("idf"), "avgdl")
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    text = [c for c in ("vid", "asset_id") if c in lengths.columns]
    return found.drop("len").join(lengths, text).join(weights, "term").groupBy("qid", "asset_id", "vid").agg(F.sum(part).alias("raw"))


def _posted_scores(vocabulary: pa.Array, first: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int, mean: float, column: pa.Array) -> np.ndarray:
    """Scores [text, query] of texts (len, terms, counts); weights as in ``_bm25_scores``."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    length, terms, counts = (pc.struct_field(column, c) for c in ("len", "terms", "counts"))
    row = np.repeat(np.arange(len(column)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    t = pc.index_in(terms.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    tf = counts.flatten().to_numpy(zero_copy_only=False)[t >= 0]
    row, t = row[t >= 0], t[t >= 0]
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length.to_numpy(zero_copy_only=False)[row] / mean))
    many = first[t + 1] - first[t]
    at = np.repeat(first[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.bincount(np.repeat(row, many) * queries + query[at], np.repeat(part, many) * weight[at], len(column) * queries).reshape(len(column), queries)


def bm25_posted(postings: DataFrame, lengths: DataFrame, terms: DataFrame, allowed: DataFrame | None = None, most: int = fixed.CANDIDATES, per_asset: bool = True, digits: int = 9) -> DataFrame:
    """Candidates (qid, asset_id, vid, raw) of ``bm25``: at least the ``most`` best of each query.

    postings (vid, asset_id, term, tf, len).  Only the postings of the queries' terms, in allowed assets, are brought together by text; a task scores its texts against all queries and puts out
    its best, so what is shuffled grows with the postings, not with texts by queries.
    """
    asked = terms.groupBy("qid", "term").agg(F.count("*").alias("times"))
    found = postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).first()
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select("qid", "term", (F.col("times") * F.when(idf > 0, idf).otherwise(1e-6)).alias("weight"))
    own = found if allowed is None else found.join(allowed, "asset_id", "left_semi")
    texts = own.groupBy("vid", "asset_id").agg(F.max("len").alias("len"), F.collect_list(F.struct("term", "tf")).alias("p"))
    texts = texts.select("vid", "asset_id", F.struct(F.col("len").cast("long").alias("len"), F.col("p.term").alias("terms"), F.col("p.tf").cast("array<long>").alias("counts")).alias("posted"))
    return _searched(texts, "posted", weights, _prepared(_posted_scores, stats.avgdl), most, per_asset, True, digits)


def keyword_hits(scored: DataFrame, allowed: DataFrame, first_rows: int | None = None, digits: int = 9) -> DataFrame:
    """Hits of BM25 scores, rounded so that sums in any order rank alike.

    first_rows: keep only so many best texts of a query before the filter (600 for the original behaviour, which can lose all
    hits of a filtered search); None: filter first.
    """
    if first_rows is not None:
        order = Window.partitionBy("qid").orderBy(F.round("raw", digits).desc(), F.col("vid"), F.col("asset_id"))
        scored = scored.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= first_rows).drop("__r")
    return keyword_cut(scored.join(allowed, "asset_id", "left_semi"), digits)


def keyword_cut(scored: DataFrame, digits: int = 9) -> DataFrame:
    """Hits: the best text of each asset, those with half the score of the best."""
    return cut_and_rank(best_per_asset(scored, digits), share=fixed.KEYWORD_SHARE)


def confidence(signal: str, raw: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Absolute strength from 0 to 1: keyword scores up to 0.8, similarities between their bounds."""
    if signal == "kw":
        return F.least(F.lit(1.0), raw / 12.0) * 0.8
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - low) / (high - low)))


def fuse(hits: dict[str, DataFrame], bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(qid, asset_id, score, confidence, best_signal, clip, text, kw): weighted reciprocal ranks of the signals, the best in full and the others by a part.

    clip, text, kw: (vid, raw, rank, contribution) of each signal, null where it has no hit.  Equal contributions: the earlier signal.
    """
    parts = []
    for name in fixed.SIGNALS:
        if name in hits:
            low, high = (bounds or {}).get(name, (0.0, 1.0))
            share = F.lit(fixed.WEIGHTS[name]) / (fixed.RRF_K + F.col("rank") + 1)
            parts.append(hits[name].select("qid", "asset_id", F.lit(name).alias("s"), F.struct("vid", "raw", "rank", share.alias("share"), confidence(name, F.col("raw"), low, high).alias("conf")).alias("h")))
    every = reduce(DataFrame.unionByName, parts)
    own = every.groupBy("qid", "asset_id").agg(*[F.max(F.when(F.col("s") == n, F.col("h"))).alias(n) for n in fixed.SIGNALS])
    shares = [F.coalesce(F.col(f"{n}.share"), F.lit(0.0)) for n in fixed.SIGNALS]
    top, total = F.greatest(*shares), reduce(lambda a, b: a + b, shares)
    best = reduce(lambda rest, k: F.when(shares[k] == top, fixed.SIGNALS[k]).otherwise(rest), reversed(range(3)), F.lit(None).cast("string"))
    sure = F.greatest(*[F.col(f"{n}.conf") for n in fixed.SIGNALS], F.lit(0.0))
    return own.select("qid", "asset_id", (top + fixed.SECONDARY * (total - top)).alias("score"), sure.alias("confidence"), best.alias("best_signal"), *fixed.SIGNALS)


def boost_intent(fused: DataFrame, assets: DataFrame, intents: DataFrame | None) -> DataFrame:
    """With type; scores of the types that a query points to are raised.  intents (qid, intents); None: explicit types were asked for."""
    typed = fused.join(assets.select("asset_id", "type"), "asset_id", "left")
    if intents is None:
        return typed
    typed = typed.join(intents.select("qid", "intents"), "qid", "left")
    wanted = F.coalesce(F.array_contains("intents", F.col("type")), F.lit(False))
    return typed.withColumn("score", F.when(wanted, F.col("score") * fixed.INTENT_BOOST).otherwise(F.col("score"))).drop("intents")


def ranked(fused: DataFrame, digits: int = 12) -> DataFrame:
    """With place (from 0) and relative score.  Equal scores: clip hits in their order, then text hits, then keyword hits, then asset_id."""
    first = [F.coalesce(F.when(F.col(n).isNotNull(), k * 1000 + F.col(f"{n}.rank")), F.lit(9999)) for k, n in enumerate(fixed.SIGNALS)]
    order = Window.partitionBy("qid").orderBy(F.round("score", digits).desc(), F.least(*first), F.col("asset_id"))
    top = F.max("score").over(Window.partitionBy("qid"))
    return fused.withColumn("place", F.row_number().over(order) - 1).withColumn("relative", F.col("score") / top)


def page(rows: DataFrame, limit: int = 24, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be from 1 to 100 and offset 0 or more")
    return rows.where((F.col("place") >= offset) & (F.col("place") < offset + limit))


def facets(fused: DataFrame) -> DataFrame:
    """(qid, type, n) over all results, before paging."""
    return fused.groupBy("qid", "type").agg(F.count("*").alias("n"))


def signal_sizes(hits: dict[str, DataFrame]) -> DataFrame:
    """(qid, signal, n); a signal that did not run has no rows."""
    return reduce(DataFrame.unionByName, [h.groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.lit(s).alias("signal"), "n") for s, h in hits.items()])


def raw_tops(scored: dict[str, DataFrame]) -> DataFrame:
    """(qid, signal, top): the highest similarity of each signal, without floor or filter."""
    return reduce(DataFrame.unionByName, [s.groupBy("qid").agg(F.max("raw").alias("top")).select("qid", F.lit(n).alias("signal"), "top") for n, s in scored.items()])
