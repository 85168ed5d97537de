"""An inverted index in segments: postings bucketed by term with bounds of each block, exact best texts by MaxScore, counts that follow additions and withdrawals.

A segment is a run of texts with its own numbers (places); its postings of a term are cut into blocks of ``BLOCK`` that carry their largest term count and their
smallest text length, from which the largest score of the block follows at any mean length.  A search reads the blocks of its terms only.  Within a segment the terms of
a query are taken by falling bounds; once as many assets as are asked for have a score that the bounds of what is left cannot reach, only texts
that have a score already are scored on, and blocks without such a text are left out.

Texts are withdrawn by place, and what they had counted is kept as counts to take off, so document counts and mean lengths are those of an index built anew.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from prismdex.functions import fixed
from prismdex.functions.chunks import word_lists
from prismdex.operators import retrieval

#: Texts and words of a segment, postings of a block, buckets of terms.
TEXTS, WORDS, BLOCK, BUCKETS = 1 << 14, 1 << 20, 128, 16
#: Scores are compared with bounds with this much room for rounding.
ROOM = 1e-8


def index_schema(vid: str = "string", asset_id: str = "string") -> StructType:
    """Rows of an index: one a segment for its texts (term null), and one for each block of postings."""
    return StructType.fromDDL(f"bucket int, segment long, term string, n int, words long, top int, least int, places binary, counts binary, lengths binary, vids array<{vid}>, asset_ids array<{asset_id}>")


def _kinds(texts: DataFrame) -> tuple[str, str]:
    return texts.schema["vid"].dataType.simpleString(), texts.schema["asset_id"].dataType.simpleString()


def _inverted(vids: pa.Array, assets: pa.Array, words: pa.ListArray, segment: int, schema: pa.Schema) -> pa.Table:
    """The rows of a segment, as columns: postings in order of term and place are one buffer that the blocks share."""
    lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    term, place = np.divmod(pairs, max(len(lengths), 1))
    edge = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
    many = -(-np.diff(edge) // BLOCK)  # blocks of each term
    of = np.repeat(np.arange(len(many)), many)
    first = edge[of] + BLOCK * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))

    def packed(values: np.ndarray) -> pa.Array:
        offsets = 4 * np.append(first, len(values))
        return pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.astype(np.int32))])

    blocks = {"segment": np.full(len(of), segment), "term": coded.dictionary.take(pa.array(of)), "n": np.diff(np.append(first, len(pairs))), "places": packed(place), "counts": packed(counts)}
    blocks |= {"top": np.maximum.reduceat(counts, first), "least": np.minimum.reduceat(lengths[place], first)} if len(of) else {"top": [], "least": []}
    head = {"segment": [segment], "n": [len(lengths)], "words": [int(lengths.sum())], "lengths": [lengths.astype(np.int32).tobytes()], "vids": _one_list(vids), "asset_ids": _one_list(assets)}
    columns = lambda found, n: pa.table([found[f.name] if f.name in found else pa.nulls(n, f.type) for f in schema], names=schema.names).cast(schema)
    return pa.concat_tables([columns(head, 1), columns(blocks, len(of))])


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def built(texts: DataFrame, run: int = 0, most_texts: int = TEXTS) -> DataFrame:
    """Index rows of texts (vid, asset_id, words: terms with repeats, as an array or a string with single spaces), in segments of a task's texts; run: a number that no other rows of the index have.

    A row with null words is no text; a very long text is a segment of its own.  Rows stay in the task of their segment, sorted by bucket of the term and term: dealing them by
    ranges would make the index twice, once to find the ranges.
    """
    schema = index_schema(*_kinds(texts))
    names = [f for f in schema.names if f != "bucket"]
    out = to_arrow_schema(StructType([schema[c] for c in names]))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = (run << 40) | (TaskContext.get().partitionId() << 20), []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            table = pa.Table.from_batches(held).combine_chunks()
            words = table["words"].combine_chunks()
            words = pa.array(words.to_pylist(), words.type) if words.offset else words
            rows = _inverted(table["vid"].combine_chunks(), table["asset_id"].combine_chunks(), words, number, out)
            number, held = number + 1, []
            del table, words
            yield from rows.to_batches(max_chunksize=4096)
            del rows
            pa.default_memory_pool().release_unused()  # a worker goes on to other tasks and would keep it

        size = 0
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())  # here, as a filter of the table would make the words a second time
            batch = batch.set_column(2, "words", word_lists(batch.column(2)))
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                room = most_texts - sum(b.num_rows for b in held)
                upto = at + min(room, max(1, int(np.searchsorted(np.cumsum(lengths[at:]), WORDS - size, "right"))))
                held.append(batch.slice(at, upto - at))
                size += int(lengths[at:upto].sum())
                at = upto
                if size >= WORDS or sum(b.num_rows for b in held) >= most_texts or at < batch.num_rows:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    rows = texts.select("vid", "asset_id", "words").mapInArrow(run_, StructType([schema[c] for c in names]))
    rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise((F.crc32("term") % BUCKETS).cast("int"))).select(*schema.names)
    return rows.sortWithinPartitions("bucket", "term", "segment")


def withdrawn(index: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, counts) of texts to be withdrawn (vid, asset_id, words): (segment, place, length) and (term, n)."""
    own = index.where("term IS NULL").select("segment", F.posexplode(F.arrays_zip("vids", "asset_ids")).alias("place", "x")).select("segment", "place", F.col("x.vids").alias("vid"), F.col("x.asset_ids").alias("asset_id"))
    places = own.join(gone.where("words IS NOT NULL").select("vid", "asset_id", F.size("words").cast("long").alias("length")), ["vid", "asset_id"]).select("segment", "place", "length")
    return places, gone.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def impact(count, length, mean: float):
    """The part of a score that a term's count in a text makes; it grows with the count and falls with the length."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return count * (k1 + 1) / (count + k1 * (1 - b + b * length / mean))


class Postings:
    """Blocks of one term in a segment, in order of place."""

    def __init__(self, rows: list[tuple]) -> None:
        self.top, self.least = (np.array([r[k] for r in rows]) for k in (0, 1))
        self.places, self.counts = (np.concatenate([np.frombuffer(r[k], np.int32) for r in rows]) for k in (2, 3))
        self.edges = np.cumsum([0, *[len(r[2]) // 4 for r in rows]])
        self.known: tuple | None = None

    def bounds(self, mean: float) -> np.ndarray:
        return impact(self.top, self.least, mean)

    def impacts(self, lengths: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
        """(bounds of the blocks, impacts of the postings), made once for all queries of a segment."""
        if self.known is None or self.known[0] is not lengths or self.known[1] != mean:
            self.known = lengths, mean, self.bounds(mean), impact(self.counts, lengths[self.places], mean)
        return self.known[2:]


def _low(scores: np.ndarray, assets: np.ndarray, most: int) -> float:
    """The ``most``-th best score of an asset; 0 if fewer have one."""
    some = np.flatnonzero(scores > 0)
    own, values = assets[some], scores[some]
    if len(own) > 1 and not (own[1:] > own[:-1]).all():
        order = np.argsort(own, kind="stable")
        own, values = own[order], values[order]
        values = np.maximum.reduceat(values, np.flatnonzero(np.append(True, own[1:] != own[:-1])))
    return np.partition(values, len(values) - most)[len(values) - most] if len(values) >= most else 0.0


def best_texts(terms: list[tuple[float, Postings]], lengths: np.ndarray, assets: np.ndarray, live: np.ndarray | None, mean: float, most: int) -> tuple[np.ndarray, int]:
    """(scores, blocks read): scores of the texts of a segment for one query; those below the ``most``-th best asset may be too low, all others are exact.

    terms: (weight, postings); assets: the asset of each text as a number; live: which texts count (None: all).
    """
    impacts = [p.impacts(lengths, mean) for _, p in terms]
    bounds = [w * own for (w, _), (own, _) in zip(terms, impacts, strict=True)]
    order = sorted(range(len(terms)), key=lambda k: -bounds[k].max())
    rest = np.append(np.cumsum([bounds[k].max() for k in order][::-1])[::-1], 0.0)  # of this term and all after it
    scores, low, read = np.zeros(len(lengths)), -np.inf, 0
    for step, k in enumerate(order):
        weight, postings = terms[k]
        places, parts = postings.places, impacts[k][1]
        only = scores + rest[step] >= low - ROOM if rest[step] < low - ROOM else None  # texts that can still matter
        if only is not None:
            only &= scores > 0
            if not only.any():
                break
            own = only[places]
            read += int(np.count_nonzero(np.add.reduceat(own, postings.edges[:-1], dtype=np.int64)))
            places, parts = places[own], parts[own]
        else:
            weak = bounds[k] + rest[step + 1] < low - ROOM
            if weak.any():  # blocks that matter only to texts that have a score already
                weak &= np.add.reduceat(scores[places] > 0, postings.edges[:-1], dtype=np.int64) == 0
                own = np.repeat(~weak, np.diff(postings.edges))
                places, parts = places[own], parts[own]
            read += len(weak) - int(np.count_nonzero(weak))
        scores[places] += weight * parts
        if live is not None:
            scores[~live] = 0
        if step + 1 < len(order) and bounds[order[step + 1]].min() + rest[step + 2] < scores.max(initial=0.0):  # else no bound leaves anything out next
            reached = _low(scores, assets, most)
            low = reached if reached > 0 else low
    return scores, read


def search(index: DataFrame, terms: DataFrame, allowed: DataFrame | None = None, places: DataFrame | None = None, counts: DataFrame | None = None, most: int = fixed.CANDIDATES, per_asset: bool = True, digits: int = 9) -> DataFrame:
    """Candidates (qid, asset_id, vid, raw) by BM25: at least the ``most`` best assets (or texts) of each query; ``retrieval.keyword_cut`` settles them.

    terms (qid, term; repeats count); allowed (asset_id): others are not scored, but counted; places and counts: what was withdrawn, as ``withdrawn`` gives it.
    Only blocks of the terms are read.  A segment is scored in one task, of bounded size; queries go to the tasks in blocks.
    """
    spark = index.sparkSession
    vid, asset = index.schema["vids"].dataType.elementType, index.schema["asset_ids"].dataType.elementType
    schema = StructType([terms.schema["qid"], StructField("asset_id", asset), StructField("vid", vid), StructField("raw", DoubleType())])
    own = index.where("term IS NULL")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    taken = places.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first() if places is not None else None
    n, words = total.n - (taken.n if taken else 0), total.words - (taken.words if taken else 0)
    if n <= 0:
        return spark.createDataFrame([], schema)
    mean = words / n or 1.0
    live = None
    if allowed is not None or places is not None:
        live = own.select("segment", F.posexplode("asset_ids").alias("place", "asset_id"))
        live = live.join(places.select("segment", "place"), ["segment", "place"], "left_anti") if places is not None else live
        live = live.join(allowed.select("asset_id"), "asset_id", "left_semi") if allowed is not None else live
        live = live.groupBy("segment").agg(F.collect_list("place").alias("live"))
    texts = own.select("segment", "lengths", "vids", "asset_ids")
    texts = texts.join(live, "segment") if live is not None else texts.withColumn("live", F.lit(None).cast("array<int>"))
    texts = texts.withColumnRenamed("segment", "of")
    asked = terms.groupBy("qid", "term").agg(F.count("*").alias("times"))
    number = terms.select("qid").distinct().count()
    parts, out = max(1, -(-number // retrieval.QUERY_BLOCK)), [spark.createDataFrame([], schema)]
    for k in range(parts):
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == k).toArrow()  # the terms of a block of queries
        wanted = sorted(set(block["term"].to_pylist()))
        if not wanted:
            continue
        here = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string"))
        found = index.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in wanted}))).join(here, "term", "left_semi")
        df = found.select("term", F.col("n").cast("long").alias("n"))
        df = df.union(counts.join(here, "term", "left_semi").select("term", -F.col("n"))) if counts is not None else df
        known = df.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
        idf = {t: math.log((n - m + 0.5) / (m + 0.5)) for t, m in zip(known["term"].to_pylist(), known["n"].to_pylist(), strict=True)}
        by_query: dict = {}
        for q, t, times in zip(*[block[c].to_pylist() for c in ("qid", "term", "times")], strict=True):
            if t in idf:
                by_query.setdefault(q, []).append((t, times * (idf[t] if idf[t] > 0 else 1e-6)))
        sent = spark.sparkContext.broadcast((pa.array(list(by_query), to_arrow_schema(schema).field(0).type), list(by_query.values())))
        columns = found.select("segment", "term", "top", "least", "places", "counts")
        out.append(columns.groupBy("segment").cogroup(texts.groupBy("of")).applyInArrow(_segment(sent, mean, most, per_asset, digits, to_arrow_schema(schema)), schema))
    return reduce(DataFrame.union, out)


def _segment(sent, mean: float, most: int, per_asset: bool, digits: int, schema: pa.Schema):
    def run(blocks: pa.Table, texts: pa.Table) -> pa.Table:
        if not blocks.num_rows or not texts.num_rows:
            return schema.empty_table()
        qids, queries = sent.value
        rows: dict[str, list] = {}
        for t, *row in zip(*[blocks[c].to_pylist() for c in ("term", "top", "least", "places", "counts")], strict=True):
            rows.setdefault(t, []).append(row)
        postings = {t: Postings(r) for t, r in rows.items()}
        lengths = np.frombuffer(texts["lengths"][0].as_py(), np.int32)
        table = pa.table({"vid": texts["vids"].combine_chunks()[0].values, "asset_id": texts["asset_ids"].combine_chunks()[0].values})
        assets = table["asset_id"].combine_chunks().dictionary_encode().indices.to_numpy() if per_asset else np.arange(len(lengths))
        live = None
        if texts["live"].null_count == 0:
            live = np.zeros(len(lengths), bool)
            live[texts["live"].combine_chunks()[0].values.to_numpy()] = True
        out = []
        for k, words in enumerate(queries):
            own = [(w, postings[t]) for t, w in words if t in postings]
            if own:
                scores, _ = best_texts(own, lengths, assets, live, mean, most)
                some = np.flatnonzero(scores > 0)
                if len(some):
                    out.append(retrieval._best(np.round(scores[some], digits)[:, None], table.take(pa.array(some)), qids.slice(k, 1), most, per_asset, True))
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return run
