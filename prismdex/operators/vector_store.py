"""Vectors packed in blocks, with exact pruning.

A block holds up to ``BLOCK`` neighbouring vectors as one matrix, with its centre c and radius r.  By the triangle inequality no vector v of it has
q . v > q . c + |q| r, so a block whose bound is below the score that a query has already reached for as many assets as it asks for cannot change its result and is not read.

Centres of cells are fitted on a bounded sample (``SAMPLE`` vectors of least hashes, ``CELLS`` centres); every vector is stored.  A cell of very many vectors is cut into
blocks by signs of projections, over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from prismdex.functions import fixed
from prismdex.operators import retrieval
from prismdex.sources import scratch

BLOCK, CELLS, SAMPLE, ROUNDS, SIGNS = 256, 256, 4096, 5, 12
#: Bounds are compared with this much room for rounding.
ROOM = 1e-8


def _centres(points: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the points by a few rounds of nearest means, from the first points."""
    centres = points[:cells].copy()
    for _ in range(ROUNDS):
        own = np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, 1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class VectorStore:
    """A store at ``path``: a table of blocks (block, n, vids, asset_ids, matrix, wide, centre, radius); wide: of doubles, not floats."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.blocks = spark.read.parquet(path)

    @classmethod
    def opened(cls, vectors: DataFrame, root: str, signature: str, block: int = BLOCK) -> VectorStore:
        """The store of the vectors (vid, asset_id, vector) under ``root``: the one there is for this signature, without a look at the vectors, or else a new one.

        signature: what the vectors depend on, as a name of a folder (a version and a pipeline).  Null vectors are left out, all others must have one length; no vectors make an empty store.
        """
        spark, path = vectors.sparkSession, f"{root.rstrip('/')}/{signature}"
        files, place = scratch.file_system(spark, f"{path}/_SUCCESS")
        if not files.exists(place):
            build(vectors.where("vector IS NOT NULL"), block).write.mode("overwrite").parquet(path)
        return cls(spark, path)

    def _bounds(self, sent, blocks: DataFrame, least: int | None):
        """(q, block, n, upper) of queries (by number) and blocks: those whose bound reaches the query's score or, with ``least``, of each batch the best blocks with that many rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, reached = sent.value
            length = np.linalg.norm(asked, axis=0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                n = batch.column(1).to_numpy()
                upper = retrieval.dense(batch.column(2)) @ asked + batch.column(3).to_numpy()[:, None] * length
                if least is None:
                    keep = upper >= reached - ROOM
                else:
                    order = np.argsort(-upper, 0, kind="stable")
                    before = np.cumsum(n[order], 0) - n[order]
                    keep = np.zeros(upper.shape, bool)
                    np.put_along_axis(keep, order, before < least, 0)
                row, q = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), batch.column(0).take(pa.array(row)), pa.array(n[row]), pa.array(upper[row, q])], ["q", "block", "n", "upper"])

        return blocks.select("block", "n", "centre", "radius").mapInArrow(run, "q int, block long, n int, upper double")

    def _scored(self, sent, pairs: DataFrame, places: DataFrame | None, qids: pa.Array, schema: StructType, most: int, per_asset: bool, digits: int | None) -> DataFrame:
        """Candidates of the pairs (q, block): a block is read once for all of its queries."""
        wanted = pairs.groupBy("block").agg(F.collect_list("q").alias("qs"))  # a block of queries at most
        rows = self.blocks.join(wanted, "block")
        rows = rows.join(places, "block") if places is not None else rows.withColumn("places", F.lit(None).cast("array<int>"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, _ = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    own = batch.slice(k, 1)
                    q = own.column("qs")[0].values.to_numpy()
                    table = pa.table({"vid": own.column("vids")[0].values, "asset_id": own.column("asset_ids")[0].values})
                    matrix = np.frombuffer(own.column("matrix")[0].as_py(), np.float64 if own.column("wide")[0].as_py() else np.float32).reshape(table.num_rows, -1).astype(np.float64)
                    if own.column("places").null_count == 0:
                        at = own.column("places")[0].values.to_numpy()
                        table, matrix = table.take(pa.array(at)), matrix[at]
                    scores = matrix @ asked[:, q]
                    scores = scores if digits is None else np.round(scores, digits)
                    yield from retrieval._best(scores, table, qids.take(pa.array(q)), most, per_asset, False).combine_chunks().to_batches()

        return rows.select("qs", "vids", "asset_ids", "matrix", "wide", "places").mapInArrow(run, schema)

    def nearest(self, queries: DataFrame, allowed: DataFrame | None = None, most: int = fixed.CANDIDATES, per_asset: bool = True, digits: int | None = 9) -> tuple[DataFrame, DataFrame]:
        """(candidates, reads) of queries (qid, vector).

        candidates (qid, asset_id, vid, raw): as of ``retrieval.nearest``, so ``cut_and_rank`` settles the ``most`` best of each query.  reads (qid, blocks, read): blocks that the query could have looked at, and
        those it read.  allowed (asset_id): others are not scored, and blocks without an allowed asset not looked at.  First each query reads the blocks of highest bounds
        that hold twice as many rows as it asks for; the score reached then decides about all others.
        """
        spark, blocks, places = self.spark, self.blocks, None
        if allowed is not None:
            own = blocks.select("block", F.posexplode("asset_ids").alias("place", "asset_id")).join(allowed, "asset_id", "left_semi")
            places = scratch.written(own.groupBy("block").agg(F.array_sort(F.collect_list("place")).alias("places")), "places")
            blocks = blocks.drop("n").join(places.select("block", F.size("places").alias("n")), "block")
        kinds = {"qid": queries.schema["qid"].dataType, "asset_id": self.blocks.schema["asset_ids"].dataType.elementType, "vid": self.blocks.schema["vids"].dataType.elementType}
        schema = StructType([*[StructField(c, t) for c, t in kinds.items()], StructField("raw", DoubleType())])
        total, found, reads = blocks.count(), [spark.createDataFrame([], schema)], [spark.createDataFrame([], StructType([schema["qid"]]).add("blocks", "long").add("read", "long"))]
        number = queries.select("qid").distinct().count()
        parts = max(1, -(-number // retrieval.QUERY_BLOCK))
        for k in range(parts if total else 0):
            block = queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == k).select("qid", "vector").toArrow().combine_chunks()
            if not block.num_rows:
                continue
            qids, asked = block["qid"].combine_chunks(), retrieval.dense(block["vector"].combine_chunks()).T
            reached = np.full(len(qids), -np.inf)
            names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(qids), dtype=np.int32)), "qid": qids}))
            sent = spark.sparkContext.broadcast((asked, reached))
            first = self._bounds(sent, blocks, 2 * most)
            first = first.withColumn("before", F.coalesce(F.expr("sum(n) OVER (PARTITION BY q ORDER BY upper DESC, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))).where(F.col("before") < 2 * most)
            first = scratch.written(first.select("q", "block"), "pairs")
            near = scratch.written(self._scored(sent, first, places, qids, schema, most, per_asset, digits), "near")
            best = retrieval.best_per_asset(near) if per_asset else near
            low = best.withColumn("r", F.expr("row_number() OVER (PARTITION BY qid ORDER BY raw DESC)")).where(F.col("r") == most).join(names, "qid").select("q", "raw").toArrow()
            reached[low["q"].to_numpy()] = low["raw"].to_numpy()
            sent = spark.sparkContext.broadcast((asked, reached))
            rest = scratch.written(self._bounds(sent, blocks, None).select("q", "block").join(first, ["q", "block"], "left_anti"), "pairs")
            found += [near, self._scored(sent, rest, places, qids, schema, most, per_asset, digits)]
            reads.append(first.union(rest).groupBy("q").agg(F.count("*").alias("read")).join(names, "q").select("qid", F.lit(total).cast("long").alias("blocks"), "read"))
        return reduce(DataFrame.union, found), reduce(DataFrame.union, reads)


def build(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of vectors (vid, asset_id, vector)."""
    spark = vectors.sparkSession
    rows = vectors.select("vid", "asset_id", "vector")
    sample = retrieval.dense(rows.orderBy(F.xxhash64("vid", "asset_id"), "vid", "asset_id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks())
    wide = rows.schema["vector"].dataType.elementType == DoubleType()
    n = rows.count()
    centres = _centres(sample, min(CELLS, max(1, -(-n // block)))) if len(sample) else np.zeros((1, 1))
    signs = np.random.default_rng(17).normal(size=(centres.shape[1], SIGNS))
    sent = spark.sparkContext.broadcast((centres, signs))
    keys = StructType([StructField("cell", IntegerType()), StructField("code", IntegerType()), *rows.schema.fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, signs = sent.value
        for batch in batches:
            if batch.num_rows:
                v = retrieval.dense(batch.column(2))
                cell = np.argmin((centres * centres).sum(1) - 2 * v @ centres.T, 1)
                code = ((v - centres[cell]) @ signs > 0) @ (1 << np.arange(SIGNS)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(code.astype(np.int32)), *batch.columns], ["cell", "code", *batch.schema.names])

    kinds = {k: rows.schema[c].dataType.simpleString() for k, c in (("vids", "vid"), ("asset_ids", "asset_id"))}
    schema = StructType.fromDDL(f"block long, n int, vids array<{kinds['vids']}>, asset_ids array<{kinds['asset_ids']}>, matrix binary, wide boolean, centre array<double>, radius double")
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, TaskContext.get().partitionId() << 32

        def packed(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            v = retrieval.dense(part["vector"].combine_chunks())
            centre = v.mean(0)
            radius = float(np.sqrt(((v - centre) ** 2).sum(1).max())) * (1 + 1e-12)
            number += 1
            return pa.RecordBatch.from_pydict({"block": [number - 1], "n": [len(v)], "vids": [part["vid"].combine_chunks()], "asset_ids": [part["asset_id"].combine_chunks()], "matrix": [(v if wide else v.astype(np.float32)).tobytes()], "wide": [wide], "centre": [centre], "radius": [radius]}, arrow)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            cell = rows["cell"].to_numpy()
            at = 0
            while at < len(cell):
                same = int(np.searchsorted(cell[at:], cell[at], "right"))
                if same < block and at + same == len(cell):  # the block may go on
                    break
                yield packed(rows.slice(at, min(same, block)))
                at += min(same, block)
            held = rows.slice(at)
        if held is not None and held.num_rows:
            yield packed(held)

    placed = rows.mapInArrow(place, keys)
    order = ["cell", "code", "vid", "asset_id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, schema)
