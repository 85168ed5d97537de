"""Indexing as a stream: each arriving listing is one run of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismdex.plans.engine import Engine
from prismdex.schemas import LISTING


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings that arrive as Parquet files in a folder, one file a listing and micro-batch."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(folder)


def index_stream(stream: DataFrame, engine: Engine, checkpoint: str, **options) -> StreamingQuery:
    """Applies what has arrived and ends; a batch that is given again after a failure only finds unchanged files.

    The stream is one of whole listings (``listings``), or of changed files (``sources.listing.arrivals``) with ``complete=False``.
    """

    def run(batch: DataFrame, _: int) -> None:
        if options.get("complete", True) or not batch.persist().isEmpty():  # without arrivals there is nothing to do
            engine.apply(batch.persist(), **options)
        batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_counts(changes: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of file states by event-time window from a stream of changes (ts, state); rows later than ``late`` are left out."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "state").agg(F.count("*").alias("n")).select("window.start", "window.end", "state", "n")
