"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_left: WeakKeyDictionary[SparkSession, set[str]] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir; a new one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-prismdex-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, removed when Python ends."""
    path = f"{shared_folder(spark)}/prismdex/{name}-{uuid.uuid4().hex}"
    _left.setdefault(spark, set()).add(path)
    return path


def kept(df: DataFrame, path: str) -> DataFrame:
    """The rows as a Parquet table at the path, read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table at a new path, read back: its size is known then, and a lost executor does not cost its making again."""
    return kept(df, new_path(df.sparkSession, name))


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Jobs that run inside hand rows to Python in Arrow batches of about ``most`` bytes: batches of 10,000 long texts would grow with the rows of a task up to 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_by_bytes(df: DataFrame, name: str) -> DataFrame:
    """``written``, with small batches for the Python steps of its job."""
    with small_batches(df.sparkSession):
        return written(df, name)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)
    _left.get(spark, set()).discard(path)


@atexit.register
def _at_end() -> None:
    for spark in list(_left):
        if spark.sparkContext._jsc is not None:  # not stopped
            for path in list(_left[spark]):
                remove(spark, path)
