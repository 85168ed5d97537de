"""Reading the input tables and cutting lineage through a table in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that each session has written and not removed.
_left: WeakKeyDictionary[SparkSession, set[str]] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def boxed(df: DataFrame, **beside: Column) -> DataFrame:
    """The rows as one struct column ``row`` beside columns made from them: no name of theirs can clash with one of a plan."""
    return df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in beside.items()])


def unboxed(df: DataFrame) -> DataFrame:
    """The rows that ``boxed`` took, with their columns."""
    return df.select("row.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset and the master is local (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-prismdex-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, removed by ``clean_up`` or when Python ends."""
    path = f"{shared_folder(spark)}/prismdex/{name}-{uuid.uuid4().hex}"
    _left.setdefault(spark, set()).add(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: a later loss of executors doesn't recompute them.  options: of the writer."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Jobs that run inside hand texts to Python in Arrow batches of about ``most`` bytes instead of 10,000 rows, which executor and worker would both hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _left.get(spark, set()).discard(path)


def release(*tables: DataFrame) -> None:
    """Removes written tables that no later step reads."""
    for df in tables:
        _remove(df.sparkSession, df._written_to)


def clean_up(spark: SparkSession) -> None:
    """Removes every table that the operators of this session have left: call it when their results have been used, as results read from them."""
    for path in list(_left.get(spark, ())):
        _remove(spark, path)


@atexit.register
def _at_end() -> None:
    for spark in list(_left):
        if spark.sparkContext._jsc is not None:  # not stopped
            clean_up(spark)
