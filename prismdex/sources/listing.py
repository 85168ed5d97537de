"""Listing of a media folder in rounds that deal folders over all tasks, as a batch or a streaming data source too, and the reading and hashing of its files.

Spark's own binary source leaves out empty files and names with a leading underscore, which a catalogue must report.  The folder has to be
mounted on driver and executors.
"""

from __future__ import annotations

import hashlib
import os
import stat
import time
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prismdex.functions.fixed import IGNORED_NAMES
from prismdex.schemas import LISTING
from prismdex.sources import scratch

PART = 1 << 20
#: Entries that a task reads before it gives its other folders back; names of a row; subtrees for each task of a data source's plan.
SHARE, NAMES, SUBTREES = 20_000, 1_000, 4
#: Seconds for which a change must be past before a stream reports it.
SETTLED = 2.0
LISTED = "folder string, names array<string>, open boolean"


def _shown(name: str) -> bool:
    return not name.startswith(".") and name.lower() not in IGNORED_NAMES


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what is shown in a folder; one that has vanished or can't be read has nothing."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                is_folder = e.is_dir(follow_symlinks=False)
                if (not e.name.startswith(".")) if is_folder else _shown(e.name):
                    yield e.name, is_folder
    except OSError:
        return


def _facts(folder: str, name: str) -> tuple | None:
    """A row of the listing and its change time; None for what is no regular file or has vanished."""
    path = os.path.join(folder, name)
    try:
        found = os.stat(path)
    except OSError:
        return None
    return (path, folder, name, os.path.splitext(name)[1].lower(), found.st_size, found.st_mtime_ns, found.st_ctime_ns) if stat.S_ISREG(found.st_mode) else None


def _folder(root: str) -> str:
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    return root


# ------------------------------------------------------------------ in rounds
def _walked(share: int):
    """A task of a round: walks its folders until it has read its share of entries; names come in rows of a folder, folders that are left as open rows."""
    schema = to_arrow_schema(StructType.fromDDL(LISTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0
        for batch in batches:
            left = batch.column(0).to_pylist()[::-1]
            while left and read < share:
                folder, names = left.pop(), []
                for name, is_folder in _entries(folder):
                    read += 1
                    if is_folder:
                        left.append(os.path.join(folder, name))
                        continue
                    names.append(name)
                    if len(names) == NAMES:
                        yield pa.RecordBatch.from_pylist([{"folder": folder, "names": names, "open": False}], schema)
                        names = []
                if names:
                    yield pa.RecordBatch.from_pylist([{"folder": folder, "names": names, "open": False}], schema)
            for k in range(0, len(left), NAMES):
                yield pa.RecordBatch.from_pylist([{"folder": f, "names": None, "open": True} for f in left[k : k + NAMES]], schema)

    return run


def _looked_at():
    schema = to_arrow_schema(StructType.fromDDL(LISTING))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [row[:-1] for name in names if (row := _facts(folder, name))]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in found], schema)

    return run


def listing(spark: SparkSession, root: str, share: int = SHARE) -> DataFrame:
    """Regular files below a folder, hidden and ignored names left out, in no order; what vanishes meanwhile is left out, a root that is no folder is an error.

    A round deals the open folders over all tasks; each walks down until it has read ``share`` entries and gives back what is left, so a deep or uneven tree
    costs few rounds and no task more than its share and one folder.  Files are looked at after that, in rows of 1,000 names, by all tasks: one flat folder is read
    by one task, but not looked at by one.  Folders of a link are not followed.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    open_, rounds = spark.createDataFrame([(_folder(root),)], "folder string"), []
    while not rounds or not open_.isEmpty():
        many = tasks if rounds else 1
        rounds.append(scratch.written(open_.repartition(many).mapInArrow(_walked(share), LISTED), "folders"))
        open_ = rounds[-1].where("open").select("folder")
    named = reduce(DataFrame.union, [r.where("NOT open").select("folder", "names") for r in rounds])
    return named.repartition(tasks).mapInArrow(_looked_at(), LISTING)


# ------------------------------------------------------------------ as a data source
class MediaListing(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("media_listing").load(folder)``.

    A stream gives the files whose content or name changed since the last batch, by their change time; its first batch gives all.  Deletions are found by a whole
    listing only.  Option: settled (seconds that a change must be past; clocks of the driver and of the file server may differ by less than that).
    """

    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self):
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], float(self.options.get("settled", SETTLED)))


def subtrees(root: str, wanted: int) -> list[tuple[str, bool]]:
    """(folder, whether with all below it): parts of the tree, at least ``wanted`` where it has so many folders; of each level the driver reads no more than it needs."""
    parts, level = [], [root]
    while level and len(parts) + len(level) < wanted:
        parts += [(f, False) for f in level]
        level = [os.path.join(f, name) for f in level for name, is_folder in sorted(_entries(f)) if is_folder]
    return parts + [(f, True) for f in level]


def _files(part: tuple[str, bool], after: int | None = None, upto: int | None = None) -> Iterator[tuple]:
    """Rows of a part, if given of changes after one time up to another (ns); in order."""
    left = [part[0]]
    while left:
        folder, below = left.pop(), []
        for name, is_folder in sorted(_entries(folder)):
            if is_folder:
                below.append(os.path.join(folder, name))
            elif (row := _facts(folder, name)) and (upto is None or after < row[-1] <= upto):
                yield row[:-1]
        if part[1]:
            left += reversed(below)


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = _folder(root)

    def partitions(self):
        return [InputPartition(p) for p in subtrees(self.root, SUBTREES * (os.cpu_count() or 1))]

    def read(self, partition):
        return _files(partition.value)


class _StreamReader(DataSourceStreamReader):
    """Offsets are change times in ns; a batch is (after, upto], so one that is run again after a failure gives the files that have not changed since, and the others come in a later one."""

    def __init__(self, root: str, settled: float):
        self.root, self.settled = _folder(root), settled

    def initialOffset(self):
        return {"changed_ns": 0}

    def latestOffset(self):
        return {"changed_ns": time.time_ns() - int(self.settled * 1e9)}

    def partitions(self, start, end):
        return [InputPartition((p, start["changed_ns"], end["changed_ns"])) for p in subtrees(self.root, SUBTREES * (os.cpu_count() or 1))]

    def read(self, partition):
        return _files(*partition.value)

    def commit(self, end):
        pass


def arrivals(spark: SparkSession, root: str, settled: float = SETTLED) -> DataFrame:
    """The stream of changed files of a folder."""
    spark.dataSource.register(MediaListing)
    return spark.readStream.format("media_listing").option("settled", settled).load(root)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            try:
                with open(path, "rb") as f:
                    while part := f.read(PART):
                        digest.update(part)
                out.append(digest.hexdigest())
            except OSError:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "sha256"])


def hashed(files: DataFrame) -> DataFrame:
    """``files`` with sha256 of their content, read in parts; null where a file has vanished."""
    digests = files.select("path").mapInArrow(_hashes, "path string, sha256 string")
    return files.join(digests, "path")


def text_hashed(rows: DataFrame, text: str = "text") -> DataFrame:
    """The same for content that is a column."""
    return rows.withColumn("sha256", F.sha2(F.col(text), 256))
