"""Sinks of files that appear all at once or not at all: binary files by name, and CSV rows.

``df.write.format("committed_files" | "committed_csv").mode("append").save(folder)``, or ``writeStream`` likewise.  Attempts write to folders of their own below a hidden one; the commit gathers
those that won and renames their folder to that of the batch, in one step.  A failed write takes its hidden folder away; what a lost driver, or an attempt of a stream that lost, leaves
is hidden from readers, and ``swept`` takes it away.  A batch that is there already is not written again, so a write that is repeated under its ``batch`` option, and a micro-batch
that a stream repeats, doubles nothing.  The folder has to be mounted on driver and executors.
"""

from __future__ import annotations

import contextlib
import csv
import errno
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

FILES = "batch string, name string, content binary"
STAGED = ".staged-"
TRIES = 5


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


def _local(path: str) -> str:
    return path.removeprefix("file://").rstrip("/") or "/"


def _inside(folder: str, name: str | None) -> str:
    """The place of a name in a folder; one that would be outside of it, hidden or no name is an error."""
    parts = (name or "").split("/")
    if any(p in ("", "..") or p.startswith(".") for p in parts):
        raise ValueError(f"not a name of a file: {name!r}")
    return os.path.join(folder, *parts)


def _below(folder: str, place: str) -> None:
    """Makes the folders down to a place, but not the first one again: it may have been taken away by an abort."""
    if place != folder:
        _below(folder, os.path.dirname(place))
        with contextlib.suppress(FileExistsError):
            os.mkdir(place)


def put_files(folder: str, rows: Iterator) -> None:
    """A file for each row (name, content): null content is an empty file, a name that the attempt has written already is an error."""
    for row in rows:
        place = _inside(folder, row["name"])
        _below(folder, os.path.dirname(place))
        with open(place, "xb") as f:
            f.write(row["content"] or b"")


def put_csv(folder: str, rows: Iterator) -> None:
    """One file with a header; none without rows.  Nulls are empty fields, empty texts are quoted."""
    first = next(rows, None)
    if first is None:
        return
    with open(os.path.join(folder, "rows.csv"), "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=csv.QUOTE_NOTNULL, escapechar="\\", doublequote=False, lineterminator="\n")
        out.writerow(first.__fields__)
        out.writerow(first)
        out.writerows(rows)


class _Writer:
    """Attempts, commit and abort of one batch, or of the micro-batches of a stream."""

    def __init__(self, root: str, batch: str | None, overwrite: bool, put: Callable[[str, Iterator], None]) -> None:
        if batch is not None and not re.fullmatch(r"[A-Za-z0-9][\w.=-]*", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        self.root, self.batch, self.overwrite, self.put = _local(root), batch or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", overwrite, put
        self.staged = os.path.join(self.root, f"{STAGED}{uuid.uuid4().hex}")
        os.makedirs(self.staged)  # here, on the driver: a task that outlives an abort finds it gone and can't make it again

    def write(self, iterator: Iterator) -> Attempt:
        folder = os.path.join(self.staged, f"part-{uuid.uuid4().hex}")
        os.mkdir(folder)
        try:
            self.put(folder, iterator)
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Attempt(folder)

    def _commit(self, messages: list, batch: str) -> None:
        """Gathers the attempts that won below another hidden folder, which then gets the name of the batch."""
        place, own = os.path.join(self.root, batch), f"{self.staged}-{batch}"
        before = [e.path for e in os.scandir(self.root) if e.is_dir() and not e.name.startswith(".") and e.path != place] if self.overwrite else []
        os.makedirs(own)
        for m in filter(None, messages):
            os.rename(m.folder, os.path.join(own, os.path.basename(m.folder)))
        try:
            if os.path.exists(place):  # an empty folder would be replaced
                raise FileExistsError(place)
            os.rename(own, place)
        except OSError as e:
            shutil.rmtree(own)
            if e.errno not in (None, errno.EEXIST, errno.ENOTEMPTY):
                raise
        for old in before:
            shutil.rmtree(old)

    def _abort(self) -> None:
        for e in list(os.scandir(self.root)):
            for _ in range(TRIES):  # a task that is being killed may add to it meanwhile
                if e.path.startswith(self.staged) and os.path.exists(e.path):
                    shutil.rmtree(e.path, ignore_errors=True)


class BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages):
        self._commit(messages, self.batch)
        self._abort()  # attempts that lost

    def abort(self, messages):
        self._abort()


class StreamWriter(_Writer, DataSourceStreamWriter):
    """Batches are named by the option ``batch``, which a stream has to give, and their number."""

    def commit(self, messages, batchId):
        self._commit(messages, f"{self.batch}-{batchId:09d}")

    def abort(self, messages, batchId):
        for m in filter(None, messages):
            shutil.rmtree(m.folder, ignore_errors=True)


class _Committed(DataSource):
    put: Callable[[str, Iterator], None]

    def schema(self):
        return FILES

    def writer(self, schema, overwrite):
        return BatchWriter(self.options["path"], self.options.get("batch"), overwrite, type(self).put)

    def streamWriter(self, schema, overwrite):
        if "batch" not in self.options:
            raise ValueError("a stream has to name its batches: option batch")
        return StreamWriter(self.options["path"], self.options["batch"], False, type(self).put)


class CommittedFiles(_Committed):
    """Rows (name, content); read back as (batch, name, content)."""

    put = staticmethod(put_files)

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def reader(self, schema):
        return _Reader(self.options["path"])


class CommittedCsv(_Committed):
    """Rows of any columns that CSV can say.  ``csv_rows`` reads them back."""

    put = staticmethod(put_csv)

    @classmethod
    def name(cls) -> str:
        return "committed_csv"


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = _local(root)

    def partitions(self):
        batches = [e for e in os.scandir(self.root) if e.is_dir() and not e.name.startswith(".")]
        return [InputPartition((b.name, p.path)) for b in sorted(batches, key=lambda e: e.name) for p in os.scandir(b.path)] or [InputPartition((None, None))]

    def read(self, partition):
        batch, top = partition.value
        for folder, _, names in os.walk(top) if top else ():
            for name in names:
                place = os.path.join(folder, name)
                with open(place, "rb") as f:
                    yield batch, os.path.relpath(place, top), f.read()


def registered(spark: SparkSession) -> None:
    for source in (CommittedFiles, CommittedCsv):
        spark.dataSource.register(source)


def write(rows: DataFrame, path: str, kind: str = "files", batch: str | None = None, mode: str = "append") -> None:
    """One committed batch of ``files`` or ``csv``; with ``overwrite`` the batches before it go once it is there."""
    registered(rows.sparkSession)
    out = rows.write.format(f"committed_{kind}").mode(mode)
    (out if batch is None else out.option("batch", batch)).save(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(name, content): of each name the file of the last batch by name, and of equal ones within a batch the greatest content."""
    registered(spark)
    rows = spark.read.format("committed_files").load(path)
    return rows.groupBy("name").agg(F.max(F.struct("batch", "content")).alias("x")).select("name", "x.content")


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all batches; empty texts stay, as only an unquoted empty field is null (or a text of one NUL, which stands for it in the parser)."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "\0").option("recursiveFileLookup", True).option("multiLine", True).option("escape", "\\").csv(path)


def swept(path: str, older: float = 86_400.0) -> int:
    """Takes away hidden folders that nothing has changed for so many seconds; how many."""
    left = [e.path for e in os.scandir(_local(path)) if e.name.startswith(STAGED) and time.time() - e.stat().st_mtime > older]
    for folder in left:
        shutil.rmtree(folder)
    return len(left)
