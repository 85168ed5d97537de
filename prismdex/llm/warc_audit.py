"""Merkle fixity audit of WARC replicas: find damaged records by comparing trees of hashes from the root down.

A replica is a table of WARC files (file, content).  Reading it back finds the records of each file with their offsets, hashes their bytes and builds the tree
of the file above them: a node is a run of records, that is a range of offsets, and hashes its ordered children with their hashes and with
their offsets relative to its own.  Runs end where the hash of a record's id says so (every 16th and every 256th record on average), so a
lost or added record changes the runs around it and no other.  Replicas are compared by file root first; only children of nodes that differ are looked at
on the next level, and a run of the same bytes at another offset is reported as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.tables import release, table, written

#: Levels above the records: runs, runs of runs, files.
LEVELS = 3
#: Files are so many bytes or fewer on average, and over a sixteenth of it; one record of more makes a longer one.
FILE_BYTES = 1 << 22
#: Bytes of files that one task puts together, on average.
TASK_BYTES = 1 << 23
ID, LENGTH = re.compile(rb"\r\nWARC-Record-ID: <urn:sha256:([^>\r\n]*)>"), re.compile(rb"\r\nContent-Length: (\d+)")
BEGIN, BREAK = b"WARC/1.1\r\n", b"\r\n\r\n"

_FILES = "file string, content binary"
_NODES = "level int, file string, node string, id string, ups array<string>, begin long, end long, hash string"


def record(id_: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text; null url or html count as empty, line ends in a url are escaped."""
    url, body = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:sha256:"), id_, F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def record_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def digits_for(total: int) -> int:
    """How many hexadecimal digits of the id name a file, for files of about ``FILE_BYTES`` out of so many bytes."""
    return next(k for k in range(64) if FILE_BYTES * 16**k >= total)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (file, id) of a task once: copies are dropped before the shuffle."""
    seen: set[str] = set()
    for batch in batches:
        fresh = [not (i in seen or seen.add(i)) for i in batch.column(1).to_pylist()]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = last = None
    held: list[bytes] = []
    for batch in batches:
        for file, id_, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if file != name and held:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], ["file", "content"])
                held, last = [], None
            if id_ != last:
                held.append(content)
            name, last = file, id_
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], ["file", "content"])


def write_files(records: DataFrame, digits: int, total: int = 0) -> DataFrame:
    """The WARC files of ``records`` (id, record), written: a file for each prefix of so many digits, records in order of their ids, each id once.

    The file of a record follows from its id, so replicas agree about it however many records one of them has lost.  An id or record that is null is
    empty; an empty table gives no files.  A file is put together in one task and must stay below 2 GB: so must a very long record.  total: bytes of all
    records, for tasks of about ``TASK_BYTES``, or as many as the session shuffles into if that is more.
    """
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    rows = records.select(F.substring(F.coalesce("id", F.lit("")), 1, digits).alias("file"), F.coalesce("id", F.lit("")).alias("id"), F.coalesce("record", F.lit("")).cast("binary").alias("record"))
    rows = rows.mapInArrow(_once, rows.schema).repartition(tasks, "file").sortWithinPartitions("file", "id")
    return written(rows.mapInArrow(_packed, _FILES), "warc")


def parsed(content: bytes) -> Iterator[tuple[str | None, int, int]]:
    """(id, begin, end) of the records of a file in order; bytes that are no record, up to where the next one begins, have no id."""
    at = 0
    while at < len(content):
        stop = content.find(BREAK, at) if content.startswith(BEGIN, at) else -1
        head = content[at : stop + 2] if stop >= 0 else b""
        name, length = ID.search(head), LENGTH.search(head)
        end = stop + 4 + int(length[1]) if name and length and len(length[1]) < 12 else len(content)
        if name and length and content.startswith(BREAK, end):
            yield name[1].decode("utf-8", "replace"), at, end + 4
            at = end + 4
        else:
            end = content.find(BREAK + BEGIN, at)
            end = len(content) if end < 0 else end + 4
            yield None, at, end
            at = end


def tree(content: bytes) -> list[list[tuple]]:
    """Levels of the tree over the records of a file, [records, runs, runs of runs, the file], each of (node, id, ups, begin, end, hash); ups: the nodes above, the next one first."""
    level, seen, up1, up2 = [], {}, "", ""
    for name, begin, end in parsed(content):
        digest = hashlib.sha256(memoryview(content)[begin:end]).hexdigest()
        key = name if name is not None else f"unreadable {digest}"
        seen[key] = seen.get(key, -1) + 1
        key = f"{key} {seen[key]}"
        opens = hashlib.sha256(key.encode()).digest()[0] if begin else 1  # the first record goes into the run without a name
        up1, up2 = key if opens % 16 == 0 else up1, key if opens == 0 else up2
        level.append((key, name, [up1, up2, ""], begin, end, digest))
    out = [level]
    for _ in range(LEVELS):
        above = []
        for up, children in groupby(level, key=lambda c: c[2][0]):
            children = list(children)
            begin = children[0][3]
            lines = "\n".join(f"{c[3] - begin} {c[4] - begin} {c[0]} {c[5]}" for c in children)
            above.append((up, None, children[0][2][1:], begin, children[-1][4], hashlib.sha256(lines.encode()).hexdigest()))
        level = above
        out.append(level)
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), *[pa.string()] * 3, pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = [(k, file, *node) for k, level in enumerate(tree(content.as_py() or b"")) for node in level]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _NODES.split(", ")])


def read_files(files: DataFrame) -> DataFrame:
    """The trees of WARC files (file, content), written: level (0: records), file, node (of a record: its id and number among equal ids), id (of a record; null: unreadable bytes), ups, begin, end, hash.

    A null file or content is empty; names of files should not repeat; other columns are ignored; an empty table has no trees.  A file is read in one task.
    """
    return written(files.select(F.coalesce("file", F.lit("")).alias("file"), "content").mapInArrow(_nodes, _NODES), "trees")


def _compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node, begin, end, other_begin, kind) of nodes of one level that differ in their bytes or their place."""
    a = a.select("file", "node", F.col("begin").alias("a_begin"), F.col("end").alias("a_end"), F.col("hash").alias("a_hash"))
    b = b.select("file", "node", F.col("begin").alias("b_begin"), F.col("end").alias("b_end"), F.col("hash").alias("b_hash"))
    both = a.join(b, ["file", "node"], "full").where(~(F.col("a_hash").eqNullSafe(F.col("b_hash")) & F.col("a_begin").eqNullSafe(F.col("b_begin"))))
    kind = F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "extra").when(F.col("a_hash") == F.col("b_hash"), "moved").otherwise("changed")
    return both.select("file", "node", F.coalesce("a_begin", "b_begin").alias("begin"), F.coalesce("a_end", "b_end").alias("end"), F.col("b_begin").alias("other_begin"), kind.alias("kind"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(level, file, node, begin, end, other_begin, kind): where two replicas, as ``read_files`` gives them, differ.

    kind: changed, missing (from the second), extra (only in the second): single records, level 0.  moved: the same bytes at another offset, a record or the
    longest run of records (levels 1 and 2; 3: a whole file) that moved as one; begin, end: offsets in the first replica (extra: the second), other_begin: in the
    second.  Empty replicas have no files; equal ones give no rows.
    """
    at = lambda x, k: x.where(F.col("level") == k).select("file", "node", F.get("ups", F.lit(0)).alias("up"), "begin", "end", "hash")
    found = written(_compared(at(first, LEVELS), at(second, LEVELS)), "branches")
    out = found.where("kind = 'moved'").select(F.lit(LEVELS).alias("level"), "*")
    for level in reversed(range(LEVELS)):
        parents = found.where("kind <> 'moved'").select("file", F.col("node").alias("up"))
        under = lambda x, k=level, p=parents: at(x, k).join(p, ["file", "up"], "left_semi")
        found = written(_compared(under(first), under(second)), "branches")
        out = out.unionByName((found if level == 0 else found.where("kind = 'moved'")).select(F.lit(level).alias("level"), "*"))
    return out


def single_records(found: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, node, id, n_bytes, kind) of every record that an audit of the two replicas speaks of: runs that moved become their records."""
    own = ["file", "node", "id", (F.col("end") - F.col("begin")).alias("n_bytes")]
    rows = lambda x: x.where("level = 0").select(*own, F.posexplode(F.concat(F.array("node"), "ups")).alias("level", "at"))
    kinds = found.select("file", "level", F.col("node").alias("at"), "kind")
    known = rows(first).join(kinds.where("kind <> 'extra'"), ["file", "level", "at"])
    return known.unionByName(rows(second).join(kinds.where("kind = 'extra'"), ["file", "level", "at"])).select("file", "node", "id", "n_bytes", "kind")


def page_records(pages: DataFrame) -> DataFrame:
    """The record of each row of ``pages`` (page_id, url, html), null as empty: page_id, id, record; equal rows have equal ids."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("id", record_id(F.col("page_id"), F.col("url"), F.col("html")))
    return rows.select("page_id", "id", record(F.col("id"), F.col("url"), F.col("html")).alias("record"))


def op8_warc_audit(spark, sf_dir) -> DataFrame:
    """The WARC files of all pages against a replica in which every 97th page_id is damaged, every 211th lost and every 307th written once more under another url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    every = lambda n, k: F.coalesce(F.pmod("page_id", F.lit(n)) == k, F.lit(False))
    rows = page_records(pages)
    again = page_records(pages.where(every(307, 11)).withColumn("url", F.concat(F.coalesce("url", F.lit("")), F.lit("#again"))))
    other = rows.where(~every(211, 5)).withColumn("record", F.when(every(97, 13), F.overlay("record", F.lit("R"), F.lit(22))).otherwise(F.col("record"))).unionByName(again)
    counted = lambda x, k: x.groupBy("page_id", "id", F.octet_length("record").cast("long").alias("n")).agg(F.count("*").alias("copies")).withColumn("again", F.lit(k))
    names = written(counted(rows, False).unionByName(counted(again, True)), "names")
    total = names.where("NOT again").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    trees = []
    for x in (rows, other):
        files = write_files(x, digits_for(total), total)
        trees.append(read_files(files))
        release(files)
    found = single_records(audit(*trees), *trees).join(names.select("id", "page_id", "copies"), "id")
    return found.select("page_id", "n_bytes", "kind", "copies")


OP8_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, count(*) AS copies FROM pages GROUP BY ALL),
x AS (SELECT page_id, coalesce(url, '') || '#again' AS url, coalesce(html, '') AS html, count(*) AS copies FROM pages WHERE page_id % 307 = 11 GROUP BY ALL),
u AS (SELECT *, false AS again FROM p UNION ALL SELECT *, true FROM x),
r AS (
  SELECT page_id, copies, again, sha256(coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || url || chr(10) || html) AS id,
    CAST(octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:' || repeat('0', 64) || '>' || chr(13) || chr(10)
      || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A')
      || repeat(chr(13) || chr(10), 2) || html || repeat(chr(13) || chr(10), 2))) AS BIGINT) AS n FROM u),
d AS (SELECT min(k) AS digits FROM range(0, 16) t(k) WHERE {FILE_BYTES} * power(16, k) >= (SELECT coalesce(sum(n), 0) FROM r WHERE NOT again)),
a AS (SELECT id, page_id, copies, n, sum(n) OVER (PARTITION BY substr(id, 1, digits) ORDER BY id) - n AS place FROM r, d WHERE NOT again),
b AS (SELECT id, page_id, copies, n, sum(n) OVER (PARTITION BY substr(id, 1, digits) ORDER BY id) - n AS place FROM r, d WHERE again OR coalesce(page_id % 211 <> 5, true)),
m AS (
  SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.n, b.n) AS n_bytes, coalesce(a.copies, b.copies) AS copies,
    CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN a.page_id % 97 = 13 THEN 'changed' WHEN a.place <> b.place THEN 'moved' END AS kind
  FROM a FULL JOIN b ON a.id = b.id)
SELECT page_id, n_bytes, kind, copies FROM m WHERE kind IS NOT NULL
"""
