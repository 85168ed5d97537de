"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed together; a window that occurred before, in a document with a smaller doc_id or
earlier in the same one, is removed, and overlapping removed windows are merged into spans of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.tables import release, table, written

WINDOW = 3
WHITE = " \t\r\v\f"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(lines: Column, i: Column, size: int) -> Column:
    """128 bits of the lines i to i + size - 1 (from 0), kept apart by their line ends."""
    part = F.concat_ws("\n", *[F.get(lines, i + k) for k in range(size)])
    return F.struct(F.xxhash64(part).alias("a"), F.xxhash64(F.lit(1), F.lit("\n"), part).alias("b"))


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, at, digest) of every window; texts of fewer lines have none, and windows of white space (\\x20, \\x09, \\x0B-\\x0D) neither."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _lines(F.col("text")).alias("lines"))
    lines = lines.where(F.size("lines") >= size)
    every = F.transform(F.sequence(F.lit(0), F.size("lines") - size), lambda i: F.struct(i.alias("at"), _hash(F.col("lines"), i, size).alias("digest"), _blank(i, size).alias("blank")))
    return lines.select("doc_id", "text_key", F.explode(every).alias("w")).where("NOT w.blank").select("doc_id", "text_key", "w.at", "w.digest")


def _blank(i: Column, size: int) -> Column:
    return F.concat(*[F.trim(F.get(F.col("lines"), i + k), F.lit(WHITE)) for k in range(size)]) == ""


def removed_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, spans): merged line ranges [a, b) of windows that occurred before, for documents that have any."""
    found = written(windows(docs, size), "windows")
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", "f")
    later = found.join(first, "digest").where(~F.struct("doc_id", "text_key", "at").eqNullSafe(F.col("f")))
    places = later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("places"))
    spans = written(places.select("doc_id", "text_key", _merge(F.col("places"), size).alias("spans")), "spans")
    release(found)
    return spans


def _merge(places: Column, size: int) -> Column:
    """Sorted window starts as merged ranges: a start opens a range unless one stands less than or exactly ``size`` before it."""
    n = F.size(places)
    opens = F.filter(places, lambda x, i: (i == 0) | (x > F.coalesce(F.get(places, i - 1), F.lit(0)) + size))
    ends = F.filter(places, lambda x, i: (i == n - 1) | (F.coalesce(F.get(places, i + 1), F.lit(0)) > x + size))
    return F.zip_with(opens, ends, lambda a, b: F.struct(a.alias("a"), (b + size).alias("b")))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text without the removed lines, n_lines, spans: one row per row of ``docs`` (doc_id, text).

    Lines end at \\n.  Null texts stay null (0 lines); an empty text is one line; texts of fewer than ``size`` lines stay whole, and so do windows of white
    space only.  The first occurrence is that of the smallest doc_id (null first), then text hash, then place; rows that repeat
    both id and text count as one document and keep equal results.  Other columns are ignored; an empty table gives an empty one.  A very long text is split
    into lines within its row.
    """
    spans = removed_spans(docs, size).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "spans").hint("merge")  # they grow with the corpus: never broadcast
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__k"))
    rows = rows.join(spans, rows["doc_id"].eqNullSafe(spans["__doc"]) & (rows["__k"] == spans["__key"]), "left")
    spans_ = F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))
    lines = _lines(F.col("text"))
    ends = F.transform(spans_, lambda s, k: F.struct(F.coalesce(F.get(spans_, k - 1)["b"], F.lit(0)).alias("a"), s["a"].alias("b")))  # what stays before each span
    stays = F.concat(ends, F.array(F.struct(F.element_at(spans_, -1)["b"].alias("a"), F.size(lines).alias("b"))))
    kept = F.flatten(F.transform(stays, lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"])))
    text = F.when(F.size(spans_) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select("doc_id", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"), spans_.alias("spans"))


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]))
    return found.select("doc_id", "n_lines", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(x[i : i + 2], chr(10)) AS g FROM l, LATERAL (SELECT unnest(range(1, len(x) - 1)) AS i)
  WHERE trim(x[i] || x[i + 1] || x[i + 2], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM r),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (gap) AS n_spans FROM (
  SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS gap FROM c) GROUP BY doc_id),
k AS (
  SELECT l.doc_id, string_agg(u.y, chr(10) ORDER BY u.p) AS kept FROM l, LATERAL (SELECT unnest(x) AS y, generate_subscripts(x, 1) AS p) u
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND c.p = u.p) GROUP BY l.doc_id)
SELECT l.doc_id, CAST(len(x) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""
