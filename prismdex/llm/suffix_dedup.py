"""Removal of repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform.

The strings of ``length`` bytes are found in three steps, so that no task ever sorts the corpus.

1. Pieces.  Every string of ``length`` bytes has an anchor: of its substrings of ``ANCHOR`` bytes the one with the least hash, the
   leftmost of equals.  Successive strings with the same anchor form a piece.  Equal strings have equal anchors at equal
   places, so only pieces with the same anchor bytes can share a string, and only anchors that occur twice matter.
2. Copies.  Equal pieces are grouped by digest before anything is compared: in all but the first member every byte repeats.
3. Collection.  The distinct pieces of an anchor, lined up at it, are the documents of a collection.  Round by round, from the last
   column to the first, one symbol of each piece is put before its suffix: the symbols in the order of the suffixes are that column's
   part of the Burrows-Wheeler transform, sorting them stably gives the next order, and the common prefixes of neighbours follow
   from the least common prefix between equal symbols.  Neighbours with a common prefix of ``length`` or more hold the same string,
   and all but the first occurrence of it repeat.  A block of pieces and its transform fit in memory, so the external files
   that the method keeps between rounds are left out.

An anchor with very many distinct pieces is split into salted blocks; each hands on the first occurrence of its strings, and equal ones of
different blocks are settled by a grouped minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm import textblocks as tb
from prismdex.llm.tables import table, written

LENGTH, ANCHOR = 100, 32
#: Bytes of a text whose strings are looked at together; a longer text is taken in parts that overlap by a string.
CHUNK = 1 << 22
#: Pieces of one anchor, and of all anchors, that are sorted together.
SALT, BLOCK = 2048, 1 << 14
#: Strings that are digested together, and bytes of texts that are put out together.
STRINGS, OUT = 1 << 16, 1 << 22
NO_ID = -(1 << 63)

_PIECES = "h long, d long, e long, doc long, key long, at int, n int, anchor int"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` successive values."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def cut_pieces(raw: np.ndarray, off: np.ndarray, length: int, digests: bool) -> dict[str, np.ndarray]:
    """Pieces of a block: text, at (first string's start), n (strings), anchor (its place after at), h (hash of the anchor), d and e (digest of the piece)."""
    n = len(raw)
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("text", "at", "n", "anchor", "h", "d", "e")}
    places = np.arange(n - ANCHOR + 1)
    hashes = tb.window_hashes(raw, ANCHOR)
    low = np.uint64((1 << 24) - 1)
    least = _least((hashes & ~low) | places.astype(np.uint64), length - ANCHOR + 1)
    edge = np.zeros(n + 1, np.int64)
    long_ = np.flatnonzero(np.diff(off) >= length)
    np.add.at(edge, off[long_], 1)
    np.subtract.at(edge, off[long_ + 1] - length + 1, 1)
    start = np.flatnonzero(np.cumsum(edge)[: len(least)] > 0)
    value = least[start]
    head = np.ones(len(start), bool)
    head[1:] = (value[1:] != value[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(head)
    at, many = start[first], np.diff(np.append(first, len(start)))
    anchor = (value[first] & low).astype(np.int64)
    text = np.searchsorted(off, at, "right") - 1
    d, e = tb.digests(raw, at, at + many + length - 1) if digests else (at, at)
    return {"text": text, "at": at - off[text], "n": many, "anchor": anchor - at, "h": hashes[anchor].view(np.int64), "d": d, "e": e}


def _all_pieces(column: pa.Array, length: int, digests: bool) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(number of the block's first text, pieces) for all texts of a column."""
    at = 0
    for raw, off in tb.blocks(column):
        if len(off) == 2 and len(raw) > CHUNK:
            for k in range(0, len(raw) - length + 1, CHUNK):
                part = raw[k : k + CHUNK + length - 1]
                found = cut_pieces(part, np.array([0, len(part)]), length, digests)
                found["at"] = found["at"] + k
                yield at, found
        else:
            yield at, cut_pieces(raw, off, length, digests)
        at += len(off) - 1


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, p in _all_pieces(batch.column(0), length, False):
                yield pa.RecordBatch.from_arrays([pa.array(p["h"])], ["h"])

    return run


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, p in _all_pieces(batch.column(2), length, True):
                text = at + p["text"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p["h"]), pa.array(p["d"]), pa.array(p["e"]), pa.array(doc[text]), pa.array(key[text]), *[pa.array(p[k].astype(np.int32)) for k in ("at", "n", "anchor")]],
                    ["h", "d", "e", "doc", "key", "at", "n", "anchor"],
                )

    return run


def _slices(length: int):
    """Bytes of the pieces that are wanted of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text, want = (batch.column(2)[r].as_py() or "").encode(), batch.column(3)[r].values
                at, n = want.field("at").to_numpy(), want.field("n").to_numpy()
                cut = [text[a : a + m + length - 1] for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                same = [pa.array(np.full(len(cut), batch.column(k)[r].as_py(), np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[want.field(k) for k in ("h", "d", "e")], *same, *[want.field(k) for k in ("at", "n", "anchor", "salt")], pa.array(cut, pa.binary())], ["h", "d", "e", "doc", "key", "at", "n", "anchor", "salt", "piece"])

    return run


def repeated_strings(cols: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """[piece, k]: whether string k of a piece also stands in a piece before it.

    cols[j]: symbol of each piece in column j (0xFF, which UTF-8 never has, outside the piece); string k of piece i begins in column
    begin[i] + k.  Pieces are in the order of their occurrences; equal strings stand in equal columns.
    """
    width, count = cols.shape
    span = width - length + 1
    again = np.zeros((count, span), bool)
    order = np.arange(count)
    prefix = np.zeros(count + 1, np.uint16)  # common prefix of each suffix with the one before it
    for j in range(width - 1, -1, -1):
        symbols = cols[j][order]  # this column's part of the transform
        moved = np.argsort(symbols, kind="stable")
        ranked = symbols[moved]
        same = np.flatnonzero(ranked[1:] == ranked[:-1])
        fresh = np.zeros(count + 1, np.uint16)
        if len(same):
            bounds = np.column_stack([moved[same] + 1, moved[same + 1] + 1]).ravel()
            fresh[same + 1] = 1 + np.minimum.reduceat(prefix, bounds)[::2]
        prefix, order = fresh, order[moved]
        if j < span:
            group = np.cumsum(prefix[:count] < length)
            inside = (begin[order] <= j) & (j < begin[order] + n[order])
            own, who = np.compress(inside, group), np.compress(inside, order)
            if len(own):
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                first = np.repeat(np.minimum.reduceat(who, heads), np.diff(np.append(heads, len(own))))
                later = np.compress(who > first, who)
                again[later, j - begin[later]] = True
    return again


_FOUND = "doc long, key long, a int, b int, x long, y long"


def _settle(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings of some whole groups; for salted ones, also first occurrences with digests x and y."""
    rows = rows.combine_chunks()
    col = {k: rows[k].to_numpy() for k in ("h", "d", "e", "doc", "key", "at", "n", "anchor", "salt")}
    order = np.lexsort((col["at"] + col["anchor"], col["key"], col["doc"]))
    whole = np.lexsort((col["e"], col["d"], col["h"]))
    twin = np.zeros(len(order), bool)  # rows of documents that repeat
    twin[whole[1:]] = np.all([col[k][whole[1:]] == col[k][whole[:-1]] for k in ("h", "d", "e")], axis=0)
    order = order[~twin[order]]
    col = {k: v[order].astype(np.int64) for k, v in col.items()}
    count, width = len(order), 2 * length - ANCHOR
    begin = length - ANCHOR - col["anchor"]
    size = col["n"] + length - 1
    pieces = rows["piece"].chunk(0) if rows["piece"].num_chunks else pa.array([], pa.binary())
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2], np.uint8)
    total = np.cumsum(size)
    step = np.arange(total[-1]) - np.repeat(total - size, size)
    flat = data[np.repeat(offsets[order], size) + step]
    cols = np.full((width, count), 0xFF, np.uint8)
    cols[np.repeat(begin, size) + step, np.repeat(np.arange(count), size)] = flat
    again = repeated_strings(cols, begin, col["n"], length)
    edge = np.zeros((count, again.shape[1] + 2), np.int8)
    edge[:, 1:-1] = again
    edge = np.diff(edge, axis=1)
    i, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1]
    blank = pa.nulls(len(i), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(col["doc"][i]), pa.array(col["key"][i]), pa.array((col["at"][i] + a).astype(np.int32)), pa.array((col["at"][i] + b + length - 1).astype(np.int32)), blank, blank], ["doc", "key", "a", "b", "x", "y"])
    salted = np.flatnonzero(col["salt"] >= 0)
    if len(salted):
        i, k = np.nonzero(~again[salted] & (np.arange(again.shape[1]) < col["n"][salted][:, None]))
        i = salted[i]
        for s in range(0, len(i), STRINGS):
            own, within = i[s : s + STRINGS], k[s : s + STRINGS]
            place = (total - size)[own] + within
            low = int(place.min())
            x, y = tb.digests(flat[low : int(place.max()) + length], place - low, place - low + length)
            at = (col["at"][own] + within).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(col["doc"][own]), pa.array(col["key"][own]), pa.array(at), pa.array(at + np.int32(length)), pa.array(x), pa.array(y)], ["doc", "key", "a", "b", "x", "y"])


def _collections(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            while size + rows.num_rows > BLOCK:  # whole groups of (h, salt) only
                both = pa.concat_tables([*held, rows])
                h, salt = both["h"].to_numpy(), both["salt"].to_numpy()
                ends = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
                upto = ends[ends <= BLOCK]
                if not len(ends):
                    break
                cut = int(upto[-1] if len(upto) else ends[0])
                yield from _settle(both.slice(0, cut), length)
                held, size, rows = [], 0, both.slice(cut)
            held.append(rows)
            size += rows.num_rows
        if size:
            yield from _settle(pa.concat_tables(held), length)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc, key, a, b) in order as maximal runs: only the last one is held."""
    held = np.zeros((0, 4), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns]).astype(np.int64)])
        if not len(rows):
            continue
        text = np.concatenate([[0], np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(1))])
        reach = np.maximum.accumulate(text << 40 | rows[:, 3]) & ((1 << 40) - 1)  # ends so far in the same text
        head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (rows[1:, 2] > reach[:-1])]))
        runs = np.column_stack([rows[head, :3], reach[np.append(head[1:], len(rows)) - 1]])
        held = runs[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(runs[:-1, k]) for k in range(4)], ["doc", "key", "a", "b"])
    yield pa.RecordBatch.from_arrays([pa.array(held[:, k]) for k in range(4)], ["doc", "key", "a", "b"])


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, spans, first, held = [], [], [], 0, 0
        for r in range(batch.num_rows):
            raw, own = (batch.column(1)[r].as_py() or "").encode(), batch.column(2)[r]
            runs = np.column_stack(tb.merged(own.values.field("a").to_numpy(), own.values.field("b").to_numpy())).tolist() if own.is_valid else []
            ends = [0, *[x for run in runs for x in run], len(raw)]
            kept.append(b"".join(raw[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True)))
            sizes.append(len(raw))
            spans.append([{"a": i, "b": j} for i, j in runs])
            held += len(raw)
            if held > OUT or r == batch.num_rows - 1:  # texts are let go as they are done
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(kept)), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, _RUNS)], ["doc_id", "kept", "n_bytes", "spans"])
                kept, sizes, spans, first, held = [], [], [], r + 1, 0


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, key, spans) of the texts of ``docs`` (doc, key, text) in which a string of ``length`` bytes occurred before; spans are maximal runs, in any order."""
    texts = docs.select("doc", "key", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    twice = written(texts.select("text").mapInArrow(_anchors(length), "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "anchors")
    found = written(texts.select("doc", "key", "text").mapInArrow(_pieces(length), _PIECES).join(twice, "h", "left_semi"), "pieces")
    groups = written(found.groupBy("h", "d", "e").agg(F.min(F.struct("doc", "key", "at")).alias("f"), F.max("n").alias("n"), F.max("anchor").alias("anchor"), F.count("*").alias("c")), "groups")
    firsts_ = groups.select("f.doc", "f.key", "f.at").hint("merge")
    later = found.select("doc", "key", "at", "n").join(firsts_, ["doc", "key", "at"], "left_anti")  # by place, so copies of one piece are spread
    copies = later.select("doc", "key", F.col("at").alias("a"), (F.col("at") + F.col("n") + length - 1).alias("b"))
    # Counts and least places are written before they are joined, so that a hot anchor or string can be split there.
    many = written(groups.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "many")
    salt = F.when(F.col("m") > SALT, F.pmod(F.col("d"), F.ceil(F.col("m") / SALT))).otherwise(-1).cast("int")
    want = groups.join(many, "h").select("f.doc", "f.key", F.struct("h", "d", "e", "f.at", "n", "anchor", salt.alias("salt")).alias("w")).groupBy("doc", "key").agg(F.collect_list("w").alias("want"))
    bytes_ = texts.join(want, ["doc", "key"]).select("doc", "key", "text", "want").mapInArrow(_slices(length), f"{_PIECES}, salt int, piece binary")
    settled = written(bytes_.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_collections(length), _FOUND), "settled")
    firsts = settled.where("x IS NOT NULL")
    least = written(firsts.groupBy("x", "y").agg(F.min(F.struct("doc", "key", "a")).alias("f"), F.count("*").alias("c")).where("c > 1").select("x", "y", "f"), "least")
    across = firsts.join(least, ["x", "y"]).where(F.struct("doc", "key", "a") != F.col("f")).select("doc", "key", "a", "b")
    spans = copies.union(settled.where("x IS NULL").select("doc", "key", "a", "b")).union(across)
    runs = spans.repartition("doc", "key").sortWithinPartitions("doc", "key", "a").mapInArrow(_merged, "doc long, key long, a long, b long")
    return runs.groupBy("doc", "key").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row (doc_id, kept, n_bytes, spans) per row of ``docs`` (doc_id, text).

    spans: maximal runs of bytes [a, b) of the text as UTF-8 that lie in a string of ``length`` bytes (over 32) which also starts earlier: in a
    document with a smaller doc_id, or before in the same one; overlaps count.  kept: the other bytes (binary, as a cut may fall within a
    character).  All strings are judged on the input.  A null text is empty; texts shorter than ``length`` stay whole; a null doc_id comes
    before all others; texts that share a doc_id come in the order of their hashes, rows that share both are one document and get equal
    results; other columns are ignored; an empty table gives an empty one.
    """
    if length <= ANCHOR + 1 or length > 200:
        raise ValueError(f"length must be from {ANCHOR + 2} to 200")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    shared = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()  # else a key for texts of one id isn't needed
    rows = docs.select("doc_id", doc.alias("doc"), (F.xxhash64("text") if shared else F.lit(0).cast("long")).alias("key"), "text")
    spans = repeated_spans(rows, length)
    joined = rows.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cleaned, "doc_id long, kept binary, n_bytes long, spans array<struct<a:int,b:int>>")


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]))


def op10_suffix_dedup(spark, sf_dir) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", removed_bytes(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
