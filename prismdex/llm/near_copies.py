"""Near copies of texts by SimHash, and by the Jaccard similarity of their sets of shingles.

1. SimHash.  Texts whose 64-bit fingerprints differ at ``simhash`` 's 2 bits or fewer are linked, as that operator does it.  Alone it finds about half of the near copies:
   texts of similarity 0.8 lie about 10 bits apart and often 16, where unrelated texts begin to meet, so no set of anchors is both short and complete.
   The other steps add the rest to its groups.
2. Buckets.  Texts, known by 128 bits of their SHA-256, that agree in one of ``BANDS`` groups of ``ROWS`` least hashes (MinHash) share a bucket.  A
   pair of similarity 0.8 shares none with probability 0.00006, one of 0.9 with less than 1e-10.
3. Stars.  Every text is compared, by exact similarity, with the least id of each of its buckets; components of all links so far are groups.
4. Rest.  A bucket is open while two of its texts, neither of them the least, lie in different groups; only texts of open buckets are compared with each other,
   in a walk that leaves out pairs of one group.  Equal buckets are walked once; one of over ``GROUP`` texts is dealt out by pairs of blocks.

So groups are made of links of fingerprints and links that were verified, and chance meetings in buckets do not chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm import textblocks as tb
from prismdex.llm.components import components
from prismdex.llm.simhash import block_fingerprints, linked_prints
from prismdex.llm.tables import boxed, release, small_batches, unboxed, written

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 6
#: Words of a shingle and seed of the fingerprints, as in ``simhash``.
PRINTED, SEED = 3, 42
#: Texts of a group that are compared in one task (two blocks of half as many), and rows that are shingled together.
GROUP, HELD = 1000, 2000
#: Texts that are compared with the centre of a star in one task; a larger star is dealt out, with its centre's text to each part.
STAR = 250
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): those of text i are first[i]:first[i + 1], with repeats; a text of fewer words has one, one without words that of no bytes."""
    low = tb.LOWER[raw]
    starts, ends, first = tb.word_spans(tb.SPACE[low], off)
    names, distinct = tb.named(low, starts, ends)
    words = tb.span_hashes(*tb.bytes_of(distinct))[names]
    n_words = np.diff(first)
    at = np.concatenate([[0], np.cumsum(np.maximum(n_words - shingle + 1, 1))])
    owner = tb.spread(at)
    begin = first[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
    stop = first[1:][owner]
    out = np.zeros(len(owner), np.uint64)
    for k in range(shingle):  # each word in turn is mixed into all bits
        more = begin + k < stop
        out = np.where(more, tb.mix(out * _ODD + words[np.minimum(begin + k, len(words) - 1)]), out) if len(words) else out
    return out, at


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, prints = [], []
        for raw, off in tb.blocks(batch.column("text"), tb.SMALL):
            prints.append(block_fingerprints(raw, off, PRINTED, SEED))
            hashes, first = shingle_hashes(raw, off)
            band = np.zeros((len(off) - 1, BANDS), np.uint64)
            for k, factor in enumerate(_FACTORS):
                mixed = hashes * factor
                mixed ^= mixed >> np.uint64(32)
                band[:, k // ROWS] = tb.mix(band[:, k // ROWS] + np.minimum.reduceat(mixed, first[:-1]))
            keys.append(tb.mix(band + np.arange(BANDS, dtype=np.uint64)))
        flat = pa.array(np.concatenate(keys).ravel().view(np.int64) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), flat)
        prints = pa.array(np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("place"), lists, prints], ["digest", "place", "keys", "print"])


def shingle_sets(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text, ascending."""
    parts, counts = [], []
    for raw, off in tb.blocks(texts, tb.SMALL):
        hashes, first = shingle_hashes(raw, off)
        owner = tb.spread(first)
        order = np.lexsort((hashes, owner))
        hashes = hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        parts.append(hashes[new])
        counts.append(np.bincount(owner[new], minlength=len(off) - 1))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def similar(shared: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many shared members are near copies: shared / (one + two - shared) >= a / b."""
    return (LEAST[0] + LEAST[1]) * shared >= LEAST[0] * (one + two)


def spanning_links(flat: np.ndarray, first: np.ndarray, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) of similar sets that connect every component of the sets flat[first[i]:first[i + 1]], none of them empty.

    groups: sets of one group are connected already, and not compared.
    """
    words, place = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(words), bool)
    sizes = np.diff(first)
    groups = np.arange(len(sizes)) if groups is None else groups
    rest, flat, starts = np.arange(len(sizes)), place, first[:-1]
    links, reached = [], []

    def leave(gone: np.ndarray) -> None:
        nonlocal rest, flat, starts
        if gone.any():
            reached.extend(rest[gone].tolist())
            flat = flat[np.repeat(~gone, sizes[rest])]
            rest = rest[~gone]
            starts = np.cumsum(sizes[rest]) - sizes[rest]

    while len(rest):
        if not reached:
            leave(groups[rest] == groups[rest[0]])
            continue
        i = reached.pop()
        own = place[first[i] : first[i + 1]]
        mark[own] = True
        near = similar(np.add.reduceat(mark[flat], starts, dtype=np.int64), sizes[i], sizes[rest])
        mark[own] = False
        links += [(i, int(j)) for j in rest[near]]
        leave(np.isin(groups[rest], groups[rest[near]]) if near.any() else near)
    return links


def _compare(rows: pa.Table) -> pa.RecordBatch:
    """Links of whole buckets."""
    bucket, ids, roots = (rows[c].to_numpy() for c in ("bucket", "id", "root"))
    flat, at = shingle_sets(rows["text"])
    a, b = [], []
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for x, y in spanning_links(flat[at[i] : at[j]], at[i : j + 1] - at[i], roots[i:j]) if j > i + 1 else ():
            a.append(ids[i + x])
            b.append(ids[i + y])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        bucket = rows["bucket"].to_numpy()
        ends = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        at = 0
        while len(ends) and at < ends[-1]:  # the last bucket may go on
            upto = ends[(ends > at) & (ends <= at + HELD)]
            cut = int(upto[-1] if len(upto) else ends[ends > at][0])
            yield _compare(rows.slice(at, cut - at))
            at = cut
        held = rows.slice(at)
    if held is not None and held.num_rows:
        yield _compare(held)


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to the centre of each star, whose text comes first."""
    centre, own = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            rows = pa.Table.from_batches([batch.slice(at, HELD)])
            flat, first = shingle_sets(rows["text"])
            star, part, ids = (rows[c].to_numpy() for c in ("a", "part", "b"))
            sizes, found = np.diff(first), []
            edges = np.flatnonzero(np.concatenate([[True], (star[1:] != star[:-1]) | (part[1:] != part[:-1]), [True]]))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if centre != (star[i], part[i]):
                    centre, own = (star[i], part[i]), flat[first[i] : first[i + 1]]
                members = flat[first[i] : first[j]]
                place = np.minimum(np.searchsorted(own, members), len(own) - 1)
                shared = np.add.reduceat(own[place] == members, first[i:j] - first[i], dtype=np.int64)
                near = np.flatnonzero(similar(shared, len(own), sizes[i:j]) & (ids[i:j] != star[i])) + i
                found.append(np.column_stack([star[near], ids[near]]))
            both = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _with_texts(rows: DataFrame, on: str, known: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the text of the id in column ``on``: that of the row at its least place, as the place spreads copies of a text."""
    placed = rows.join(known.select(F.col("id").alias(on), F.col("digest").alias("d"), F.col("least").alias("l")), on)
    return texts.join(placed, (F.col("digest") == F.col("d")) & F.col("place").eqNullSafe(F.col("l"))).select(*[c for c in rows.columns], "text")


def print_links(texts: DataFrame) -> DataFrame:
    """(a, b) with a < b, written: ids that connect the texts (id, print) whose fingerprints are equal or linked."""
    least = written(texts.groupBy("print").agg(F.min("id").alias("a")), "prints")
    linked = linked_prints(least)
    one, two = (least.select(F.col("print").alias(p), F.col("a").alias(i)) for p, i in (("p", "i"), ("q", "j")))
    near = linked.select(F.col("a").alias("p"), F.col("b").alias("q")).join(one, "p").join(two, "q").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    equal = texts.join(least, "print").where("a <> id").select("a", F.col("id").alias("b"))
    links = written(near.union(equal), "print-links")
    release(least, linked)
    return links


def near_links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, links), both written, of ``texts`` (digest, place, text).

    known: (id, digest, least) for every distinct text, with its least place.  links: (a, b) with a < b, pairs of ids, by fingerprints or similar, that connect every component of near copies.
    """
    columns = texts.select("digest", "place").withColumns({"keys": F.array().cast("array<long>"), "print": F.lit(0).cast("long")})
    bands = texts.select("digest", "place", "text").mapInArrow(_bands, columns.schema)
    bands = bands.groupBy("digest").agg(F.min("place").alias("least"), F.first("keys").alias("keys"), F.first("print").alias("print"))
    with small_batches(texts.sparkSession):
        bands = written(bands.withColumn("id", F.monotonically_increasing_id()), "bands")
    known = bands.select("id", "digest", "least")
    known._written_to = bands._written_to
    printed = print_links(bands.select("id", "print"))
    keyed = bands.select("id", F.explode("keys").alias("key"))
    # Least ids and sizes are written before they are joined, so that a bucket or star of very many texts can be split there.
    shared = written(keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last").drop("last"), "shared")
    members = written(keyed.join(shared, "key").where("a <> id").select("key", "a", F.col("id").alias("b")), "members")
    pairs = written(members.select("a", "b").distinct(), "pairs")
    parts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts")), "parts")
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    stars = _with_texts(dealt, "b", known, texts).unionByName(_with_texts(dealt.select("a", "part").distinct(), "a", known, texts).withColumn("b", F.col("a")))
    stars = stars.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a")).select("a", "part", "b", "text")
    with small_batches(texts.sparkSession):
        verified = written(stars.mapInArrow(_starred, "a long, b long").union(printed).distinct(), "verified")
    release(shared, pairs, parts, printed)
    # Open buckets: those with texts of different groups besides the centre, which was compared with all.
    roots = written(components(written(verified.select("a", "b"), "links")), "roots")
    rooted = members.join(roots, members["b"] == roots["node"], "left").select("key", F.col("b").alias("id"), F.coalesce("root", "b").alias("root"))
    rooted = written(rooted, "rooted")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"x{k}") for k in (1, 2)]).where("low < high")
    open_ = written(open_.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", F.ceil(2 * F.col("n") / GROUP).alias("blocks")), "open")
    own = F.pmod("id", "blocks")
    other = F.when(F.col("blocks") <= 2, F.array(F.lit(0).cast("long"))).otherwise(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.array(own)))
    pair = F.when(F.col("blocks") <= 2, 0).otherwise(F.least(own, F.col("other")) * F.col("blocks") + F.greatest(own, F.col("other")))
    walked = rooted.join(open_, "key").withColumn("other", F.explode(other)).select(F.xxhash64("key", pair).alias("bucket"), "id", "root")
    walked = _with_texts(walked, "id", known, texts).dropDuplicates(["bucket", "id"])
    walked = walked.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_compared, "a long, b long")
    with small_batches(texts.sparkSession):
        links = written(verified.union(walked).distinct(), "links")
    release(members, verified, roots, rooted, open_)
    return known, links


def keep_one_near(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies (fingerprints within 2 bits, or five-word Jaccard similarity of 0.8 or more): that of its smallest doc_id.

    Rows are told apart by doc_id and text: different texts that share a doc_id are judged each for itself, and so are rows without
    doc_id, which come after all others.  Null and empty texts are one text, without words like those of white space alone, so one row of all these stays.  Of equal
    doc_ids the smallest digest of a text goes first; of repeated rows one stays.  Columns may have any names; an empty table gives an empty one.
    """
    digest = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)
    rows = boxed(docs, digest=digest, place=F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"), text=F.col("text"))
    known, links = near_links(rows)
    roots = components(links)
    best = known.join(roots, known["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min(F.struct("least", "digest")).alias("best"))
    best = best.select(F.col("best.digest").alias("d"), F.col("best.least").alias("l"))
    kept = rows.join(best, (F.col("digest") == F.col("d")) & F.col("place").eqNullSafe(F.col("l")), "left_semi")
    return unboxed(kept.dropDuplicates(["place", "digest"]))
