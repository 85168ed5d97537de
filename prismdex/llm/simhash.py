"""SimHash near-duplicates: fingerprints linked through the anchors of a covering code.

Anchors are triples of codewords: of the binary Golay code of length 23, whose covering radius is 3, for bits 0-22 and
again for bits 23-45 of a fingerprint, and of the Hamming code of length 15, whose covering radius is 1, for bits 46-60.  Every
fingerprint has one home anchor, within the radius in each part.  Two fingerprints that differ at no more than ``t`` bits, t1, t2 and t3 of
them in the parts, meet at the home of either one, because the other lies within 3 + t1, 3 + t2 and 1 + t3
of it.  So each distinct fingerprint is replicated to every anchor within covering radius plus threshold (the
threshold shared between the parts: about 150 of 34 billion anchors for t = 2), and each anchor compares
those at home there with those that were replicated to it.  Links join distinct fingerprints, so copies
are counted once; components come from alternating large-star and small-star rounds over the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm import textblocks as tb
from prismdex.llm.components import components
from prismdex.llm.tables import release, table, written

GOLAY = 0b101011100011  # generator polynomial of the (23, 12) code: a fixed value
#: Length and covering radius of the codes, and the first bit and the code of each part.
CODES = {"golay": (23, 3), "hamming": (15, 1)}
PARTS = ((0, "golay"), (23, "golay"), (46, "hamming"))


# ---------------------------------------------------------------- fingerprints
def single_spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, place, lengths, first): the lower-cased words of a block, a space after each; their places, lengths and first word by text."""
    starts, ends, first = tb.word_spans(tb.SPACE[raw], off)
    lengths = ends - starts
    place = np.concatenate([[0], np.cumsum(lengths + 1)])  # in the text of single-spaced words
    keep = ~tb.SPACE[raw]
    joined = np.full(int(place[-1]), 0x20, np.uint8)
    within = np.arange(len(raw))[keep] + np.repeat(place[:-1] - starts, lengths)
    joined[within] = tb.LOWER[raw[keep]]
    return joined, place, lengths, first


def block_fingerprints(raw: np.ndarray, off: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    joined, place, lengths, first = single_spaced(raw, off)
    n_words = np.diff(first)
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    at = np.concatenate([[0], np.cumsum(n_shingles)])
    owner = tb.spread(at)
    begin = first[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
    last = np.minimum(begin + shingle, first[1:][owner]) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_digest
    b, e = place[begin].tolist(), (place[last] + lengths[last]).tolist()
    hashes = np.frombuffer(b"".join([digest(text[i:j], seed) for i, j in zip(b, e, strict=True)]), np.uint8).reshape(-1, 8)
    out = np.zeros(len(off) - 1, np.uint64)
    full = np.flatnonzero(n_shingles)
    if len(full):
        ones = np.empty((len(full), 64), np.int64)
        for byte in range(8):
            bits = np.unpackbits(hashes[:, byte : byte + 1], axis=1)
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int64)
        majority = np.packbits(2 * ones > n_shingles[full][:, None], axis=1)
        out[full] = majority.view(">u8")[:, 0]
    return out


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """64-bit SimHash as a long (its bits read as unsigned): a bit is 1 where over half of the shingles' XXH64 have it.

    A-Z are lower-cased; words are runs without white space; shingles count with repeats; a text of fewer words is one
    shingle, and one without words, or null, has fingerprint 0.
    """

    @F.arrow_udf("long")
    def hashed(column: pa.Array) -> pa.Array:
        parts = [block_fingerprints(raw, off, shingle, seed) for raw, off in tb.blocks(column, tb.SMALL)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return hashed(text)


# ---------------------------------------------------------------- anchors
def _syndromes(words: np.ndarray, code: str) -> np.ndarray:
    """What tells the words of a coset from those of others: the remainder by GOLAY over GF(2), or the sum of the places (from 1) of set bits."""
    if code == "hamming":
        out = np.zeros_like(words)
        for bit in range(CODES[code][0]):
            out ^= np.where(words >> bit & 1, bit + 1, 0)
        return out
    words = words.copy()
    for bit in range(CODES[code][0] - 1, 10, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
    return words


@cache
def _steps(code: str, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The ways from a word to the codewords around it as padded tables [syndrome, k]: step and excess over the radius (threshold + 1: none)."""
    length, radius = CODES[code]
    patterns = np.array([sum(1 << b for b in c) for k in range(radius + threshold + 1) for c in combinations(range(length), k)], np.int64)
    weight = np.bitwise_count(patterns).astype(np.int64)
    syndrome = _syndromes(patterns, code)
    order = np.lexsort((patterns, weight, syndrome))
    first = np.searchsorted(syndrome[order], np.arange(syndrome.max() + 2))
    place = first[:-1, None] + np.arange(np.diff(first).max())
    there = place < first[1:, None]
    place = np.minimum(place, len(order) - 1)
    return np.where(there, patterns[order][place], 0), np.where(there, np.maximum(weight[order][place] - radius, 0), threshold + 1)


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at_home) for every anchor within covering radius plus threshold of each fingerprint."""
    row, anchor, left = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.full(len(prints), threshold)
    for begin, code in PARTS:
        step, excess = _steps(code, threshold)
        length = CODES[code][0]
        own = (prints >> np.uint64(begin) & np.uint64((1 << length) - 1)).astype(np.int64)
        kind = _syndromes(own, code)[row]
        at, k = np.nonzero(excess[kind] <= left[:, None])  # what the parts before have left of the threshold
        left = left[at] - excess[kind[at], k]
        anchor = anchor[at] << length | (own[row[at]] ^ step[kind[at], k])
        row = row[at]
    return row, anchor, left == threshold


def _replicate(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(prints), 4096):
                row, anchor, home = anchors(prints[i : i + 4096], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[i : i + 4096][row].view(np.int64)), pa.array(home)], ["anchor", "print", "home"])

    return run


def linked_prints(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b) with a < b, written: every pair of the distinct longs in column ``print`` that differ at ``threshold`` bits or fewer."""
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2: beyond it the parts need too many anchors")
    spread = written(prints.select("print").mapInArrow(_replicate(threshold), "anchor long, print long, home boolean"), "anchors")
    at_home = spread.where("home").select("anchor", F.col("print").alias("a"))
    visits = spread.select("anchor", F.col("print").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    links = written(at_home.join(visits, (at_home.anchor == visits.anchor) & near).select("a", "b"), "links")
    release(spread)
    return links


# ---------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row (doc_id, print, component_id) per row of ``docs``.

    component_id is the smallest doc_id reachable over links; null only where every doc_id of the component is
    null.  Equal texts share their fingerprint and so their component; rows without words are linked like any other
    (fingerprint 0).  Repeated rows stay repeated; other columns are not looked at; an empty table gives none.  A very long text is
    hashed whole, in a block of its own (about fifty times its bytes of memory).
    """
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), shingle, seed).alias("print")), "prints")
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(linked_prints(distinct, threshold))  # (node, root): fingerprints that have a link
    rooted = distinct.join(groups, distinct.print == groups.node, "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = written(rooted, "rooted")
    release(distinct)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """The rows of one text of each component: that of its smallest doc_id, of texts that share this id the one of the smallest hash.

    A row is known by doc_id and text, so unlike texts of one doc_id are judged each for itself; rows that repeat both all stay, and so do all rows
    without doc_id.  An empty table gives an empty one; columns pass unchanged.
    """
    named = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = written(named.where("doc_id IS NOT NULL").select("doc_id", "__key", fingerprint(F.col("text")).alias("print")), "prints")
    roots = components(linked_prints(rows.select("print").distinct(), threshold))
    rooted = rows.join(roots, rows["print"] == roots["node"], "left").select("doc_id", "__key", F.coalesce("root", "print").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "__key")).alias("b")).select(F.col("b.doc_id").alias("__doc"), F.col("b.__key").alias("__best"))
    kept = named.join(best, (named["doc_id"] == best["__doc"]) & (named["__key"] == best["__best"]), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def op1_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
