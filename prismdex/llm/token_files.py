"""Token ids of documents in wavelet-matrix shards, in ascending order of doc_id.

Documents are dealt by ranges of (doc_id, text hash) and sorted within each range; a task encodes them and packs whole documents
into shards of about ``SHARD_TOKENS`` ids.  Each shard is one file of ``wavelet``; Spark commits them as binary values of
a table in the shared folder, so a lost task leaves no half-written file and any store that Spark writes to will do.
Where each shard starts follows from sums over shards, first within a range and then over ranges.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismdex.llm import textblocks as tb
from prismdex.llm.tables import new_path, small_batches, table
from prismdex.llm.wavelet import Shard, pack

SHARD_TOKENS = 1 << 20
END = 0
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 500_000
#: Bytes of texts that are cut into pieces together.
BLOCK = 1 << 20
#: Pieces that are encoded together, as lines of one text.
LINES = 512

#: Marks that a byte-level pre-tokenizer cuts off from a letter or digit before them.
MARKS, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
MARKS[list(b".,;:!?")] = True
ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True

_FILES = "range int, shard int, n_tokens long, file binary"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids from the tokenizers library, for blocks of whole texts.

    A byte-level pre-tokenizer never joins what stands before a single space or line end between two other characters with what follows, nor a
    letter or digit with the marks behind it.  So texts are cut there, each distinct piece is encoded once a block, and the ids of the first ``REMEMBERED``
    pieces are kept by their bytes.  Texts with any other white space are encoded as one; so are all texts where the file has a normalizer, another
    pre-tokenizer or an added token that such a cut could split.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.levels = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.cuts = _may_cut(json.loads(self.library.to_str()))
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = np.array(line, np.uint32)
        # Kept pieces, without objects of Python: ascending hashes and the piece of each; by piece its text without the space, whether it has one, and the range of its ids; a size of -1 marks other white space.
        self.hashes, self.piece = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.texts, self.spaced = pa.array([], pa.string()), np.zeros(0, bool)
        self.first, self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of pieces without white space but for a leading space: many go as lines of one text."""
        sizes, flat = [], []
        for k in range(0, len(pieces), LINES):
            own = pieces[k : k + LINES]
            ids = np.array(self.library.encode_batch_fast(["\n".join([*own, ""])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.line[0]) if len(self.line) == 1 else ids[:0]
            if len(ends) == len(own):
                sizes.append(np.diff(ends, prepend=-1) - 1)
                flat.append(np.delete(ids, ends))
            else:
                each = self._whole(own)
                sizes.append(np.array([len(x) for x in each]))
                flat += each
        return np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.uint32), *flat])

    @staticmethod
    def _cut(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(begin, end, kind, first) of the pieces; kind 0: as it is, 1: after a space, 2: after a line end."""
        cut = np.flatnonzero((raw == 32) | (raw == 10))
        begin, end = np.empty(len(cut) + len(off) - 1, np.int64), np.empty(len(cut) + len(off) - 1, np.int64)
        first = np.searchsorted(cut, off) + np.arange(len(off))
        heads = np.zeros(len(begin), bool)
        heads[first[:-1]] = True
        begin[np.flatnonzero(~heads)], begin[first[:-1]] = cut + 1, off[:-1]
        tails = np.zeros(len(begin), bool)
        tails[first[1:] - 1] = True
        end[np.flatnonzero(~tails)], end[first[1:] - 1] = cut, off[1:]
        kind = np.where(heads, 0, np.where(raw[np.maximum(begin - 1, 0)] == 10, 2, 1)) if len(raw) else np.zeros(len(begin), np.int64)
        # Marks behind an ASCII letter or digit are pieces of their own.
        stem, least = end.copy(), begin + 1
        for _ in range(3):
            stem = np.where((stem > least) & MARKS[raw[np.maximum(stem - 1, 0)]], stem - 1, stem) if len(raw) else stem
        splits = (stem < end) & ALNUM[raw[np.maximum(stem - 1, 0)]] if len(raw) else np.zeros(len(begin), bool)
        at = np.arange(len(begin)) + np.cumsum(splits) - splits
        n = len(begin) + int(splits.sum())
        b, e, k = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
        b[at], e[at], k[at] = begin, np.where(splits, stem, end), kind
        more = np.flatnonzero(splits)
        b[at[more] + 1], e[at[more] + 1] = stem[more], end[more]
        return b, e, k, np.append(at, n)[first]

    def _distinct(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, ...]:
        """(which, sizes, first, ids): the distinct piece of each piece, and the ids of the distinct ones."""
        names, distinct = tb.named(raw, begin, end)
        own, which = np.unique(2 * names + spaced, return_inverse=True)
        led = (own & 1).astype(bool)
        texts = distinct.take(pa.array(own >> 1))
        hashes = tb.mix(tb.span_hashes(*tb.bytes_of(distinct))[own >> 1] + led)
        place = self._known(hashes, texts, led)
        known = place >= 0
        sizes = np.zeros(len(own), np.int64)
        sizes[known] = self.size[place[known]]
        new = np.flatnonzero(~known)
        plain = texts.take(pa.array(new)).to_pylist()
        fits = np.array([x.split() == [x] for x in plain], bool)
        found, ids = self._pieces([f" {x}" if y else x for x, y, z in zip(plain, led[new].tolist(), fits.tolist(), strict=True) if z])
        sizes[new] = -1
        sizes[new[fits]] = found
        # Ids of the distinct pieces, kept and new, in one array.
        first = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        flat = np.empty(first[-1], np.uint32)
        from_new = np.repeat(~known, np.maximum(sizes, 0))
        flat[np.flatnonzero(from_new)] = ids
        k = np.flatnonzero(known & (sizes > 0))
        flat[np.flatnonzero(~from_new)] = self.flat[_ranges(self.first[place[k]], sizes[k])]
        if len(self.piece) < REMEMBERED and len(new):
            self._keep(hashes[new], texts.take(pa.array(new)), led[new], sizes[new], ids)
        return which.ravel(), sizes, first, flat

    def _known(self, hashes: np.ndarray, texts: pa.StringArray, spaced: np.ndarray) -> np.ndarray:
        """The kept piece of each text, -1 for none; of kept pieces that share a hash only the first is found."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            some = np.flatnonzero(self.hashes[at] == hashes)
            piece = self.piece[at[some]]
            same = pc.equal(self.texts.take(pa.array(piece)), texts.take(pa.array(some))).to_numpy(zero_copy_only=False) & (self.spaced[piece] == spaced[some])
            out[some[same]] = piece[same]
        return out

    def _keep(self, hashes: np.ndarray, texts: pa.StringArray, spaced: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        start = len(self.flat) + np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        self.texts, self.spaced = pa.concat_arrays([self.texts, texts]), np.concatenate([self.spaced, spaced])
        self.first, self.size, self.flat = np.concatenate([self.first, start], dtype=np.int32, casting="same_kind"), np.concatenate([self.size, sizes], dtype=np.int32, casting="same_kind"), np.concatenate([self.flat, ids])
        number = np.concatenate([self.piece, np.arange(len(self.piece), len(self.piece) + len(hashes))], dtype=np.int32, casting="same_kind")
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.piece = both[order], number[order]

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text i are ids[first[i] : first[i + 1]]."""
        if not self.cuts:
            ids = self._whole([raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        begin, end, kind, piece = self._cut(raw, off)
        which, sizes, first, flat = self._distinct(raw, begin, end, kind == 1)
        empty = np.flatnonzero(np.diff(off) == 0)
        size = sizes[which]
        size[piece[empty]] = 0  # the one piece of an empty text
        odd = np.add.reduceat(size < 0, piece[:-1]) > 0 if len(piece) > 1 else np.zeros(0, bool)
        size = np.maximum(size, 0)
        line = kind == 2
        total = size + line * len(self.line)
        place = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(place[-1], np.uint32)
        out[_ranges(place[:-1] + line * len(self.line), size)] = flat[_ranges(first[which], size)]
        at = place[:-1][line]
        for k, x in enumerate(self.line):
            out[at + k] = x
        bounds = place[piece]
        if not odd.any():
            return out, bounds
        again = np.flatnonzero(odd)
        texts = self._whole([raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in again])
        parts = {k: x for k, x in zip(again.tolist(), texts, strict=True)}
        each = [parts[k] if k in parts else out[bounds[k] : bounds[k + 1]] for k in range(len(off) - 1)]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def _may_cut(file: dict) -> bool:
    """Whether pieces can be encoded apart: byte-level BPE without a normalizer, and added tokens that no cut goes through."""
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("dropout") and file["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def whole(token: dict) -> bool:
        text = token["content"].encode()
        cut = any(c in b" \n" for c in text) or any(ALNUM[a] and MARKS[b] for a, b in zip(text, text[1:], strict=False)) or (text[:1] and MARKS[text[0]]) or (text[-1:] and ALNUM[text[-1]])
        return not (cut or token["lstrip"] or token["rstrip"] or token["single_word"])

    return plain and all(whole(t) for t in file["added_tokens"])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... with size[i] members, one range after another."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _packer(path: str | None, end: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, names = np.concatenate(ids), pa.concat_arrays(docs)
            file = pack(tokens, names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False), np.concatenate(lengths), max(encode.levels, end.bit_length()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([file], pa.binary())], ["range", "shard", "n_tokens", "file"])

        for batch in batches:
            at = 0
            for raw, off in tb.blocks(batch.column(1), BLOCK):
                found, first = encode(raw, off)
                n = len(off) - 1
                tokens = np.insert(found, first[1:], end).astype(np.uint32)
                ends = first + np.arange(n + 1)
                k = 0
                while k < n:  # whole documents, at least one
                    m = max(k + (size == 0), int(np.searchsorted(ends, ends[k] + shard_tokens - size, "right")) - 1)
                    if m > k:
                        ids.append(tokens[ends[k] : ends[m]])
                        docs.append(batch.column(0).slice(at + k, m - k))
                        lengths.append(np.diff(ends[k : m + 1]))
                        size += int(ends[m] - ends[k])
                    if m < n:
                        yield flush()
                        ids, docs, lengths, size, shard = [], [], [], 0, shard + 1
                    k = m
                at += n
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of every text of ``docs`` (doc_id, text), each with the id ``end`` after it, as shards to ``path``.

    tokenizer: path of a file of the tokenizers library on the executors; None: byte_bpe_50k.json.  A null text is
    empty; a very long one is encoded whole and makes a shard of its own, so it must fit into a task (about ten times its bytes); rows with a null doc_id come first; rows of one doc_id stand in the order of their texts' hashes; repeated rows are
    all written; other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        rows.mapInArrow(_packer(tokenizer, end, shard_tokens), _FILES).write.option("compression", "uncompressed").parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            shard = Shard(batch.column(2)[r].as_py())
            ids, lengths = shard.tokens.decode().astype("<u4"), shard.lengths
            first = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column(k)[r].as_py(), np.int32)) for k in range(2)] + [pa.array(shard.doc_ids, mask=shard.nulls), pa.array(first[:-1]), pa.array(lengths), pa.array(crc, pa.int64())],
                ["range", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_shards(spark, path: str) -> DataFrame:
    """One row per document of the shards at ``path``: doc_id, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.schema(_FILES).parquet(path)
    ordered = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("range", "shard", "n_tokens").withColumn("in_range", F.coalesce(F.sum("n_tokens").over(ordered), F.lit(0)))
    ranges = files.groupBy("range").agg(F.sum("n_tokens").alias("all"))  # one row per range
    ranges = ranges.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = shards.join(ranges, "range").select("range", "shard", (F.col("in_range") + F.col("before")).alias("from"))
    rows = files.select("range", "shard", "file").mapInArrow(_digests, "range int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["range", "shard"]).select("doc_id", (F.col("from") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards of ``docs`` to a new place in the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer)
    return read_shards(docs.sparkSession, path)


def op2_token_files(spark, sf_dir) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
