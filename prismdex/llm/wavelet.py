"""A wavelet matrix over token ids: one compressed file of bit-planes with rank and select.

Plane k holds bit ``levels - 1 - k`` of every id; the next plane has the ids with 0 there first, then those with 1, both in order.
File: magic, a fixed header, sections.  Every section is a zstd frame of its own (document ids and their null marks, lengths,
then one of packed bits and one of rank counts per level), so a reader opens only the planes that it needs.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"PWMX0001"
#: Bits between two rank counts.
STEP = 512


class Plane:
    """Bits with rank and select."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray, n: int):
        self.packed, self.counts, self.n = packed, counts, n

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        n = len(bits)
        packed = np.zeros(-(-n // STEP) * (STEP // 8) or STEP // 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, STEP // 64).sum(1)
        counts = np.zeros(len(ones) + 1, np.uint32)
        np.cumsum(ones, out=counts[1:])
        return cls(packed, counts, n)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(np.int64)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place i."""
        i = np.asarray(i, np.int64)
        words = self.packed.view(np.uint64)
        block = i // STEP
        total = self.counts[block].astype(np.int64)
        for k in range(STEP // 64):  # whole words of the block, then the part of one
            word = block * (STEP // 64) + k
            left = np.clip(i - word * 64, 0, 64)
            mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            total += np.bitwise_count(words[np.minimum(word, len(words) - 1)] & np.where(left > 0, mask, np.uint64(0))).astype(np.int64)
        return total

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        ones = self.counts.astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * STEP - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        part = np.unpackbits(self.packed[block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little")
        return block * STEP + int(np.flatnonzero(part == bit)[k - before[block]])


class WaveletMatrix:
    def __init__(self, n: int, levels: int, zeros: list[int], plane):
        self.n, self.levels, self.zeros, self._plane, self._open = n, levels, zeros, plane, {}

    def plane(self, level: int) -> Plane:
        if level not in self._open:
            self._open[level] = self._plane(level)
        return self._open[level]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        levels = levels or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        v = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for k in range(levels):
            one = v & v.dtype.type(1 << (levels - 1 - k)) != 0
            planes.append(Plane.of(one))
            low = np.compress(~one, v)  # much faster than indexing by a mask
            zeros.append(len(low))
            v = np.concatenate([low, np.compress(one, v)])
        return cls(len(ids), levels, zeros, planes.__getitem__)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for k in reversed(range(self.levels)):
            one, z = self.plane(k).bits(), self.zeros[k]
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~one)] = v[:z]
            back[np.flatnonzero(one)] = v[z:] | kind(1 << (self.levels - 1 - k))
            v = back
        return v

    def access(self, i) -> np.ndarray:
        """The ids at places i."""
        i = np.atleast_1d(np.asarray(i, np.int64)).copy()
        out = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            plane = self.plane(k)
            bit, ones = plane.bit(i), plane.rank1(i)
            out = out << 1 | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return out

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self.plane(k).rank1(np.array([i, j]))
            i, j = (self.zeros[k] + int(a), self.zeros[k] + int(b)) if token >> (self.levels - 1 - k) & 1 else (i - int(a), j - int(b))
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences of the token in places i to j."""
        if not 0 <= token < 1 << self.levels:
            return 0
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of the token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self.plane(level).select(bit, at - (self.zeros[level] if bit else 0))
        return at


def pack(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, levels: int) -> bytes:
    """The file of one shard; the lengths of its documents add up to its ids."""
    matrix = WaveletMatrix.build(ids, levels)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    sections = [squeeze(np.ascontiguousarray(x).tobytes()) for x in (doc_ids.astype("<i8"), nulls.astype(np.uint8), lengths.astype("<i8"))]
    for k in range(levels):
        plane = matrix.plane(k)
        sections += [squeeze(plane.packed.tobytes()), squeeze(plane.counts.astype("<u4").tobytes())]
    header = struct.pack("<8sQQI", MAGIC, len(ids), len(doc_ids), levels) + np.array(matrix.zeros, "<u8").tobytes() + np.array([len(x) for x in sections], "<u8").tobytes()
    return header + b"".join(sections)


class Shard:
    """A packed file, opened; planes are decompressed when they are first used."""

    def __init__(self, packed: bytes):
        magic, n, docs, levels = struct.unpack_from("<8sQQI", packed)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = struct.calcsize("<8sQQI")
        zeros = np.frombuffer(packed, "<u8", levels, at).tolist()
        sizes = np.frombuffer(packed, "<u8", 3 + 2 * levels, at + 8 * levels)
        begin = at + 8 * (3 + 3 * levels) + np.concatenate([[0], np.cumsum(sizes).astype(np.int64)])
        section = lambda k: zstandard.ZstdDecompressor().decompress(packed[int(begin[k]) : int(begin[k + 1])])
        self.doc_ids, self.nulls, self.lengths = np.frombuffer(section(0), "<i8"), np.frombuffer(section(1), bool), np.frombuffer(section(2), "<i8")
        if len(self.doc_ids) != docs:
            raise ValueError("damaged shard")
        plane = lambda k: Plane(np.frombuffer(section(3 + 2 * k), np.uint8), np.frombuffer(section(4 + 2 * k), "<u4"), n)
        self.tokens = WaveletMatrix(n, levels, zeros, plane)
