"""Vectorised views of text columns: words, exact names and hashes of byte spans over Arrow buffers.

Kernels see a column in blocks of whole texts (about ``BLOCK`` bytes, never a cut text), so their
working memory follows the block and not the Arrow batch.  A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 21
#: The same for kernels that hold many arrays of the size of a block.
SMALL = 1 << 19
#: Spans of more bytes are hashed one by one.
LONG = 512

#: White space that ends a word: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What ends a word once A-Z are lower-cased: [\x00-\x2F\x3A-\x60\x7B-\x7F].
NON_WORD = np.zeros(256, bool)
NON_WORD[:0x80] = True
NON_WORD[0x30:0x3A] = False
NON_WORD[0x61:0x7B] = False
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: The k lowest bytes of eight.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    return column.fill_null("") if column.null_count else column


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of successive whole texts; offsets start at 0 and have one entry more than texts."""
    column = flat(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_spans(ends_word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of words; words first[i]:first[i + 1] belong to text i."""
    n = len(ends_word)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~ends_word
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~inside))
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (multiply and xor-shift); a one-to-one function."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def named(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """(names, distinct) of ascending spans that don't overlap: equal names for equal bytes and only for these; distinct[name] has the bytes."""
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, starts, np.int8(1))
    np.subtract.at(edge, ends, np.int8(1))
    data = np.compress(np.cumsum(edge[:-1], dtype=np.int8) != 0, raw)
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def bytes_of(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a column without nulls."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off[:-1], off[1:]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, the same in every block: eight bytes a step, each mixed into all bits; XXH3 for long spans."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + _BASE)
    eights = np.ndarray(len(raw) + 1, np.dtype("<u8"), np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    live, step = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - step
        out[live] = mix((out[live] * _BASE) ^ (eights[starts[live] + step] & _LOWEST[np.minimum(left, 8)]))
        live, step = live[left > 8], step + 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].tobytes())
    return out


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 of 128 bits of the spans, as two longs."""
    text, digest = raw.tobytes(), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(text[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, from 0 to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        for k, base in ((0, _BASE), (1, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Rolling (polynomial) hashes of all windows of the width.  They only choose places: unlike windows may share one, by structure from 1,024 bytes on."""
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: len(raw) - width + 1])


def spread(first: np.ndarray) -> np.ndarray:
    """For items first[i]:first[i + 1] of owner i: the owner of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask over n places of those inside any window of the length that starts at one of ``at``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1) if len(at) < 64 else edge.__iadd__(np.bincount(at, minlength=n + 1)[: n + 1].astype(np.int32))
    np.subtract.at(edge, at + length, 1) if len(at) < 64 else edge.__isub__(np.bincount(at + length, minlength=n + 1)[: n + 1].astype(np.int32))
    return np.cumsum(edge[:n]) > 0


def sums(mask_or_values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each owner's items."""
    total = np.zeros(len(mask_or_values) + 1, np.int64)
    np.cumsum(mask_or_values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [a, b) in order, those that overlap or touch joined."""
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), a[1:] > reach[:-1]]))
    return a[head], reach[np.append(head[1:], len(a)) - 1] if len(a) else reach
