"""Words of Arrow text columns as 64-bit hashes, computed on the raw bytes with numpy.

A word is a run of bytes other than space and 0x09-0x0D, which in UTF-8 is the same as
the pattern ``[^\\x20\\x09-\\x0D]+`` on characters. No Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd, so that it has an inverse modulo 2**64 and prefix sums can be shifted to any word.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Bytes hashed at a time: bounds the memory of the intermediate arrays (about 60 bytes each).
CHUNK_BYTES = 1 << 18
# A text that this pattern finds something in has words.
WORD = r"[^\x20\x09-\x0D]"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# As LOWER, with ASCII punctuation and control characters as white space.
LETTERS = LOWER.copy()
LETTERS[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
# A fixed pseudo-random 64-bit number for each byte.
BYTE_CODES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that all output bits depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    count = len(column)
    if count == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    rows = np.frombuffer(offsets, kind)[column.offset : column.offset + count + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[rows[0] : rows[-1]], rows - rows[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first byte of every word."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    word = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    word[1:] &= ~word[:-1] | cut[1:-1]
    return np.flatnonzero(word)


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a row's end also ends a word."""
    word = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | cut[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(column: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, the first word of every row (one
    entry more than rows), and the bytes they are counted in, mapped by ``table``."""
    data, offsets = flat(column)
    if table is not None:
        data = table[data]
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data
    starts, ends = _bounds(data, offsets)
    hashes = np.empty(len(starts), np.uint64)
    at, count = 0, len(starts)
    with np.errstate(over="ignore"):
        while at < count:
            # As many words as fit the chunk; a longer word is a chunk of its own.
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
            low, high = starts[at], ends[stop - 1]
            codes = BYTE_CODES[data[low:high]]
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(codes * powers(BASE, len(codes)), out=sums[1:])
            first, last = starts[at:stop] - low, ends[at:stop] - low
            back = powers(INVERSE, int(first[-1]) + 1)
            hashes[at:stop] = (sums[last] - sums[first]) * back[first]
            at = stop
    return mix(hashes), starts, ends, np.searchsorted(starts, offsets), data


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` neighbouring hashes, in order; rows must be cut after."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        weights = powers(BASE, n)
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            total += hashes[k : k + len(total)] * weights[k]
        return mix(total)


def slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` of text each; a longer row stands alone."""
    _, offsets = flat(column)
    row, count = 0, len(offsets) - 1
    while row < count:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1)
        yield row, min(stop, count)
        row = min(stop, count)
