"""Counting quotient filters that lose nothing: compact sorted counters of packed n-grams.

An n-gram of word ids of ``width`` bits is a number of ``n * width`` bits, kept in two halves.
An invertible permutation spreads the numbers evenly. The top bits of a permuted number, its
quotient, are only marked in a bit string; the rest, its full remainder, is stored beside
the count. So equal entries are equal n-grams, a filter gives its n-grams back, and two
filters merge in one pass, as both are sorted.
"""

from __future__ import annotations

import numpy as np

from newsward.llm.words import mix

ROUNDS = tuple(int(x) for x in np.random.default_rng(31).integers(1, 1 << 62, 4))
# Counts from here on are written in full behind the others, which take a byte each.
LARGE = 255
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # left, right, counts; sorted by left, then right


def half_bits(n: int, width: int) -> tuple[int, int]:
    return (n - n // 2) * width, n // 2 * width


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def packed(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of n-grams, given the ids of their first, second, ... words."""
    middle = len(ids) - len(ids) // 2
    halves = []
    for part in (ids[:middle], ids[middle:]):
        total = np.zeros(len(ids[0]), np.uint64)
        for own in part:
            total = (total << np.uint64(width)) | own.astype(np.uint64)
        halves.append(total)
    return halves[0], halves[1]


def unpacked(left: np.ndarray, right: np.ndarray, n: int, width: int) -> np.ndarray:
    """Ids of n-grams, a row each."""
    out = np.empty((len(left), n), np.int64)
    middle = n - n // 2
    for half, low, high in ((left, 0, middle), (right, middle, n)):
        rest = half.copy()
        for k in range(high - 1, low - 1, -1):
            out[:, k] = (rest & _mask(width)).astype(np.int64)
            rest = rest >> np.uint64(width)
    return out


def permuted(left: np.ndarray, right: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each round changes one half by a hash of the other, so it can be undone."""
    lefts, rights = map(_mask, half_bits(n, width))
    with np.errstate(over="ignore"):
        for k, key in enumerate(ROUNDS):
            if k % 2 == 0:
                left = left ^ (mix(right + np.uint64(key)) & lefts)
            else:
                right = right ^ (mix(left + np.uint64(key)) & rights)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    lefts, rights = map(_mask, half_bits(n, width))
    with np.errstate(over="ignore"):
        for k, key in reversed(list(enumerate(ROUNDS))):
            if k % 2 == 0:
                left = left ^ (mix(right + np.uint64(key)) & lefts)
            else:
                right = right ^ (mix(left + np.uint64(key)) & rights)
    return left, right


def _summed(arrays: list[np.ndarray], n: int, width: int) -> Entries:
    """Sorted entries with the counts of equal ones summed. ``arrays`` holds the lefts, rights and
    counts and is emptied on the way, so that no array stays beside its sorted copy."""
    counts, right, left = arrays.pop(), arrays.pop(), arrays.pop()
    if len(left) == 0:
        return left, right, counts
    bits = half_bits(n, width)
    if sum(bits) <= 64:
        whole = (left << np.uint64(bits[1])) | right
        del left, right
        order = np.argsort(whole, kind="stable")
        whole = whole[order]
        counts = counts[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        whole = whole[first]
        return whole >> np.uint64(bits[1]), whole & _mask(bits[1]), np.add.reduceat(counts, first)
    order = np.lexsort((right, left))
    left = left[order]
    right = right[order]
    counts = counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return left[first], right[first], np.add.reduceat(counts, first)


def counted(left: np.ndarray, right: np.ndarray, counts: np.ndarray, n: int, width: int) -> Entries:
    """Sorted entries with the counts of equal ones summed."""
    return _summed([left, right, counts], n, width)


def merged(parts: list[Entries], n: int, width: int) -> Entries:
    """One filter of several. The list is emptied: parts and result need not fit together."""
    arrays = [np.concatenate([part[k] for part in parts]) for k in range(3)]
    parts.clear()
    return _summed(arrays, n, width)


def _to_bytes(numbers: np.ndarray, size: int) -> bytes:
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _from_bytes(raw: memoryview, count: int, size: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(count, size)
    return out.view("<u8").reshape(count).astype(np.uint64)


def shard_of(left: np.ndarray, n: int, width: int, shard_bits: int) -> np.ndarray:
    bits = half_bits(n, width)[0]
    used = min(shard_bits, bits)
    return (left >> np.uint64(bits - used)).astype(np.int64) if used else np.zeros(len(left), np.int64)


def encoded(entries: Entries, n: int, width: int, shard_bits: int) -> bytes:
    """One shard's filter. The quotient is the shard and about as many further bits as
    give one slot per entry; for each entry a 1 and for each quotient a 0 is written, in order."""
    left, right, counts = entries
    bits, right_bits = half_bits(n, width)
    rest = bits - min(shard_bits, bits)
    marked = min(max(len(left).bit_length() - 1, 0), rest)
    quotient = ((left >> np.uint64(rest - marked)) & _mask(marked)).astype(np.int64) if marked else np.zeros(len(left), np.int64)
    marks = np.zeros(len(left) + (1 << marked), np.uint8)
    marks[np.arange(len(left)) + quotient] = 1
    remainder = left & _mask(rest - marked)
    large = counts >= LARGE
    head = np.array([len(left), marked, int(left[0] >> np.uint64(rest)) if rest < 64 else 0], "<i8")
    small = np.where(large, LARGE, counts).astype(np.uint8)
    sizes = [-(-(rest - marked) // 8), -(-right_bits // 8)]
    return b"".join([head.tobytes(), np.packbits(marks).tobytes(), _to_bytes(remainder, sizes[0]), _to_bytes(right, sizes[1]), small.tobytes(), counts[large].astype("<i8").tobytes()])


def decoded(raw: bytes, n: int, width: int, shard_bits: int) -> Entries:
    count, marked, shard = (int(x) for x in np.frombuffer(raw, "<i8", 3))
    bits, right_bits = half_bits(n, width)
    rest = bits - min(shard_bits, bits)
    view, at = memoryview(raw), 24
    size = -(-(count + (1 << marked)) // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(view[at : at + size], np.uint8), count=count + (1 << marked)))
    at += size
    quotient = (ones - np.arange(count)).astype(np.uint64)
    halves = []
    for size in (-(-(rest - marked) // 8), -(-right_bits // 8)):
        halves.append(_from_bytes(view[at : at + count * size], count, size))
        at += count * size
    left = halves[0] | (quotient << np.uint64(rest - marked)) if marked else halves[0]
    if rest < 64:
        left = left | (np.uint64(shard) << np.uint64(rest))
    counts = np.frombuffer(view[at : at + count], np.uint8).astype(np.int64)
    counts[counts == LARGE] = np.frombuffer(view[at + count :], "<i8")
    return left, halves[1], counts
