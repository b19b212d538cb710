"""Words, word hashes and shingles of many texts at once, as numpy operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from eventloom.llm.common import utf8

#: Bytes of text that one block of array operations takes (a longer text is a block of its own).
BLOCK_BYTES = 2 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_R = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> _R
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of runs of rows with about `size` bytes."""
    data, starts = utf8(column)
    n, low = len(starts) - 1, 0
    while low < n:
        high = min(low + BLOCK_ROWS, max(low + 1, int(np.searchsorted(starts, starts[low] + size, "right")) - 1))
        yield low, high, data[starts[low] : starts[high]], starts[low : high + 1] - starts[low]
        low = high


def words(data: np.ndarray, starts: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run of bytes that aren't spaces (or what else stands `apart`) begins and ends, and for each text the index of its first word (one more for the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    body = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = body.copy()
    first[1:] &= ~body[:-1] | edge[1:n]
    last = body
    last[:-1] &= ~body[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes a step."""
    out = np.full(len(begin), _C, np.uint64)
    if not len(begin):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    left, at, rows = end - begin, begin, None
    while True:
        now = eight[at] & _MASK[np.minimum(left, 8)]
        if rows is None:
            out = mix(out ^ now)
        else:
            out[rows] = mix(out[rows] ^ now)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        rows = more if rows is None else rows[more]
        left, at = left[more] - 8, at[more] + 8
    return mix(out ^ (end - begin).astype(np.uint64))


def windows(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside each text in order, a shorter text as one; and the text of each."""
    counts = np.diff(first)
    factors = [int(_C)]
    for _ in range(width - 1):
        factors.append((factors[-1] * int(_A) + 0x632BE5AB) & 0xFFFFFFFFFFFFFFFF | 1)
    n = max(0, len(word) - width + 1)
    total = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    for k, factor in enumerate(factors):
        total += word[k : k + n] * np.uint64(factor)
        if k:  # the last words of a text begin no window
            late = first[1:] - k
            inside[late[(late >= 0) & (late < n)]] = False
    total = mix(total[inside] ^ np.uint64(width))
    owner = np.repeat(np.arange(len(counts)), np.maximum(0, counts - width + 1))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        single = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            there = counts[short] > k
            single[there] += word[first[short[there]] + k] * np.uint64(factors[k])
        at = np.searchsorted(owner, short)
        total = np.insert(total, at, mix(single ^ counts[short].astype(np.uint64)))
        owner = np.insert(owner, at, short)
    return total, owner


#: A shingle hash has 52 bits: with the row (of at most BLOCK_ROWS) above them, one sort of 64-bit numbers orders rows and shingles.
BITS, BLOCK_ROWS = 52, 4096
_LOW = np.uint64((1 << BITS) - 1)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, where those of each row start) for blocks of rows: words lower-cased in A-Z."""
    for low, high, data, starts in blocks(column):
        data = LOWER[data]
        begin, end, first = words(data, starts)
        found, owner = windows(hashes(data, begin, end), first, width)
        found >>= np.uint64(64 - BITS)
        found |= owner.astype(np.uint64) << np.uint64(BITS)
        found.sort()
        if len(found):
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            found = found[keep]
        at = np.searchsorted(found, np.arange(high - low + 1, dtype=np.uint64) << np.uint64(BITS)) if high - low < BLOCK_ROWS else np.append(np.searchsorted(found, np.arange(high - low, dtype=np.uint64) << np.uint64(BITS)), len(found))
        found &= _LOW
        yield low, found, at
