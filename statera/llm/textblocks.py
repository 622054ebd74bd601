"""Whole texts as flat byte blocks inside Arrow tasks, and vectorised hashes of their words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def keep_pages() -> None:
    """Let malloc keep the pages of arrays that are freed, up to some hundred megabytes, for those that follow.

    Tasks here make and drop arrays of megabytes all the time; by default each is mapped anew and its pages are faulted
    in one by one.  Another C library than glibc may not know the call; nothing depends on it.
    """
    mmap_threshold, trim_threshold = -3, -1  # names of parameters in malloc.h
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(mmap_threshold, 32 << 20)
        mallopt(trim_threshold, 256 << 20)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> np.ndarray:
    """The first n powers of the multiplier, modulo 2^64."""
    steps = np.full(n, _MULT, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values with about ``limit`` bytes; a longer value is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all values in order, and the n + 1 offsets of each value's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~IS_SPACE[data]
    edge = inside[1:] != inside[:-1]  # edge[i]: a word starts or ends before byte i
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first[n] = False
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | np.append(first[1:-1], True)))
    # a word's hash is a sum of codes of its bytes and their places in it, which no pattern of bytes makes equal
    at = np.zeros(n, np.int64)
    at[starts] = starts
    place = np.arange(n) - np.maximum.accumulate(at)
    total = np.zeros(n + 1, np.uint64)
    codes = (LOWER[data] if lower else data).astype(np.uint64) + (place.astype(np.uint64) << _U(8))
    np.cumsum(mix((codes + _U(1)) * _U(_MULT)), out=total[1:])
    words = mix(total[ends + 1] - total[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; the whole sequence where it is shorter; none without words."""
    if not len(words):
        return words
    k = min(width, len(words))
    steps = powers(k + 1)
    out = words[: len(words) - k + 1] * steps[1]
    for j in range(1, k):
        out = out + words[j : len(words) - k + 1 + j] * steps[j + 1]
    return mix(out + _U(k))


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = flat(column)
    for lo, hi in blocks(offsets):
        part = offsets[lo : hi + 1]
        words, at = word_hashes(data[part[0] : part[-1]], part - part[0])
        for k in range(hi - lo):
            yield np.unique(shingle_hashes(words[at[k] : at[k + 1]], width))
