"""Vectorised hashing of words and word n-grams straight from Arrow's UTF-8 buffers (numpy, no per-word Python).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. The hash of a word is a
polynomial in 64 bits over random byte values, taken from prefix sums; n-gram hashes mix the hashes of n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
CHUNK = 1 << 18


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64 bits; another salt gives another order of the same hashes."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK * 2)
        for k, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls, offsets counted from the first byte of the bytes given."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK bytes, so that arrays of a run stay in the cache; a long row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


PLAIN = _WHITE.copy()  #: ASCII punctuation parts words as well
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_hashes(offsets: np.ndarray, raw: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word, and for each row the index of its first word (rows + 1 entries)."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    solid = ~white[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts]), starts, stops, np.searchsorted(starts, offsets)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on (those that run over the end of a row are the caller's to skip)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m] * _STEP[0]
    for k in range(1, n):
        h += words[k : k + m] * _STEP[k]
    return mix(h, 7)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row (its index, its sorted distinct n-word shingles); fewer words than n make one shingle, none none."""
    offsets, raw = buffers(column)
    for i, j in pieces(offsets):
        own = offsets[i : j + 1] - offsets[i]
        words, _, _, first = word_hashes(own, raw[offsets[i] : offsets[j]])
        grams = ngrams(words, n)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= n:
                yield i + r, np.unique(grams[a : b - n + 1])
            elif b > a:
                few = words[a:b]
                yield i + r, mix(np.array([(few * _STEP[: b - a]).sum(dtype=np.uint64)]), 100 + int(b - a))
            else:
                yield i + r, np.zeros(0, np.uint64)
