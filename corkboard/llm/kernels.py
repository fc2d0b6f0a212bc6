"""Vectorised hashing of words and n-grams over many texts at once."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_WEIGHTS = _stream(4096, 11)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than ASCII white space, A-Z lower-cased) and each row's bounds in them."""
    global _WEIGHTS
    n_rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]  # a row's first byte begins a word whatever the row before ends with
    begins[firsts] = inside[firsts]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    starts = np.flatnonzero(begins)
    rank = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(rank, len(at)))
    if lengths.max() > len(_WEIGHTS):
        _WEIGHTS = _stream(int(lengths.max()), 11)
    place = np.arange(len(at)) - np.repeat(rank, lengths)
    hashes = np.add.reduceat(_WEIGHTS[place] * (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)), rank)
    return mix(hashes + lengths.astype(np.uint64)), np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct word shingles as ascending 64-bit hashes, and the rows' bounds in them. A row of fewer than
    `width` words, but some, has its whole sequence as its one shingle."""
    h, bounds = words(data, offsets)
    counts = np.diff(bounds)
    n_rows = len(counts)
    factors = _stream(width, 77)
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        total += h[k : k + len(total)] * factors[k]
    total = mix(total)
    out, sizes = [], np.zeros(n_rows, np.int64)
    for i in range(n_rows):
        c = counts[i]
        if c >= width:
            own = np.sort(total[bounds[i] : bounds[i + 1] - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif c:
            part = h[bounds[i] : bounds[i + 1]]
            own = mix((part * factors[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def byte_grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket (of 2**bits) of each n-gram of bytes."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    total = np.full(len(data) - n + 1, n, np.uint32)
    for k in range(n):
        total *= np.uint32(0x01000193)
        total ^= data[k : k + len(total)]
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x2C1B3C6D)
    return total >> np.uint32(32 - bits)
