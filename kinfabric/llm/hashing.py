"""Vectorised hashes of words and byte strings (numpy, 64 bits).

All hashes are fixed functions of the bytes, so every worker, run and machine agrees.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
#: Bytes hashed at a time; it bounds the memory that a very long text takes.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def byte_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U64) * U64(_BASE) + U64(seed * 2 + 1)) | U64(1)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i below n."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base & (2**64 - 1), U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def _room(n: int) -> int:
    return max(1 << 16, 1 << int(n).bit_length())


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _hash_words(buf: np.ndarray, seed: int) -> np.ndarray:
    solid = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(_room(len(buf) + 1))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(byte_table(seed)[buf] * up[: len(buf)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(data: bytes, seed: int = 0) -> np.ndarray:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, in order."""
    if len(data) <= CHUNK:
        return _hash_words(np.frombuffer(data, np.uint8), seed) if data else np.zeros(0, U64)
    out, at, view = [], 0, np.frombuffer(data, np.uint8)
    while at < len(view):
        end = min(len(view), at + CHUNK)
        while end < len(view) and not _SPACE[view[end]]:
            step = np.flatnonzero(_SPACE[view[end : end + CHUNK]])
            end += int(step[0]) if len(step) else len(view[end : end + CHUNK])
        out.append(_hash_words(view[at:end], seed))
        at = end
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of n consecutive words."""
    if len(words) < n:
        return np.zeros(0, U64)
    base = U64((_BASE + 2 * seed) & (2**64 - 1)) | U64(1)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, U64)
        for i in range(n):
            out = out * base + words[i : len(words) - n + 1 + i]
        return mix(out + U64(seed))


def window_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """As :func:`gram_hashes` by running sums, for long windows."""
    if len(words) < n:
        return np.zeros(0, U64)
    up, down = powers(_room(len(words) + 1))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(mix(words + U64(seed)) * up[: len(words)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def byte_windows(buf: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for each n-byte string of ``buf``."""
    if len(buf) < n:
        return np.zeros(0, U64)
    up, down = powers(_room(len(buf) + 1))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(byte_table(seed)[buf] * up[: len(buf)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(buf) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values, by doubling."""
    if len(x) < n:
        return x[:0]
    size, low = 1, x
    while size * 2 <= n:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return low if size == n else np.minimum(low[: len(x) - n + 1], low[n - size : n - size + len(x) - n + 1])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the intervals [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
