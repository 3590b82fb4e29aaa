"""Vectorised 64-bit hashes over byte buffers: of any substring in constant time, of words, of shingles.

A substring's hash is a difference of prefix sums of byte codes times powers of an odd number, scaled back to
its start; equal strings hash alike wherever they stand. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import functools

import numpy as np

BUFFER_BITS = 20
BUFFER = 1 << BUFFER_BITS
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=2)
def _tables(seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the 256 bytes, powers of the base and of its inverse."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)) | np.uint64(1)
    one = np.ones(BUFFER + 1, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return codes, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Substrings:
    """Hashes of substrings of one buffer of at most ``BUFFER`` bytes."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        codes, up, self.down = _tables(seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Of all substrings of this size, by start."""
        if len(self.sums) <= size:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words, A-Z in lower case, words parted by space and
    \\t to \\r; of the whole sequence if it is shorter; none without words."""
    raw = (text or "").encode().translate(_LOWER)
    words = np.concatenate([word_hashes(part) for part in _parts(raw)]) if raw else np.zeros(0, np.uint64)
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = (h * np.uint64(0xA24BAED4963EE407)) ^ words[k : n - width + 1 + k]
        h = mix(h)
    return np.unique(h)


def _parts(raw: bytes) -> list[bytes]:
    """A long text in parts that end between words."""
    if len(raw) <= BUFFER:
        return [raw]
    data, out, at = np.frombuffer(raw, np.uint8), [], 0
    while len(raw) - at > BUFFER:
        gaps = np.flatnonzero(_SPACE[data[at : at + BUFFER]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:  # one word longer than a buffer: it goes on its own, hashed by pieces
            later = np.flatnonzero(_SPACE[data[at:]])
            end = at + int(later[0]) + 1 if len(later) else len(raw)
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def word_hashes(raw: bytes) -> np.ndarray:
    if len(raw) > BUFFER:
        pieces = [Substrings(np.frombuffer(raw[i : i + BUFFER].rstrip(b" \t\n\v\f\r"), np.uint8)) for i in range(0, len(raw), BUFFER)]
        own = np.array([p.of(np.array([0]), np.array([len(p.sums) - 1]))[0] for p in pieces], np.uint64)
        return mix(np.array([functools.reduce(lambda a, b: (a * _BASE + int(b)) % (1 << 64), own, 7)], dtype=np.uint64))
    data = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return Substrings(data).of(edge[0::2], edge[1::2])
