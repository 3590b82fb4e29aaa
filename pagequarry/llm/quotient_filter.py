"""Counting quotient filters as bytes: numbers of a fixed width with their counts, without loss.

An invertible permutation scatters the numbers. Of a permuted number the upper bits (its quotient) are told by two bit vectors, which
quotients occur and where the run of each ends; the rest (its remainder) is stored in full. Entries are sorted, so filters merge like runs.
"""

from __future__ import annotations

import struct

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<IBBB")


def permuted(x: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the numbers of an even number of bits, at most 62."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    for odd in _ODD:
        x = (x * np.uint64(odd)) & mask
        x = x ^ (x >> half)
    return x


def restored(x: np.ndarray, bits: int) -> np.ndarray:
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    for odd in reversed(_ODD):
        x = x ^ (x >> half)
        x = (x * np.uint64(pow(odd, -1, 1 << bits))) & mask
    return x


def counted(numbers: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, sorted, with their counts added up."""
    if counts is None:
        numbers = np.sort(numbers)
    else:
        order = np.argsort(numbers, kind="stable")
        numbers, counts = numbers[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.zeros(0, np.int64)
    if counts is None:
        return numbers[first], np.diff(np.append(first, len(numbers)))
    return numbers[first], np.add.reduceat(counts, first) if len(first) else counts


def packed(numbers: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter of sorted distinct permuted numbers, below 2**bits, at least one."""
    n = len(numbers)
    width = max(0, -(-(bits - n.bit_length() + 1) // 8))
    quotient_bits = max(0, bits - 8 * width)
    quotients = (numbers >> np.uint64(8 * width)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    run_end = np.append(quotients[1:] != quotients[:-1], True)
    remainders = numbers.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    more = counts > 1
    small = np.minimum(counts[more], 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<i8")
    return b"".join([_HEAD.pack(n, bits, width, 0), *[np.packbits(x).tobytes() for x in (occupied, run_end, more)], remainders.tobytes(), small.tobytes(), large.tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, bits, width, _ = _HEAD.unpack_from(data)
    at = _HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    bit_vector = lambda size: np.unpackbits(take(-(-size // 8)), count=size).view(bool)
    occupied, run_end, more = bit_vector(1 << max(0, bits - 8 * width)), bit_vector(n), bit_vector(n)
    run = np.concatenate([[0], np.cumsum(run_end[:-1])])
    numbers = np.zeros((n, 8), np.uint8)
    numbers[:, :width] = take(n * width).reshape(n, width)
    numbers = numbers.view("<u8")[:, 0] | (np.flatnonzero(occupied)[run].astype(np.uint64) << np.uint64(8 * width))
    counts = np.ones(n, np.int64)
    counts[more] = take(int(more.sum()))
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=at)
    return numbers, counts


def merged(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all filters with the sums of their counts; runs are merged, not sorted anew."""
    parts = [unpacked(f) for f in filters]
    return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
