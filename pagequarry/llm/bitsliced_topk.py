"""Exact top-k search by inner product over a bit-sliced index.

Each component of a block's vectors is quantised and stored as slices: bitmap i of an attribute has a
bit per row, bit i of the row's value. A query adds the slices, shifted by the digits of its own components,
with carry-save bitmap adders, so that the sums of all rows stand in slices too. The top rows then come out from the
most significant slice downward, and ties at the boundary are settled by id.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame

from . import grid

SCALE = 1024
#: Up to this magnitude components are scaled as 64-bit integers, beyond it as Python's.
WIDE = 2.0**50


def quantise(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    if not vectors.size or np.abs(vectors).max() < WIDE:
        return np.floor(scale * vectors).astype(np.int64)
    exact = [[math.floor(scale * x) if abs(x) < WIDE else scale * int(x) for x in row] for row in vectors.tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


class BitSlices:
    """A block of rows as slices. Values are stored above the attribute's minimum, so none is negative."""

    def __init__(self, values: np.ndarray):
        rows, dims = values.shape
        self.rows, self.words = rows, -(-rows // 64)
        self.low = values.min(0)
        above = values - self.low
        self.bits = [int(b).bit_length() for b in above.max(0)]
        self.top = np.array([(1 << b) - 1 for b in self.bits], dtype=object)
        self.slices = [[self._pack((above[:, d] >> i) & 1) for i in range(b)] for d, b in enumerate(self.bits)]
        self.inverse = [[~s for s in own] for own in self.slices]
        self.all = self._pack(np.ones(rows, np.uint64))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.concatenate([packed, np.zeros(self.words * 8 - len(packed), np.uint8)]).view(np.uint64)

    def weighted(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum of weight times value, and the constant to add. A negative digit adds the
        inverted slices: -v = (top - v) - top."""
        columns: dict[int, list[np.ndarray]] = defaultdict(list)
        constant = 0
        for d, w in enumerate(weights.tolist()):
            constant += w * int(self.low[d])
            for shift, sign in digits(w):
                for i, s in enumerate(self.slices[d] if sign > 0 else self.inverse[d]):
                    columns[i + shift].append(s)
                if sign < 0:
                    constant -= int(self.top[d]) << shift
        total: list[np.ndarray] = []
        for c in itertools.count():
            if c > max(columns, default=-1):
                break
            own = columns[c]
            while len(own) >= 3:
                x, y, z = own.pop(), own.pop(), own.pop()
                half = x ^ y
                columns[c + 1].append((x & y) | (half & z))
                own.insert(0, half ^ z)
            if len(own) == 2:
                columns[c + 1].append(own[0] & own[1])
                own = [own[0] ^ own[1]]
            total.append(own[0] if own else np.zeros(self.words, np.uint64))
        while total and not total[-1].any():
            total.pop()
        return total, constant

    def top_k(self, total: list[np.ndarray], k: int, out: int | None) -> np.ndarray:
        """Positions of the k largest sums, ties to the first rows; row ``out`` takes no part."""
        open_ = self.all.copy()
        if out is not None:
            open_[out // 64] &= ~(np.uint64(1) << np.uint64(out % 64))
        sure, n_sure = np.zeros(self.words, np.uint64), 0
        for s in reversed(total):
            ones = open_ & s
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n > k:
                open_ = ones
            else:
                sure, n_sure, open_ = sure | ones, n_sure + n, open_ & ~s
            if n_sure == k:
                return self.positions(sure)
        return np.concatenate([self.positions(sure), self.positions(open_)[: k - n_sure]])

    def sums(self, total: list[np.ndarray], constant: int, rows: np.ndarray) -> np.ndarray:
        """The sums of some rows, read off the slices."""
        place, bit = rows // 64, (rows % 64).astype(np.uint64)
        out = np.full(len(rows), constant, dtype=object)
        for i, s in enumerate(total):
            out += ((s[place] >> bit) & np.uint64(1)).astype(object) << i
        if any(not -(1 << 63) <= x < 1 << 63 for x in out.tolist()):
            raise OverflowError("a score doesn't fit a long")
        return out.astype(np.int64)

    def positions(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])


def digits(n: int) -> list[tuple[int, int]]:
    """Signed binary digits without two neighbours, as (place, sign)."""
    out, place = [], 0
    while n:
        if n & 1:
            sign = 2 - (n & 3)
            out.append((place, sign))
            n -= sign
        n >>= 1
        place += 1
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` (over ``vec_id``) holds for, the k rows with
    the largest integer inner product of components floor(scale * x), itself left out.

    All candidates come back where there are fewer than k. Ties go to the smaller id. Null vectors and
    those with null or non-finite components take no part, as queries or candidates; the same holds for null ids, empty vectors and
    vectors of another length than most. Components may be of any size; a score among the best that doesn't fit a long is an error. Rows that repeat an id are rows of their own: each takes part, as a
    query too, and only the row itself is left out of its candidates. An empty table gives an empty result.
    """

    def cell(own, queries, block):
        index = BitSlices(quantise(block, scale))
        found = []
        for i, weights in enumerate(quantise(queries, scale)):
            total, constant = index.weighted(weights)
            top = index.top_k(total, k, int(own[i]) if own[i] >= 0 else None)
            found.append((np.full(len(top), i), top, index.sums(total, constant, top)))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    rows = grid.usable(vectors, id_col, vec_col, nonzero=False)
    return grid.search(rows, grid.shape(rows, is_query), is_query, k, cell, "long")
