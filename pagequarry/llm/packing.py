"""Best-fit packing of tokenised documents into sequences, by vectors of capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths).
What a piece takes of each follows from its length alone, so the whole corpus is described by one count
per length, at most ``capacity`` numbers whatever its size. The packer places those counts, longest
first: open sequences in the same state form one group, a group is chosen by its residual vector
under every constraint, and each group takes one piece per sequence. Every step splits one group
at most, so the plan has a few rows a length. Spark then gives each piece its rank among the pieces of its
length, and the rank says where it goes. No piece passes through the driver; each carries its ids to its place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .bpe import bpe

CAPACITY = 1024
END_ID = 2
BROADCAST_ROWS = 500_000


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first_rank, n, first_sequence, offset)``: the n pieces of this length from that
    rank on go to that many sequences in a row, each at that offset.

    ``rule``: ``norm`` takes the group left with the smallest weighted residual norm, ``dot`` the one
    whose residual has the smallest weighted dot product with the piece (the tightest along what it needs).
    """
    limit = np.array([capacity, max_docs, max_attention], dtype=float)
    w = np.array(weights)
    groups: list[list] = []  # residual tokens, documents, attention; number of sequences; [(length, rank, offset)]
    done: list[tuple[int, list]] = []
    for length in sorted(counts, reverse=True):
        if length > capacity or length * length > max_attention or max_docs < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], dtype=float)
        while left:
            state = np.array([g[0] for g in groups], dtype=float).reshape(-1, 3)
            fits = np.flatnonzero((state >= need).all(1))
            if len(fits):
                rest = (state[fits] - need) / limit
                score = (w * rest * rest).sum(1) if rule == "norm" else (w * (state[fits] / limit) * (need / limit)).sum(1)
                k = int(fits[score.argmin()])
                residual, n, held = groups[k]
                take = min(n, left)
                if take < n:
                    groups.append([residual, n - take, _cut(held, take)])
                groups[k] = [tuple(np.array(residual) - need), take, [*held, (length, rank, capacity - int(residual[0]))]]
            else:
                take = left if 2 * length > capacity else max(1, left // max(1, min(capacity // length, max_docs, max_attention // length**2)))
                groups.append([tuple(limit - need), take, [(length, rank, 0)]])
            left, rank = left - take, rank + take
        full = [g for g in groups if g[0][0] < 1 or g[0][1] < 1 or g[0][2] < 1]
        groups = [g for g in groups if not (g[0][0] < 1 or g[0][1] < 1 or g[0][2] < 1)]
        done += [(n, held) for _, n, held in full]
    out, at = [], 0
    for n, held in [*done, *[(n, held) for _, n, held in groups]]:
        out += [(length, rank, n, at, offset) for length, rank, offset in held]
        at += n
    return sorted(out)


def _cut(held: list, skip: int) -> list:
    return [(length, rank + skip, offset) for length, rank, offset in held]


PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Each document's ids (and the end id), whole if they fit, else cut into pieces of ``capacity``, the
    first shorter. ``rank`` counts the pieces of a length within the task ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen: dict[int, int] = defaultdict(int)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for own in common.slices(batch, "text"):
                rows = []
                for doc_id, ids in zip(own.column(0).to_pylist(), coder.encode_batch(own.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n else []
                    for k, (a, b) in enumerate(pairwise(cuts)):
                        rows.append((doc_id, k, a, b - a, ids[4 * a : 4 * b], part, seen[b - a]))
                        seen[b - a] += 1
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return common.plain(docs, "doc_id", "text").mapInArrow(run, PIECES)


_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    max_docs: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    end_id: int | None = END_ID,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``; ``ids`` are the
    piece's tokens, four bytes each, little-endian, so a sequence is its pieces' ids in order of offset.

    Sequences hold at most ``capacity`` tokens, ``max_docs`` pieces (default: capacity) and an attention
    cost of ``max_attention`` (default: capacity squared, that of one full piece). Null and empty texts are
    the end id alone; without an end id they give no row. Repeated rows are packed as often as they
    occur; a null id stays null. Equal lengths are interchangeable: which of them goes where follows from
    the order of the scan. An empty table gives an empty result. Other columns are ignored.
    The ids are written once with their pieces and not shuffled while there are at most ``BROADCAST_ROWS``
    pairs of a length and a task; beyond that they go through one shuffle.
    """
    spark = docs.sparkSession
    max_docs, max_attention = max_docs or capacity, max_attention or capacity * capacity
    found = common.kept(pieces(docs, capacity, end_id, tokenizer), "pieces")
    per_part = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    lengths = per_part.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()  # at most `capacity` rows
    rows = plan({r.length: r.n for r in lengths}, capacity, max_docs, max_attention, rule)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    held = F.broadcast(base) if sum(r.parts for r in lengths) <= BROADCAST_ROWS else base
    ranked = found.join(held, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    table = spark.createDataFrame(rows, "length long, first_rank long, n long, first_sequence long, offset long")
    shift = F.col("rank") - F.col("first_rank")
    # a few thousand rows whatever the input; of a length's rows one holds the rank
    placed = ranked.join(F.broadcast(table), "length").filter((shift >= 0) & (shift < F.col("n")))
    return placed.withColumns({"ids_crc32": F.crc32("ids"), "sequence_id": F.col("first_sequence") + shift}).select(*RESULT)


RESULT = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
