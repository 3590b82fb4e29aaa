"""A stated query set against all rows, block by block: what the two vector searches share.

Rows are dealt into blocks of bounded size by a hash of their number, queries into chunks of bounded size. A task
gets one block and one chunk, searches it, and hands on at most k rows a query; the best k of
all blocks follow from those. A block is sent once per chunk and a chunk once per block, so both are as large as a
task's memory allows: what is sent is the number of rows times that of queries, over half the size of a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from . import common

#: Components in a block or a chunk, 16 MB: 32,768 vectors of 64, 2,048 of 1,024.
BLOCK_VALUES = 1 << 21
#: Chunks get no smaller than this for the sake of idle cores.
LEAST_QUERIES = 512


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """``row, vec_id, vec``, numbered and written once for the passes over it. Null ids, null vectors and vectors with null, non-finite or
    (for ``nonzero``) only zero components take no part. Rows that repeat an id are rows of their own."""
    vec = F.col(f"`{vec_col}`")
    if vectors.schema[vec_col].dataType not in (ArrayType(FloatType(), True), ArrayType(FloatType(), False)):  # floats travel as floats
        vec = vec.cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if nonzero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return common.kept(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec"), "vectors")


def shape(rows: DataFrame, is_query: Column, *more: Column) -> Row | None:
    """The length that most vectors have (``dim``, of equally frequent ones the longest), their number ``n``, that of queries ``q``, and ``more`` aggregates."""
    by_dim = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), *more)
    return by_dim.orderBy(F.desc("n"), F.desc("dim")).first()


def search(
    rows: DataFrame,
    found_shape: Row | None,
    is_query: Column,
    k: int,
    cell: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    score_type: str,
    block_values: int = BLOCK_VALUES,
    least_queries: int = LEAST_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest scores, ties to the smaller id. A query is a row: where rows repeat a
    query's id, each has its own k, with the others among its candidates, and ranks come once for each.

    ``cell(own, queries, vectors)`` returns places of queries, places in the block and scores, at most k a query, of one
    block. Its rows come in the order of their ids, vectors as doubles; ``own`` is each query's own place there, or -1.
    Vectors of another length than ``found_shape`` says take no part.
    """
    dim, n, q = (found_shape["dim"], found_shape["n"], found_shape["q"]) if found_shape else (1, 0, 0)
    most = max(1, block_values // dim)
    blocks = max(1, math.ceil(n / most))
    busy = math.ceil(2 * rows.sparkSession.sparkContext.defaultParallelism / blocks)  # chunks that keep all cores busy
    chunks = max(1, math.ceil(q / most), min(busy, math.ceil(q / least_queries)))
    rows = rows.filter(F.size("vec") == dim)
    dealt = F.xxhash64("row")
    candidates = rows.select("row", "vec_id", "vec", F.pmod(dealt, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = rows.filter(is_query).select("row", "vec_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(dealt, F.lit(chunks)).alias("chunk"))
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            (numbers, ids, block), (asking, names, queries) = _arrays(left), _arrays(right)
            asked_at, at, score = cell(places(asking, numbers), queries, block)
            asking, names, ids = asking[asked_at], names[asked_at], ids[at]
        else:
            asking, names, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_row": pa.array(asking, pa.int64()), "query_id": pa.array(names, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, kind)})

    keys = ("block", "chunk")
    found = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, f"query_row long, query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def places(wanted: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` stands in ``numbers``, which are distinct; -1 where it doesn't."""
    order = np.argsort(numbers)
    at = order[np.minimum(np.searchsorted(numbers, wanted, sorter=order), len(numbers) - 1)]
    return np.where(numbers[at] == wanted, at, -1)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, ids in ascending order and vectors."""
    numbers, ids = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
    vecs = table.column("vec").combine_chunks()
    flat = (vecs if isinstance(vecs, pa.ListArray) else vecs.chunk(0)).flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((numbers, ids))
    return numbers[order], ids[order], flat.reshape(len(ids), -1)[order].astype(np.float64, copy=False)
