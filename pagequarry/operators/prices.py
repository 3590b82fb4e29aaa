"""Products set against others of their kind by price: frames of near prices, pairs of near prices, sketches that merge."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def price_neighbours(products: DataFrame, by: list[str], price: str, within: int) -> DataFrame:
    """``products`` with ``n_near, mean_near, n_below``: how many of its kind (``by``) cost no more than ``within`` hundredths less or more, itself included, what they
    cost on average, and how many cost less than that. A null price has nulls and counts nowhere. Kinds should be narrow: one is sorted as a whole."""
    known = F.when(F.col(price).isNotNull(), F.col(price))
    kind = Window.partitionBy(*by, known.isNull()).orderBy(F.round(F.col(price).cast("double") * 100).cast("long"))
    near, below = kind.rangeBetween(-within, within), kind.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = products.withColumns({"n_near": F.count(price).over(near), "mean_near": F.avg(price).over(near), "n_below": F.count(price).over(below)})
    return held.withColumns({c: F.when(known.isNotNull(), F.col(c)) for c in ("n_near", "n_below")})


def near_prices(products: DataFrame, id_col: str, by: list[str], price: str, ratio: float) -> DataFrame:
    """``a, b``: ids of products of one kind whose prices differ by a factor of at most ``ratio``, the smaller id first. Products of one kind and price stand in for each
    other: pairs are of the smallest id of each price, so a price that many share is one row.

    Prices fall into bands by their logarithm, as wide as ``ratio``; partners can only be in the same band or a neighbour of it, and an
    exact test follows. Null prices and those not above zero have no partners."""
    band = F.floor(F.log(F.col(price).cast("double")) / math.log(ratio))
    first = products.filter(F.col(price) > 0).groupBy(*by, price).agg(F.min(id_col).alias("id"))
    left = first.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("id").alias("a_id"), F.col(price).alias("a_price"), F.explode(F.array(band, band + 1)).alias("_band"))
    right = first.select(*by, F.col("id").alias("b_id"), F.col(price).alias("b_price"), band.alias("band"))
    same = F.col("_band") == F.col("band")
    for c in by:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    found = left.join(right, same).filter((F.col("a_price") < F.col("b_price")) & (F.col("b_price") <= F.col("a_price") * ratio))
    return found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def quality_rollup(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """``host, source, level, n`` and ``with_*`` of each field: by host and source, by host, by source and over all, in one pass. ``level`` tells which columns
    are summed over (1 source, 2 host, 3 both), so that a null host is not taken for a total."""
    held = [F.count(f).alias(f"with_{f}") for f in fields]
    sets = [[F.col("host"), F.col("source")], [F.col("host")], [F.col("source")], []]
    return candidates.groupingSets(sets, "host", "source").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *held)
