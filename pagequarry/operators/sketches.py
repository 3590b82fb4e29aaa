"""Sketches of products that merge: how many different ones there are and how their prices are spread, a row per group.

Sketches of increments are stored as a table; ``merge_sketches`` of any number of them says what one over all rows would. The number of
different products comes from a theta sketch of their keys, which merges to the same state in any order (the estimate of a HyperLogLog sketch depends on how it was merged). Prices are counted by their first ``DIGITS`` digits, at most 900 counts a power of ten, so every quantile is
right but for half a unit of the last digit (0.5 %), and counts add up exactly in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 3
#: A theta sketch keeps the 4,096 smallest hashes of its keys: exact up to as many, then a standard error of 1.6 %.
LG_NOMINAL = 12


def price_bin(price: Column, digits: int = DIGITS) -> Column:
    """The price rounded to its first ``digits`` digits, half up, in whole hundredths; null for null and for prices not above zero."""
    hundredths = F.round(price.cast("decimal(18,2)") * 100).cast("long")
    unit = F.pow(F.lit(10), F.greatest(F.length(hundredths.cast("string")) - digits, F.lit(0))).cast("long")
    return F.when(hundredths > 0, _rounded(hundredths, unit))


def _rounded(value: Column, unit: Column) -> Column:
    above = value + F.floor(unit / 2).cast("long")
    return above - F.pmod(above, unit)


def sketches(products: DataFrame, by: list[str], key: str, price: str, digits: int = DIGITS) -> DataFrame:
    """``by, n, n_priced, items, prices``: rows, rows with a price, the sketch of ``key``, and ``bin, n`` of each price that occurs.

    Null keys count in ``n`` alone. A hot group is met by partial aggregation per price first: what comes together of it is its prices, not its rows."""
    bins = products.select(*by, F.col(key).cast("string").alias("_key"), price_bin(F.col(price), digits).alias("bin"))
    bins = bins.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.theta_sketch_agg("_key", F.lit(LG_NOMINAL)).alias("items"))
    return _gathered(bins, by)


def merge_sketches(held: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of several tables of sketches put together; ``by`` may be coarser than theirs. Null ``prices`` can't occur: a group without any has an empty list."""
    unpriced = F.struct(F.lit(None).cast("long").alias("bin"), (F.col("n") - F.col("n_priced")).alias("n"))
    bins = held.select(*by, "items", F.posexplode(F.concat(F.array(unpriced), "prices")).alias("at", "p"))
    bins = bins.select(*by, F.when(F.col("at") == 0, F.col("items")).alias("items"), "p.bin", "p.n")
    return _gathered(bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.theta_union_agg("items", F.lit(LG_NOMINAL)).alias("items")), by)


def _gathered(bins: DataFrame, by: list[str]) -> DataFrame:
    priced = F.col("bin").isNotNull()
    prices = F.array_sort(F.collect_list(F.when(priced & (F.col("n") > 0), F.struct("bin", "n"))))
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(priced, F.col("n"))), F.lit(0)).alias("n_priced"), F.theta_union_agg("items", F.lit(LG_NOMINAL)).alias("items"), prices.alias("prices"))


def distinct_items(items: Column) -> Column:
    """About how many different keys a sketch has seen."""
    return F.theta_sketch_estimate(items)


def quantile(prices: Column, share: float) -> Column:
    """The smallest price (as binned) that at least ``share`` of the priced rows don't exceed; null where no row has one."""
    total = F.aggregate(prices, F.lit(0).cast("long"), lambda s, p: s + p["n"])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))

    def step(held: Column, p: Column) -> Column:
        seen = held["seen"] + p["n"]
        return F.struct(seen.alias("seen"), F.coalesce(held["bin"], F.when(seen >= total * share, p["bin"])).alias("bin"))

    return F.aggregate(prices, start, step)["bin"] / 100
