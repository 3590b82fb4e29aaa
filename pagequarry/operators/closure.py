"""Identity closure: products linked by any of their identity keys, over any number of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import gtin_valid
from pagequarry.shared import Written


def identity_keys() -> Column:
    """All keys that name a product: its GTIN if valid, its brand and sku."""
    gtin = F.when(gtin_valid(F.col("gtin")), F.concat(F.lit("g"), F.lpad("gtin", 14, "0")))
    sku = F.when(F.col("brand").isNotNull() & F.col("sku").isNotNull(), F.concat(F.lit("s"), F.lower("brand"), F.lit("\x1f"), F.col("sku")))
    return F.filter(F.array(gtin, sku), lambda k: k.isNotNull())


def _links(products: DataFrame, id_col: str, keys: Column) -> DataFrame:
    """Every product with the smallest that shares a key: a key of many products is one number a task, then a star."""
    named = products.select(F.col(id_col).cast("long").alias("a"), F.explode(keys).alias("key")).filter("a IS NOT NULL").distinct()
    return named.join(named.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b").distinct()


def _hung(edges: DataFrame, written: Written) -> DataFrame:
    """One round: larger neighbours of a product move to the smallest it knows, then smaller ones and it to the smallest of them."""
    both = edges.union(edges.select("b", "a"))
    low = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "closure")
    edges = written(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct(), "closure")
    low = written(edges.groupBy("a").agg(F.min("b").alias("low")), "closure")
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return written(moved.union(low).filter("a <> b").distinct(), "closure")


def identity_closure(products: DataFrame, id_col: str = "id", keys: Column | None = None) -> DataFrame:
    """``id_col, product_id``: the smallest id that each product is linked with through shared keys; its own if it shares none.

    ``keys`` is an array of texts, by default ``identity_keys``. Products without an id take no part; repeated ids count as one product with all their keys.
    The number of rounds grows with the logarithm of the longest chain. Each is written to the shared folder, and no key's products are ever gathered."""
    keys = identity_keys() if keys is None else keys
    ids = products.select(F.col(id_col).cast("long").alias("a")).filter("a IS NOT NULL").distinct()
    with Written(products.sparkSession) as written:
        edges = written(_links(products, id_col, keys).filter("a <> b"), "closure")
        while True:
            edges = _hung(edges, written)
            ends = edges.select("a", F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
            if ends.groupBy("a").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 OR (hangs > 0 AND holds > 0)").isEmpty():
                break
        edges = written(edges, "closure", kept=True)
    return ids.join(edges, "a", "left").select(F.col("a").alias(id_col), F.coalesce("b", "a").alias("product_id"))


def merged_products(products: DataFrame, id_col: str = "id", keys: Column | None = None) -> DataFrame:
    """One product for each class of the closure, that with the smallest id, with ``n_merged`` and the columns of ``products``; those without an id all stay, with
    ``n_merged`` 1. Of rows that repeat the id the smallest stays, compared by all columns that can be."""
    classes = identity_closure(products, id_col, keys).groupBy("product_id").agg(F.count("*").alias("n_merged"))
    one = products.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.struct("*").alias("row"))
    one = one.join(classes, F.col("_id") == F.col("product_id")).groupBy("_id").agg(F.min_by("row", F.to_json("row")).alias("row"), F.first("n_merged").alias("n_merged"))
    return one.select("row.*", "n_merged").unionByName(products.filter(F.col(id_col).isNull()).withColumn("n_merged", F.lit(1).cast("long")))
