"""Operators on candidates and products: enumerations, merging of sources, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import gtin_valid

AVAILABILITY = {
    "instock": "IN_STOCK",
    "in stock": "IN_STOCK",
    "available": "IN_STOCK",
    "outofstock": "OUT_OF_STOCK",
    "out of stock": "OUT_OF_STOCK",
    "soldout": "OUT_OF_STOCK",
    "sold out": "OUT_OF_STOCK",
    "preorder": "PRE_ORDER",
    "pre-order": "PRE_ORDER",
    "backorder": "BACK_ORDER",
    "discontinued": "DISCONTINUED",
}
CONDITION = {"newcondition": "NEW", "new": "NEW", "usedcondition": "USED", "used": "USED", "refurbishedcondition": "REFURBISHED", "refurbished": "REFURBISHED", "damagedcondition": "DAMAGED"}
FIELDS = ["sku", "gtin", "name", "brand", "description", "price", "currency", "availability", "condition"]
LISTS = ["image_urls", "offers"]


def enum_table(spark: SparkSession, values: dict[str, str] = AVAILABILITY) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "spelling string, code string")


def enum_norm(df: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """``col`` as its code, null for unknown spellings. The table is a list of spellings, a few rows, so it is broadcast."""
    spelling = F.lower(F.trim(F.regexp_replace(F.col(col), r"^https?://schema\.org/", "")))
    names = table.select(F.col("spelling").alias("_spelling"), F.col("code").alias("_code"))
    return df.join(F.broadcast(names), spelling == F.col("_spelling"), "left").withColumn(col, F.col("_code")).drop("_spelling", "_code")


def code_of(spelling: Column, values: dict[str, str]) -> Column:
    """``enum_norm`` of one value, where it stands inside an array."""
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(known, F.lower(F.trim(F.regexp_replace(spelling, r"^https?://schema\.org/", ""))))


def with_items(found: Column) -> Column:
    """A page's candidates with the ``item`` that each speaks of.

    Where no source has more than one candidate, nor do two give different skus, all speak of one. Else an item is named by its
    gtin, its sku, its name or, lacking all, its source and place; meta tags and fallback, which describe the page, are left out."""
    count = lambda source: F.size(F.filter(found, lambda c: c["source"] == source))
    skus = F.array_distinct(F.filter(F.transform(found, lambda c: c["sku"]), lambda s: s.isNotNull()))
    several = (count("jsonld") > 1) | (count("microdata") > 1) | (F.size(skus) > 1)
    part = lambda kind, value: F.concat(F.lit(kind), value)
    named = lambda c: F.coalesce(part("g", c["gtin"]), part("s", c["sku"]), part("n", F.lower(c["name"])), F.concat_ws(":", c["source"], c["pos"]))
    all_of = lambda items: F.transform(items, lambda c: F.struct(F.lit("").alias("item"), c.alias("c")))
    each = F.transform(F.filter(found, lambda c: c["source"].isin("jsonld", "microdata")), lambda c: F.struct(named(c).alias("item"), c.alias("c")))
    return F.when(several & (F.size(each) > 0), each).otherwise(all_of(found))


def merge_sources(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of each field the value from the best-ranked source that has one (of equal ranks the first on the page, then the
    smallest value), of lists the first that is not empty, and the sources met."""
    best = [F.expr(f"min_by({f}, struct(source_rank, pos, {f})) FILTER (WHERE {f} IS NOT NULL)").alias(f) for f in FIELDS]
    best += [F.expr(f"min_by({f}, struct(source_rank, pos, {f})) FILTER (WHERE size({f}) > 0)").alias(f) for f in LISTS]
    return candidates.groupBy(*keys).agg(*best, F.array_sort(F.collect_set("source")).alias("sources"))


def identity(products: DataFrame, rest: list[str]) -> Column:
    """A valid GTIN, else brand and sku, else the remaining fields; fields are parted by a control character."""
    part = lambda *cols: F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    gtin = F.when(gtin_valid(F.col("gtin")), F.concat(F.lit("g"), F.lpad("gtin", 14, "0")))
    sku = F.when(F.col("brand").isNotNull() & F.col("sku").isNotNull(), F.concat(F.lit("s"), part("brand", "sku")))
    return F.coalesce(gtin, sku, F.concat(F.lit("n"), part(*rest)))


def product_dedup(products: DataFrame, key: Column, order: str) -> DataFrame:
    """One product per key, the lowest ``order`` (columns, parted by commas). Partial aggregation meets a key that many products share."""
    held = products.select(F.struct("*").alias("row"), key.alias("key"))
    return held.groupBy("key").agg(F.min_by("row", F.struct(*[f"row.{c}" for c in order.split(",")])).alias("row")).select("row.*")
