"""Operators on pages themselves: identity, latest version, fallback fields, quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import decode_entities, url_key
from pagequarry.operators.embedded import blocks_of


def with_url_key(pages: DataFrame, url_col: str = "url") -> DataFrame:
    return pages.withColumn("url_key", url_key(F.col(url_col)))


def page_latest(pages: DataFrame, key: str = "url_key", order: str = "page_id") -> DataFrame:
    """One page per key, the highest ``order``; pages without a key all stay.

    Winners are found by partial aggregation on two narrow columns; the html is not sorted, and a hot key stays one number per task."""
    best = pages.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias(order))
    return pages.filter(F.col(key).isNotNull()).join(best, [key, order], "left_semi").unionByName(pages.filter(F.col(key).isNull()))


def fallback_fields(html: Column) -> dict[str, Column]:
    found = lambda pattern: F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))
    return {
        "title": decode_entities(found(r"(?is)<title[^<>]*>([^<]*)</title")),
        "h1": decode_entities(found(r"(?is)<h1[^<>]*>([^<]*)</h1")),
        "lang": found(r"""(?is)<html[^<>]*\blang=["']?([A-Za-z-]+)"""),
    }


def page_fallback(pages: DataFrame) -> DataFrame:
    """``page_id, title, h1, lang``; null where a page has none."""
    return pages.select("page_id", *[c.alias(n) for n, c in fallback_fields(F.col("html")).items()])


def fill_rate(pages: DataFrame, products: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Per host: pages, pages never closed, JSON-LD blocks that can't be parsed, and how many products have each field, also as a share
    of all products. One partial aggregation a side."""
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^(?:www|m)\.", "").alias("host")
    broken = F.size(F.filter(blocks_of(F.col("html")), lambda b: F.try_parse_json(b).isNull()))
    counts = pages.select(host, F.contains(F.lower("html"), F.lit("</html>")).alias("closed"), broken.alias("broken"))
    counts = counts.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(~F.col("closed")).alias("unclosed"), F.coalesce(F.sum(F.greatest("broken", F.lit(0))), F.lit(0)).alias("broken_blocks"))
    if products is None:
        return counts
    fields = fields or [c for c in products.columns if c not in ("page_id", "url", "url_key")]
    rates = products.select(host, *fields).groupBy("host").agg(*[F.count(c).alias(f"with_{c}") for c in fields], *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"share_{c}") for c in fields])
    return counts.join(rates, "host", "left").na.fill(0, [f"with_{c}" for c in fields])


def no_product_pages(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    return pages.join(candidates.select("page_id").distinct(), "page_id", "left_anti")
