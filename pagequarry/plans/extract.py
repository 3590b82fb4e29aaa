"""The whole extraction as one lazy plan: pages in, products out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import currency, let, price
from pagequarry.operators import embedded, pages as page_ops, products


OF_OFFER = ("price", "currency", "availability", "condition")


def read_pages(pages: DataFrame, *more: str, with_fallback: bool = True) -> DataFrame:
    """``page_id, title, h1, lang, found`` and the columns ``more``: one pass over the html, which ends here; ``found`` holds the
    candidates of all sources, the fallback only where another source has any."""
    html = F.col("html")
    sources = F.concat(embedded.jsonld_candidates(html), embedded.microdata_candidates(html), embedded.nested_candidates(html), embedded.meta_candidates(html))
    none = F.array().cast(f"array<{embedded.CANDIDATE}>")
    held = pages.select("page_id", *more, *[c.alias(n) for n, c in page_ops.fallback_fields(html).items()], F.coalesce(sources, none).alias("found"))
    if not with_fallback:
        return held
    return held.withColumn("found", F.when(F.size("found") > 0, F.concat("found", embedded.fallback_candidates(F.col("title"), F.col("h1")))).otherwise(none))


def candidates(pages: DataFrame, with_fallback: bool = True) -> DataFrame:
    """``page_id, item`` and the fields of a candidate: a row for all that each source says of each item on a page."""
    return exploded(read_pages(pages, with_fallback=with_fallback), "page_id")


def exploded(held: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``item`` and the fields of each candidate in ``found``."""
    return held.select(*keys, F.explode(products.with_items(F.col("found"))).alias("i")).select(*keys, "i.item", "i.c.*")


def _offer(offer: Column, lang: Column) -> Column:
    text = F.concat_ws(" ", offer["price"], offer["currency"])
    return F.struct(
        price(text, lang).alias("price"),
        F.coalesce(currency(text), offer["currency"]).alias("currency"),
        products.code_of(offer["availability"], products.AVAILABILITY).alias("availability"),
        products.code_of(offer["condition"], products.CONDITION).alias("condition"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """``url_key``, the fields, ``image_urls, offers, sources``: a row per product, the latest version of each page. Price, currency, availability and
    condition are those of the first offer.

    Pages are read once; what goes on is narrow. A page without a ``url_key`` is its own latest version."""
    return products_of(latest_of(read_pages(page_ops.with_url_key(pages), "url_key")))


def latest_of(held: DataFrame) -> DataFrame:
    """``url_key, page_id, lang, found`` of the latest version of each page."""
    own = F.when(F.col("url_key").isNull(), F.col("page_id")).alias("own")
    latest = held.groupBy("url_key", own).agg(F.max_by(F.struct("page_id", "lang", "found"), "page_id").alias("p"))
    return latest.select("url_key", "p.*")


def products_of(latest: DataFrame) -> DataFrame:
    """The products of pages that have been read, merged over sources and freed of repeats."""
    rows = exploded(latest, "url_key", "page_id", "lang")
    merged = products.merge_sources(rows, ["url_key", "page_id", "lang", "item"])
    lang = F.col("lang")
    first = F.struct(*OF_OFFER)
    merged = merged.withColumns({"first": let(first, lambda o: _offer(o, lang)), "offers": F.transform(F.coalesce("offers", F.array()), lambda o: _offer(o, lang)), "image_urls": F.coalesce("image_urls", F.array())})
    coded = merged.select("url_key", "page_id", "item", *[f for f in products.FIELDS if f not in OF_OFFER], "first.*", *products.LISTS, "sources")
    one = products.product_dedup(coded, products.identity(coded, ["name", "brand", "sku", "url_key"]), "page_id,item")
    return one.select("url_key", *products.FIELDS, *products.LISTS, "sources")


def quality(pages: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How complete ``found`` (``page_id, url`` and fields) is per host, and the pages that gave nothing."""
    return page_ops.fill_rate(pages, found), page_ops.no_product_pages(pages, found)
