"""Page tables: raw pages, and product pages rendered from ``part`` so that extraction has something to find."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
SHAPES = 4
#: Rows that a task makes pages of, and how few it may get for the sake of idle cores.
ROWS, LEAST_ROWS = 10_000, 1_000


def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, html``; what a query doesn't use is pruned from the scan."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _price(times: float = 1.0) -> Column:
    return (F.col("p_retailprice").cast("decimal(18,2)") * F.lit(times).cast("decimal(4,0)")).cast("decimal(18,2)").cast("string")


def gtin13(key: Column) -> Column:
    """A 13-digit code from a number, its check digit wrong for every tenth number."""
    body = F.lpad(F.pmod(key, F.lit(10**9)).cast("string"), 9, "0")
    body = F.concat(F.lit("400"), body)
    total = sum((F.substring(body, i + 1, 1).cast("int") * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    check = F.pmod(F.lit(10) - total % 10, F.lit(10))
    return F.concat(body, F.pmod(check + F.when(key % 10 == 0, 1).otherwise(0), F.lit(10)).cast("int").cast("string"))


def _offer(price: Column) -> Column:
    return F.struct(
        F.lit("Offer").alias("@type"),
        price.alias("price"),
        F.lit("USD").alias("priceCurrency"),
        F.when(F.col("p_size") % 2 == 0, "https://schema.org/InStock").otherwise("out of stock").alias("availability"),
        F.lit("https://schema.org/NewCondition").alias("itemCondition"),
    )


def _product(kind: Column, offers: Column) -> Column:
    brand = F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name"))
    return F.struct(kind.alias("@type"), F.concat(F.lit("P"), "p_partkey").alias("sku"), gtin13(F.col("p_partkey")).alias("gtin13"), F.col("p_name").alias("name"), brand.alias("brand"), F.concat(F.lit("A "), "p_type").alias("description"), F.concat(F.lit("https://img.example/"), "p_partkey").alias("image"), offers.alias("offers"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks whose number grows with theirs. A page costs milliseconds and the row it is made of some bytes, so splits
    by bytes, which a scan makes, would leave millions of pages to a few tasks.

    Later conditions on the pages stay in these tasks: one that is always true but not deterministic keeps Spark from moving them, and the
    making of pages that they need, below the dealing into the scan."""
    n = rows.count()
    busy = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS))
    return rows.repartition(max(1, busy, math.ceil(n / ROWS))).filter(F.spark_partition_id() >= 0)


def rendered(part: DataFrame, kind: str) -> DataFrame:
    """``page_id, url, html`` with one product a page. ``kind``: ``jsonld`` (four shapes by key: object, array, graph, typed
    array with two offers), ``microdata``, ``meta``, ``nested``, ``mixed`` (fields spread over sources by key)."""
    json = F.to_json
    plain = _product(F.lit("Product"), _offer(_price()))
    typed = _product(F.array(F.lit("Product"), F.lit("Thing")), F.array(_offer(_price()), _offer(_price(2))))
    site = F.struct(F.lit("WebSite").alias("@type"), F.lit("a shop").alias("name"))
    shape = F.col("p_partkey") % SHAPES
    block = (
        F.when(shape == 0, json(plain))
        .when(shape == 1, F.concat(F.lit("["), json(site), F.lit(","), json(plain), F.lit("]")))
        .when(shape == 2, F.concat(F.lit('{"@graph":['), json(site), F.lit(","), json(plain), F.lit("]}")))
        .otherwise(json(typed))
    )
    jsonld = F.concat(F.lit('<script type="application/ld+json">{"@type":"WebSite"}</script><script type="application/ld+json">'), block, F.lit("</script>"))
    item = lambda name, value: F.concat(F.lit(f'<span itemprop="{name}">'), value, F.lit("</span>"))
    flat = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Product">'), item("name", F.col("p_name")), item("brand", F.col("p_brand")), F.lit('<meta itemprop="price" content="'), _price(), F.lit('"></div>'))
    nested = F.concat(
        F.lit("<div itemscope itemtype='https://schema.org/Product'><h2 itemprop=name>"),
        F.col("p_name"),
        F.lit('</h2><p itemprop="brand" itemscope itemtype="https://schema.org/Brand"><b itemprop="name">'),
        F.col("p_brand"),
        F.lit('</b></p><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta content="'),
        _price(),
        F.lit('" itemprop="price"><meta itemprop="priceCurrency" content="USD"></div></div>'),
    )
    meta = F.concat(F.lit('<meta property="og:title" content="'), "p_name", F.lit("\"><meta content='"), _price(), F.lit("' property='product:price:amount'><meta property=\"product:brand\" content=\""), "p_brand", F.lit('">'))
    empty = F.lit("")
    mixed = F.concat(F.when(F.col("p_partkey") % 3 == 0, jsonld).otherwise(empty), F.when(F.col("p_partkey") % 3 <= 1, flat).otherwise(empty), F.when(F.col("p_partkey") % 2 == 0, meta).otherwise(empty))
    body = {"jsonld": jsonld, "microdata": flat, "nested": nested, "meta": meta, "mixed": mixed}[kind]
    head = F.concat(F.lit('<html lang="en"><head><title>Shop: '), "p_name", F.lit("</title></head><body><h1>"), "p_type", F.lit("</h1>"))
    url = F.concat(F.lit("https://www.shop"), F.col("p_partkey") % 7, F.lit(".example.com/p/"), F.col("p_partkey"), F.lit(".html?utm_source=feed"))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), F.concat(head, body, F.lit("</body></html>")).alias("html"))


def listings(part: DataFrame, per_page: int = 2) -> DataFrame:
    """``page_id, url, html``: pages that list several parts, as one JSON-LD array, under meta tags that speak of the page."""
    block = F.to_json(_product(F.lit("Product"), _offer(_price())))
    pages = part.select(F.expr(f"p_partkey div {per_page}").alias("page_id"), block.alias("block")).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("block")), ",").alias("blocks"))
    head = '<html lang="en"><head><title>All we have</title><meta property="og:title" content="A list"><meta property="product:price:amount" content="1"></head><body><script type="application/ld+json">['
    url = F.concat(F.lit("https://www.shop.example.com/list/"), F.col("page_id"))
    return pages.select("page_id", url.alias("url"), F.concat(F.lit(head), "blocks", F.lit("]</script></body></html>")).alias("html"))


def catalogues(part: DataFrame, groups: int = 2, variants: int = 3) -> DataFrame:
    """``page_id, url, html``: German pages, each an ``ItemList`` of groups, each with its variants as products, written in the ways that shops differ in
    by key: brand as text, object, list or object without a name; image as text, list or object; price in the offer, as the lowest of a
    range or in a specification; type as word, address or list; entities in the name."""
    key = F.col("p_partkey")
    way = lambda n, *values: F.element_at(F.array(*values), (key % n + 1).cast("int"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    said = lambda text, *values: F.format_string(text, *values)
    price = F.concat(_price(), F.lit("0"))  # three digits after the point
    brand = way(4, quoted("p_brand"), said('{"@type":"Brand","name":"%s"}', "p_brand"), said('[{"@type":"Brand","name":"%s"},{"name":"other"}]', "p_brand"), F.lit('{"@type":"Brand"}'))
    image = way(3, said('"https://img.example/%d"', key), said('["https://img.example/%d","https://img.example/more"]', key), said('{"@type":"ImageObject","url":"https://img.example/%d"}', key))
    offer = way(
        3,
        said('{"@type":"Offer","price":"%s","priceCurrency":"EUR"}', price),
        said('{"@type":"AggregateOffer","lowPrice":%s,"highPrice":99999.5,"priceCurrency":"EUR"}', price),
        said('{"@type":"Offer","priceSpecification":[{"price":"%s","priceCurrency":"EUR"}]}', price),
    )
    kind = way(4, F.lit('"Product"'), F.lit('"https://schema.org/Product"'), F.lit('["http://schema.org/Product","Thing"]'), F.lit('"schema:Product"'))
    product = said('{"@type":%s,"sku":"P%d","name":"&#82;&eacute;d &amp; %s","brand":%s,"image":%s,"offers":%s}', kind, key, "p_name", brand, image, offer)
    group = part.select(F.expr(f"p_partkey div {groups * variants}").alias("page_id"), F.expr(f"p_partkey div {variants}").alias("own"), product.alias("product"))
    group = group.groupBy("page_id", "own").agg(F.array_join(F.array_sort(F.collect_list("product")), ",").alias("variants"))
    listed = F.concat(F.lit('{"@type":"ListItem","item":{"@type":"ProductGroup","name":"a group","hasVariant":['), "variants", F.lit("]}}"))
    pages = group.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(listed)), ",").alias("items"))
    head = '<html lang="de"><head><title>Katalog</title></head><body><script type="application/ld+json">{"@type":"WebPage","mainEntity":{"@type":"ItemList","itemListElement":['
    return pages.select("page_id", F.concat(F.lit("https://katalog.example.com/"), F.col("page_id")).alias("url"), F.concat(F.lit(head), "items", F.lit("]}}</script></body></html>")).alias("html"))
