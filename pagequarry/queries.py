"""Registered queries of the extraction operators, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import text
from pagequarry.operators import closure, embedded, pages as page_ops, prices, products, sketches
from pagequarry.plans import extract as plan, incremental
from pagequarry.shared import fresh_path
from pagequarry.sources.pages import catalogues, gtin13, listings, page_scan, rendered, spread
from pagequarry.streaming.extract import extract_stream
from pagequarry.streaming.products import latest_stream, stream_products


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _rendered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return rendered(spread(_part(spark, sf_dir)), kind)


def _decimal(name: str):
    return F.col(name).try_cast("decimal(18,2)").cast("double").alias(name)


def page_scan_query(spark, sf_dir):
    return page_scan(spark, sf_dir).select("page_id", "url")


def url_key(spark, sf_dir):
    return page_ops.with_url_key(page_scan(spark, sf_dir)).select("page_id", "url_key")


def page_latest(spark, sf_dir):
    return page_ops.page_latest(page_ops.with_url_key(page_scan(spark, sf_dir)).select("page_id", "url_key")).select("url_key", "page_id")


def jsonld_blocks(spark, sf_dir):
    return embedded.jsonld_blocks(_rendered(spark, sf_dir, "jsonld")).select("page_id", "pos", F.contains("block", F.lit('"sku"')).alias("has_sku"))


def jsonld_products(spark, sf_dir):
    return embedded.jsonld_products(_rendered(spark, sf_dir, "jsonld")).select("page_id", "sku", "gtin", "name", "brand", "description", _decimal("price"), "currency", "availability", "condition", F.size("offers").alias("n_offers"), F.array_join("image_urls", ",").alias("images"))


def microdata_products(spark, sf_dir):
    return embedded.microdata_products(_rendered(spark, sf_dir, "microdata")).select("page_id", "name", "brand", _decimal("price"))


def microdata_nested(spark, sf_dir):
    return embedded.microdata_nested(_rendered(spark, sf_dir, "nested")).select("page_id", "name", "brand", _decimal("price"), "currency")


def meta_products(spark, sf_dir):
    return embedded.meta_products(_rendered(spark, sf_dir, "meta")).select("page_id", "name", "brand", _decimal("price"))


def page_fallback(spark, sf_dir):
    return page_ops.page_fallback(page_scan(spark, sf_dir))


def offers(spark, sf_dir):
    nodes = embedded.jsonld_nodes(embedded.jsonld_blocks(_rendered(spark, sf_dir, "jsonld")))
    return embedded.offers(nodes).select("page_id", "offer_pos", _decimal("price"), "currency", "availability")


def price_norm(spark, sf_dir):
    number = F.col("p_retailprice").cast("decimal(18,2)") * F.lit(13).cast("decimal(4,0)")
    english = F.format_number(number, 2)
    german = F.translate(english, ",.", ".,")
    lang = F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("de")
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$"), english)).otherwise(F.concat(german, F.lit(" €")))
    rows = _part(spark, sf_dir).select("p_partkey", lang.alias("lang"), shown.alias("shown"))
    return rows.select("p_partkey", text.price(F.col("shown"), F.col("lang")).cast("double").alias("price"), text.currency(F.col("shown")).alias("currency"))


def gtin_check(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", text.gtin_valid(gtin13(F.col("p_partkey"))).alias("valid"))


def enum_norm(spark, sf_dir):
    spellings = F.element_at(F.array(*map(F.lit, ["https://schema.org/InStock", " Sold out", "PreOrder", "somewhere"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return products.enum_norm(_part(spark, sf_dir).select("p_partkey", spellings.alias("availability")), "availability", products.enum_table(spark))


def merge_sources(spark, sf_dir):
    merged = products.merge_sources(plan.candidates(_rendered(spark, sf_dir, "mixed")), ["page_id", "item"])
    return merged.select("page_id", "sku", "name", "brand", _decimal("price"), "currency", F.array_join("sources", ",").alias("sources"))


def product_dedup(spark, sf_dir):
    none = F.lit(None).cast("string")
    parts = _part(spark, sf_dir).withColumns({"gtin": none, "sku": none, "brand": F.col("p_brand")})
    return products.product_dedup(parts, products.identity(parts, ["p_name", "p_brand", "p_type", "p_size"]), "p_partkey").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def fill_rate(spark, sf_dir):
    return page_ops.fill_rate(page_scan(spark, sf_dir))


def fill_rate_products(spark, sf_dir):
    shown = _rendered(spark, sf_dir, "mixed")
    held = plan.exploded(plan.read_pages(shown, "url", with_fallback=False), "page_id", "url")
    found = held.groupBy("page_id", "url").agg(F.max("sku").alias("sku"), F.max("name").alias("name"), F.max("price").alias("price"))
    return page_ops.fill_rate(shown, found, ["sku", "name", "price"])


def no_product_pages(spark, sf_dir):
    pages = page_scan(spark, sf_dir)
    return page_ops.no_product_pages(pages.select("page_id", "url"), plan.candidates(pages, with_fallback=False))


def _shown(found):
    return found.select("url_key", "sku", "gtin", "name", "brand", "description", F.col("price").cast("double").alias("price"), "currency", "availability", "condition", F.size("offers").alias("n_offers"), F.array_join("image_urls", ",").alias("images"), F.array_join("sources", ",").alias("sources"))


def extract(spark, sf_dir):
    return _shown(plan.extract(_rendered(spark, sf_dir, "jsonld").unionByName(page_scan(spark, sf_dir))))


def extract_listings(spark, sf_dir):
    return _shown(plan.extract(listings(spread(_part(spark, sf_dir)))))


def _one_file(table: str, sf_dir: str) -> str:
    """A pattern may name a file or a folder, a plain path only a folder."""
    return f"{sf_dir}/[{table[0]}]{table[1:]}.parquet"


def extract_stream_query(spark, sf_dir):
    at = fresh_path(spark, "stream")
    extract_stream(spark, _one_file("pages", sf_dir), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    held = spark.read.parquet(f"{at}/out")
    return held.select("page_id", "title", "h1", "lang", F.size("found").alias("n_found"))


def product_stream(spark, sf_dir):
    """Pages with products, in eight files or more, as two versions each, the older one among the later files too; the stream ends half-way and is started again.

    A file is read by one task, so files, and those of a batch, grow with the pages; the batches stay four."""
    at = fresh_path(spark, "products")
    new = _rendered(spark, sf_dir, "jsonld")
    old = new.withColumns({"page_id": F.col("page_id") - 1_000_000_000, "html": F.replace("html", F.lit('"name":"'), F.lit('"name":"Old '))})
    both = new.unionByName(old)
    files = max(4, new.rdd.getNumPartitions())
    for half in (0, 1):
        both.filter(F.pmod(F.xxhash64("page_id"), F.lit(2)) == half).repartition(files, "page_id").write.mode("append").parquet(f"{at}/pages")
        latest_stream(spark, f"{at}/pages", f"{at}/sink", f"{at}/checkpoint", files_per_batch=math.ceil(files / 2)).awaitTermination()
    return _shown(stream_products(spark, f"{at}/sink"))


def nested_products(spark, sf_dir):
    found = plan.extract(catalogues(spread(_part(spark, sf_dir))))
    return found.select("url_key", "sku", "name", "brand", F.col("price").cast("double").alias("price"), "currency", F.get("image_urls", F.lit(0)).alias("image"))


def identity_closure(spark, sf_dir):
    key = F.col("p_partkey")
    sku = F.when(key % 7 != 0, F.expr("(p_partkey + 1) div 2").cast("string"))
    parts = _part(spark, sf_dir).select("p_partkey", gtin13(F.expr("p_partkey div 2")).alias("gtin"), sku.alias("sku"), F.lit("House").alias("brand"))
    return closure.identity_closure(parts, "p_partkey")


def incremental_extract(spark, sf_dir):
    """The first run knows pages with other prices for every tenth part, and one page that is gone since."""
    pages = _rendered(spark, sf_dir, "jsonld")
    other = F.when(F.col("page_id") % 10 == 0, F.replace("html", F.lit('"price":"'), F.lit('"price":"9'))).otherwise(F.col("html"))
    first = _part(spark, sf_dir).agg(F.min_by(F.struct("*"), "p_partkey").alias("p")).filter("p IS NOT NULL").select("p.*")  # below a limit all pages would be read
    gone = rendered(first, "jsonld").withColumns({"page_id": F.lit(-1).cast("long"), "url": F.lit("https://gone.example/1")})
    path = fresh_path(spark, "manifest")
    incremental.update_manifest(pages.withColumn("html", other).unionByName(gone)).write.parquet(path)
    return _shown(incremental.products_now(incremental.update_manifest(pages, spark.read.parquet(path))))


def quality_rollup(spark, sf_dir):
    shown = _rendered(spark, sf_dir, "mixed")
    host = F.regexp_extract("url", "//(?:www[.])?([^/]+)", 1)
    found = plan.exploded(plan.read_pages(shown, "url", with_fallback=False), "page_id", "url")
    return prices.quality_rollup(found.withColumn("host", host), ["sku", "name", "price"])


def price_neighbours(spark, sf_dir):
    near = prices.price_neighbours(_part(spark, sf_dir), ["p_brand", "p_type"], "p_retailprice", 500)
    return near.select("p_partkey", "n_near", F.round("mean_near", 4).alias("mean_near"), "n_below")


def near_prices(spark, sf_dir):
    return prices.near_prices(_part(spark, sf_dir), "p_partkey", ["p_name", "p_brand"], "p_retailprice", 1.01)


def product_sketches(spark, sf_dir):
    """Sketches of three increments, stored and merged, against one over all rows and against the exact number of products."""
    shown = _rendered(spark, sf_dir, "jsonld")
    host = F.regexp_extract("url", "//(?:www[.])?([^/]+)", 1).alias("host")
    found = plan.exploded(plan.read_pages(shown, "url", with_fallback=False), "page_id", "url").select(host, "page_id", "sku", F.col("price").try_cast("decimal(18,2)").alias("price"))
    path = fresh_path(spark, "sketches")
    found.write.parquet(f"{path}/found")  # html is parsed once
    found = spark.read.parquet(f"{path}/found")
    parts = sketches.sketches(found.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(3))), ["host", "part"], "sku", "price")
    parts.write.partitionBy("part").parquet(f"{path}/sketches")  # of all increments in one pass
    held = found.groupBy("host").agg(F.count_distinct("sku").alias("n_items"))
    whole = sketches.sketches(found, ["host"], "sku", "price").select("host", sketches.distinct_items(F.col("items")).alias("of_whole"))
    merged = sketches.merge_sketches(spark.read.schema(parts.schema).parquet(f"{path}/sketches"), ["host"]).join(held, "host").join(whole, "host")
    estimate = sketches.distinct_items(F.col("items"))
    return merged.select(
        "host", "n", "n_items", (estimate == F.col("of_whole")).alias("as_whole"), (F.abs(estimate - F.col("n_items")) <= 0.05 * F.col("n_items")).alias("near"),
        *[sketches.quantile(F.col("prices"), share).alias(name) for name, share in {"low": 0.1, "median": 0.5, "high": 0.9}.items()],
    )


def nested_rows(spark, sf_dir):
    """The table function as SQL calls it."""
    spark.udtf.register("nested_products", embedded.NestedProducts)
    return spark.sql("SELECT p.page_id, t.pos, t.name, t.brand, CAST(try_cast(t.price AS decimal(18,2)) AS double) AS price FROM {pages} p, LATERAL nested_products(p.html) t", pages=_rendered(spark, sf_dir, "nested"))


def page_quality(spark, sf_dir):
    """Counts of all hosts and pages that gave nothing, of real pages and rendered ones together."""
    pages = page_scan(spark, sf_dir).unionByName(_rendered(spark, sf_dir, "jsonld").withColumn("page_id", F.col("page_id") + 10**9))
    path = fresh_path(spark, "quality")
    plan.exploded(plan.read_pages(pages, "url", with_fallback=False), "page_id", "url").select("page_id", "url", "sku", "name", "price").write.parquet(path)
    rates, empty = plan.quality(pages, spark.read.parquet(path))  # html is parsed once for both
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^(?:www|m)\.", "").alias("host")
    return rates.select("host", "pages", "with_sku", "with_name").join(empty.groupBy(host).agg(F.count("*").alias("without")), "host", "left").na.fill(0, ["without"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extract": extract,
    "extract_listings": extract_listings,
    "page_scan": page_scan_query,
    "url_key": url_key,
    "page_latest": page_latest,
    "jsonld_blocks": jsonld_blocks,
    "jsonld_products": jsonld_products,
    "microdata_products": microdata_products,
    "microdata_nested": microdata_nested,
    "meta_products": meta_products,
    "page_fallback": page_fallback,
    "offers": offers,
    "price_norm": price_norm,
    "gtin_check": gtin_check,
    "enum_norm": enum_norm,
    "merge_sources": merge_sources,
    "product_dedup": product_dedup,
    "fill_rate": fill_rate,
    "fill_rate_products": fill_rate_products,
    "no_product_pages": no_product_pages,
    "extract_stream": extract_stream_query,
    "product_stream": product_stream,
    "nested_products": nested_products,
    "identity_closure": identity_closure,
    "incremental_extract": incremental_extract,
    "quality_rollup": quality_rollup,
    "price_neighbours": price_neighbours,
    "near_prices": near_prices,
    "page_quality": page_quality,
    "product_sketches": product_sketches,
    "nested_rows": nested_rows,
}

_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^(www|m)\\.', '')"
_KEY = f"""{_HOST}
  || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(\\.html)?/?$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
       lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&'), ''), '')"""
_GTIN_BODY = "'400' || lpad(CAST(p_partkey % 1000000000 AS VARCHAR), 9, '0')"
_GTIN_CHECK = f"(10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({_GTIN_BODY}, i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10"
_GTIN = f"{_GTIN_BODY} || CAST(({_GTIN_CHECK} + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END) % 10 AS INTEGER)"
_AVAILABLE = "CASE WHEN p_size % 2 = 0 THEN 'https://schema.org/InStock' ELSE 'out of stock' END"
_FIELD = lambda pattern: f"replace(replace(replace(replace(replace(nullif(trim(regexp_extract(html, '{pattern}', 1)), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_FALLBACK = f"""SELECT page_id, {_FIELD("(?is)<title[^>]*>([^<]*)</title")} AS title, {_FIELD("(?is)<h1[^>]*>([^<]*)</h1")} AS h1,
  nullif(regexp_extract(html, '(?is)<html[^>]*lang=["'']?([A-Za-z-]+)', 1), '') AS lang FROM pages"""

_IMAGE = "'https://img.example/' || p_partkey"
_EXTRACTED = f"""'P' || p_partkey AS sku, {_GTIN} AS gtin, p_name AS name, p_brand AS brand, 'A ' || p_type AS description,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, 'USD' AS currency,
  CASE WHEN p_size % 2 = 0 THEN 'IN_STOCK' ELSE 'OUT_OF_STOCK' END AS availability, 'NEW' AS condition, {_IMAGE} AS images"""

_EXTRACT = f"""SELECT 'shop' || (p_partkey % 7) || '.example.com/p/' || p_partkey AS url_key, {_EXTRACTED},
  CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 1 END::INTEGER AS n_offers, 'fallback,jsonld' AS sources FROM part"""

ORACLE_SQL: dict[str, str] = {
    "extract": _EXTRACT,
    "extract_listings": f"""SELECT 'shop.example.com/list/' || (p_partkey // 2) AS url_key, {_EXTRACTED},
  1::INTEGER AS n_offers, CASE WHEN count(*) OVER (PARTITION BY p_partkey // 2) > 1 THEN 'jsonld' ELSE 'fallback,jsonld,meta' END AS sources FROM part""",
    "page_scan": "SELECT page_id, url FROM pages",
    "url_key": f"SELECT page_id, {_KEY} AS url_key FROM pages",
    "page_latest": f"SELECT url_key, max(page_id) AS page_id FROM (SELECT page_id, {_KEY} AS url_key FROM pages) GROUP BY url_key",
    "jsonld_blocks": "SELECT p_partkey AS page_id, CAST(pos AS INTEGER) AS pos, pos = 1 AS has_sku FROM part, (VALUES (0), (1)) AS v(pos)",
    "jsonld_products": f"""SELECT p_partkey AS page_id, 'P' || p_partkey AS sku, {_GTIN} AS gtin, p_name AS name, p_brand AS brand, 'A ' || p_type AS description,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, 'USD' AS currency, {_AVAILABLE} AS availability, 'https://schema.org/NewCondition' AS condition,
  CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 1 END::INTEGER AS n_offers, {_IMAGE} AS images FROM part""",
    "microdata_products": "SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM part",
    "microdata_nested": "SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, 'USD' AS currency FROM part",
    "meta_products": "SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM part",
    "page_fallback": _FALLBACK,
    "offers": f"""SELECT p_partkey AS page_id, CAST(k AS INTEGER) AS offer_pos, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * (k + 1) AS DOUBLE) AS price,
  'USD' AS currency, {_AVAILABLE} AS availability FROM part, (VALUES (0), (1)) AS v(k) WHERE k = 0 OR p_partkey % 4 = 3""",
    "price_norm": "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 13 AS DOUBLE) AS price, CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM part",
    "gtin_check": "SELECT p_partkey, p_partkey % 10 <> 0 AS valid FROM part",
    "enum_norm": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'IN_STOCK' WHEN 1 THEN 'OUT_OF_STOCK' WHEN 2 THEN 'PRE_ORDER' END AS availability FROM part",
    "merge_sources": """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_partkey END AS sku, p_name AS name, p_brand AS brand,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CASE WHEN p_partkey % 3 = 0 THEN 'USD' END AS currency,
  array_to_string(list_filter(['fallback', CASE WHEN p_partkey % 3 = 0 THEN 'jsonld' END, CASE WHEN p_partkey % 2 = 0 THEN 'meta' END, CASE WHEN p_partkey % 3 <= 1 THEN 'microdata' END], lambda x: x IS NOT NULL), ',') AS sources
FROM part WHERE p_partkey % 3 <= 1 OR p_partkey % 2 = 0""",
    "product_dedup": "SELECT min(p_partkey) AS p_partkey, p_name, p_brand, p_type, p_size FROM part GROUP BY p_name, p_brand, p_type, p_size",
    "fill_rate": f"SELECT {_HOST} AS host, count(*) AS pages, count(*) FILTER (WHERE NOT contains(lower(html), '</html>')) AS unclosed, 0::BIGINT AS broken_blocks FROM pages GROUP BY 1",
    "fill_rate_products": """SELECT 'shop' || (p_partkey % 7) || '.example.com' AS host, count(*) AS pages, 0::BIGINT AS unclosed, 0::BIGINT AS broken_blocks,
  count(*) FILTER (WHERE p_partkey % 3 = 0) AS with_sku, count(*) FILTER (WHERE p_partkey % 3 <= 1 OR p_partkey % 2 = 0) AS with_name,
  count(*) FILTER (WHERE p_partkey % 3 <= 1 OR p_partkey % 2 = 0) AS with_price,
  count(*) FILTER (WHERE p_partkey % 3 = 0) / CAST(count(*) FILTER (WHERE p_partkey % 3 <= 1 OR p_partkey % 2 = 0) AS DOUBLE) AS share_sku, 1.0::DOUBLE AS share_name, 1.0::DOUBLE AS share_price FROM part GROUP BY 1""",
    "no_product_pages": "SELECT page_id, url FROM pages",
    "extract_stream": f"SELECT *, 0::INTEGER AS n_found FROM ({_FALLBACK})",
    "product_stream": _EXTRACT,
    "incremental_extract": _EXTRACT,
    "nested_products": """SELECT 'katalog.example.com/' || (p_partkey // 6) AS url_key, 'P' || p_partkey AS sku, 'Réd & ' || p_name AS name,
  CASE WHEN p_partkey % 4 < 3 THEN p_brand END AS brand, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, 'EUR' AS currency, 'https://img.example/' || p_partkey AS image FROM part""",
    "identity_closure": """WITH RECURSIVE p AS (
  SELECT p_partkey AS k, CASE WHEN (p_partkey // 2) % 10 <> 0 THEN p_partkey // 2 END AS g, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey + 1) // 2 END AS s FROM part
), e AS (
  SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.g = b.g UNION SELECT a.k, b.k FROM p a JOIN p b ON a.s = b.s
), r AS (
  SELECT k AS src, k AS dst FROM p UNION SELECT r.src, e.b FROM r JOIN e ON e.a = r.dst
)
SELECT src AS p_partkey, min(dst) AS product_id FROM r GROUP BY src""",
    "quality_rollup": """WITH c AS (
  SELECT p_partkey, 'shop' || (p_partkey % 7) || '.example.com' AS host, source FROM part, (VALUES ('jsonld'), ('microdata'), ('meta')) AS v(source)
  WHERE CASE source WHEN 'jsonld' THEN p_partkey % 3 = 0 WHEN 'microdata' THEN p_partkey % 3 <= 1 ELSE p_partkey % 2 = 0 END
)
SELECT host, source, CAST(grouping(host, source) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (WHERE source = 'jsonld') AS with_sku, count(*) AS with_name, count(*) AS with_price
FROM c GROUP BY GROUPING SETS ((host, source), (host), (source), ())""",
    "price_neighbours": """SELECT p_partkey, count(*) OVER near AS n_near, round(avg(p_retailprice) OVER near, 4) AS mean_near,
  count(*) OVER (PARTITION BY p_brand, p_type ORDER BY CAST(round(p_retailprice * 100) AS BIGINT) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_below
FROM part WINDOW near AS (PARTITION BY p_brand, p_type ORDER BY CAST(round(p_retailprice * 100) AS BIGINT) RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING)""",
    "near_prices": """WITH f AS (SELECT p_name, p_brand, p_retailprice AS price, min(p_partkey) AS id FROM part WHERE p_retailprice > 0 GROUP BY ALL)
SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM f a JOIN f b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.price < b.price AND b.price <= a.price * 1.01::DOUBLE""",
    "page_quality": f"""WITH h AS (SELECT {_HOST} AS host, count(*) AS pages, count(*) AS without FROM pages GROUP BY 1)
SELECT host, pages, 0::BIGINT AS with_sku, 0::BIGINT AS with_name, without FROM h
UNION ALL SELECT 'shop' || (p_partkey % 7) || '.example.com', count(*), count(*), count(*), 0 FROM part GROUP BY 1""",
    "product_sketches": """WITH p AS (
  SELECT 'shop' || (p_partkey % 7) || '.example.com' AS host, p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS h FROM part
), u AS (
  SELECT *, CAST(power(10, greatest(length(CAST(h AS VARCHAR)) - 3, 0)) AS BIGINT) AS unit FROM p
), b AS (
  SELECT host, p_partkey, (h + unit // 2) // unit * unit AS bin FROM u
)
SELECT host, count(*) AS n, count(DISTINCT p_partkey) AS n_items, true AS as_whole, true AS near,
  quantile_disc(bin, 0.1) / 100 AS low, quantile_disc(bin, 0.5) / 100 AS median, quantile_disc(bin, 0.9) / 100 AS high
FROM b GROUP BY host""",
    "nested_rows": "SELECT p_partkey AS page_id, 0::INTEGER AS pos, p_name AS name, p_brand AS brand, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM part",
}
