"""Hand-written pages: what the renderer does not produce by itself."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text
from pagequarry.operators import embedded, products
from pagequarry.operators import pages as page_ops
from pagequarry.plans import extract as plan
from pagequarry.sources.pages import rendered


def pages(spark, *html):
    return spark.createDataFrame([(i, f"https://a.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def script(block):
    return f'<html><script type="application/ld+json">{block}</script></html>'


def test_jsonld_shapes_and_broken_blocks(spark):
    rows = embedded.jsonld_products(
        pages(
            spark,
            script('{"@type":"Product","name":"a","offers":{"price":"1.50"}}'),
            script('{"@type":["Thing","Product"],"name":"b","offers":[{"price":2},{"price":3}]}'),
            script('{"@graph":[{"@type":"WebSite"},{"@type":"Product","name":"c &amp; d","brand":"x"}]}'),
            script('{"@type":"Product","name":"cut'),
            script(""),
            script('{"@type":"Product","name":"e",}'),
            "<html><SCRIPT id=1 type='application/ld+json'>[{\"@type\":\"Product\",\"name\":\"f\"}]</SCRIPT>" + script('{"@type":"Product","name":"g"}'),
            script('{"@type":"Product","name":"h </script> i"}'),
            None,
        )
    ).collect()
    assert sorted((r.page_id, r.name, r.price, r.brand) for r in rows) == [(0, "a", "1.50", None), (1, "b", "2", None), (2, "c & d", None, "x"), (6, "f", None, None), (6, "g", None, None)]


def test_offers_object_array_or_none(spark):
    nodes = embedded.jsonld_nodes(embedded.jsonld_blocks(pages(spark, script('{"@type":"Product","offers":[{"price":"1"},{"price":"2"}]}'), script('{"@type":"Product","offers":{"price":"3"}}'), script('{"@type":"Product"}'))))
    assert sorted((r.page_id, r.offer_pos, r.price) for r in embedded.offers(nodes).collect()) == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3"), (2, 0, None)]


def test_nested_scopes(spark):
    html = """<div itemscope itemtype="http://schema.org/Product"><span itemprop="name">A <b>bold</b> one</span>
    <div itemprop=offers itemscope itemtype="http://schema.org/Offer"><span itemprop='price' content='9.5'>nine</span><link itemprop="availability" href="https://schema.org/InStock">
    </div><div itemscope itemtype="http://schema.org/Person"><i itemprop="name">Not the product</i></div><p itemprop="brand">B<br>"""
    (r,) = embedded.microdata_nested(pages(spark, html)).collect()
    assert (r.name, r.price, r.availability, r.brand) == ("A bold one", "9.5", "https://schema.org/InStock", "B")


def test_meta_tags_in_any_order_and_quotes(spark):
    (r,) = embedded.meta_products(pages(spark, """<meta content='say "x"' property='og:title'><META PROPERTY="product:price:amount" CONTENT="5"><meta property="og:title" content="later">""")).collect()
    assert (r.name, r.price) == ('say "x"', "5")


def test_title_and_heading_are_told_apart(spark):
    rows = page_ops.page_fallback(pages(spark, "<html lang=de><title>T &amp; t</title><h1 class='x'>H</h1>", "<html><title></title>", None)).collect()
    assert [(r.title, r.h1, r.lang) for r in sorted(rows, key=lambda r: r.page_id)] == [("T & t", "H", "de"), (None, None, None), (None, None, None)]


@pytest.mark.parametrize(
    ("shown", "lang", "price", "currency"),
    [
        ("$12,345.67", "en", "12345.67", "USD"),
        ("12.345,67 €", "de", "12345.67", "EUR"),
        ("1.299 €", "de", "1299.00", "EUR"),
        ("1.299", None, None, None),
        ("$1,299", None, "1299.00", "USD"),
        ("1.299", "en", "1.30", None),
        ("CHF 1'299.50", None, "1299.50", "CHF"),
        ("1.234.567", None, "1234567.00", None),
        ("7,5 EUR", None, "7.50", "EUR"),
        ("free", "en", None, None),
        (None, "en", None, None),
        ("19.-", "de", "19.00", None),
        ("1 299,00 €", "fr", "1299.00", "EUR"),
    ],
)
def test_prices(spark, shown, lang, price, currency):
    df = spark.createDataFrame([(shown, lang)], "s string, l string")
    r = df.select(text.price(F.col("s"), F.col("l")).alias("p"), text.currency(F.col("s")).alias("c")).first()
    assert (r.p, r.c) == (None if price is None else Decimal(price), currency)


def test_gtins(spark):
    cases = {"4006381333931": True, "4006381333932": False, "96385074": True, "036000291452": True, "10614141000415": True, "123": False, "": False, "40063813339x1": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "g string")
    assert [r.v for r in df.select(text.gtin_valid(F.col("g")).alias("v")).collect()] == list(cases.values())


def test_url_keys(spark):
    cases = {
        "https://www.Shop.example/a.html?utm_source=x&b=2&a=1#top": "shop.example/a?a=1&b=2",
        "http://m.shop.example/a/": "shop.example/a",
        "http://shop.example": "shop.example",
        "https://shop.example/?ref=1&reference=2": "shop.example?reference=2",
        "not a url": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert [r.k for r in df.select(text.url_key(F.col("u")).alias("k")).collect()] == list(cases.values())


def test_latest_page_wins_and_nameless_pages_stay(spark):
    df = spark.createDataFrame([(1, "a"), (3, "a"), (2, "b"), (4, None), (5, None)], "page_id long, url_key string")
    assert sorted(r.page_id for r in page_ops.page_latest(df).collect()) == [2, 3, 4, 5]


def test_sources_by_rank_and_identity(spark):
    columns = "page_id long, source string, source_rank int, pos int, sku string, gtin string, name string, brand string, description string, price string, currency string, availability string, condition string, image_urls array<string>, offers array<string>"
    none = (None, None, None, None, None)
    df = spark.createDataFrame([(1, "meta", 3, 0, "m", None, "meta name", None, None, "3", *none), (1, "jsonld", 1, 0, None, "bad", "json name", None, None, None, *none), (1, "jsonld", 1, 1, None, "later", "b", None, None, None, *none)], columns)
    (r,) = products.merge_sources(df, ["page_id"]).collect()
    assert (r.sku, r.gtin, r.name, r.price, r.sources) == ("m", "bad", "json name", "3", ["jsonld", "meta"])
    rows = spark.createDataFrame([(1, "4006381333931", None, None, "x"), (2, "04006381333931", "b", "s", "y"), (3, None, "b", "s", "z"), (4, "4006381333932", "b", "s", "w"), (5, None, None, None, "x")], "id long, gtin string, brand string, sku string, name string")
    kept = products.product_dedup(rows, products.identity(rows, ["name"]), "id").collect()
    assert sorted(r.id for r in kept) == [1, 3, 5]


def test_several_products_on_a_page_stay_apart(spark):
    lamp = '{"@type":"Product","name":"Lamp","sku":"A","offers":{"price":"10","priceCurrency":"USD"}}'
    chair = '{"@type":"Product","name":"Chair","sku":"B","brand":"X","description":"sits","image":["u","v"],"offers":[{"price":"99","priceCurrency":"USD","itemCondition":"UsedCondition"},{"price":"90"}]}'
    tags = '<meta property="product:brand" content="Site"><meta property="og:title" content="All">'
    flat = '<div itemscope itemtype="https://schema.org/Product"><i itemprop="sku">B</i><b itemprop="gtin13">4006381333931</b></div>'
    found = {(r.url_key, r.sku): r for r in plan.extract(pages(spark, script(f"[{lamp},{chair}]") + tags, script(chair) + tags + flat)).collect()}
    assert {k: (r.name, r.brand, str(r.price), r.gtin, len(r.offers)) for k, r in found.items()} == {
        ("a.example/0", "A"): ("Lamp", None, "10.00", None, 1),
        ("a.example/0", "B"): ("Chair", "X", "99.00", None, 2),
        ("a.example/1", "B"): ("Chair", "X", "99.00", "4006381333931", 2),
    }
    chairs = found["a.example/0", "B"]
    assert (chairs.description, chairs.image_urls, chairs.condition, [str(o.price) for o in chairs.offers]) == ("sits", ["u", "v"], "USED", ["99.00", "90.00"])


def test_broken_blocks_are_counted_and_latest_version_counts(spark):
    rows = page_ops.fill_rate(pages(spark, script("{"), script("{}"), None)).collect()
    assert [(r.pages, r.broken_blocks) for r in rows] == [(3, 1)]
    two = pages(spark, script('{"@type":"Product","name":"old"}'), script('{"@type":"Product","name":"new"}'), None).withColumn("url", F.lit("https://a.example/x"))
    assert [r.name for r in plan.extract(two.filter("page_id < 2")).collect()] == ["new"]
    assert plan.extract(two).count() == 0


def test_html_is_read_once(spark, sf_dir):
    explained = plan.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert explained.count("FileScan") == 1


def test_pages_without_products_give_none(spark, sf_dir):
    found = plan.candidates(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert found.count() == 0


def test_result_is_the_same_for_any_partitioning(spark, sf_dir):
    shown = rendered(spark.read.parquet(f"{sf_dir}/part.parquet"), "mixed").unionByName(rendered(spark.read.parquet(f"{sf_dir}/part.parquet"), "nested").withColumn("page_id", F.col("page_id") + 100000))
    one, many = (sorted(map(str, plan.extract(shown.repartition(n)).collect())) for n in (1, 7))
    assert one == many and len(one) > 0


def test_plan_reads_only_what_it_needs(spark, sf_dir):
    from pagequarry import queries

    explained = queries.url_key(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in explained.split("ReadSchema")[-1]


def test_meta_tags_without_a_price_count(spark):
    from pagequarry.plans.extract import extract as extract_products

    tag = lambda k, v: f'<meta property="{k}" content="{v}">'
    jsonld = '<script type="application/ld+json">{"@type": "Product", "sku": "a2", "name": "N", "offers": {"price": "5", "priceCurrency": "EUR"}}</script>'
    html = [
        tag("og:title", "Gone") + tag("product:retailer_item_id", "a1") + tag("product:availability", "sold out"),
        jsonld + tag("product:brand", "Acme"),
        tag("og:title", "An article"),
    ]
    pages = spark.createDataFrame([(i, f"https://shop.example/{i}", f"<html><head>{h}</head></html>") for i, h in enumerate(html)], "page_id long, url string, html string")
    found = {r.url_key[-1]: r for r in extract_products(pages).collect()}
    assert set(found) == {"0", "1"}
    assert (found["0"].sku, found["0"].price, found["0"].availability) == ("a1", None, "OUT_OF_STOCK")
    assert (found["1"].sku, found["1"].brand) == ("a2", "Acme")
