"""Shapes that shops use, one hand-written page each; identity closure, streams and incremental runs."""

import random

from pyspark.sql import functions as F

from pagequarry.functions import text
from pagequarry.operators import closure, prices
from pagequarry.operators.embedded import _nested_items
from pagequarry.plans import extract as plan
from pagequarry.plans import incremental
from pagequarry.shared import fresh_path
from pagequarry.streaming.products import compact, latest_rows, latest_stream, stream_products, upsert

PAGES = "page_id long, url string, html string"


def products(spark, blocks, lang="de"):
    """blocks: JSON of a page each, with a product named by the place in the list."""
    html = [f'<html lang="{lang}"><script type="application/ld+json">{json}</script></html>' for json in blocks]
    rows = plan.extract(spark.createDataFrame([(i, f"https://a.example/{i}", h) for i, h in enumerate(html)], PAGES)).collect()
    return [[r for r in rows if r.url_key == f"a.example/{i}"] for i in range(len(html))]


OFFERS = [
    ('{"price":"0.125","priceCurrency":"EUR"}', "0.13", "EUR"),
    ('{"price":"19.999"}', "20.00", None),
    ('{"price":1.5e3}', "1500.00", None),
    ('{"price":1234.5}', "1234.50", None),
    ('{"price":"1.299,00 €"}', "1299.00", "EUR"),
    ('{"@type":"AggregateOffer","lowPrice":"5.00","highPrice":"9.00","priceCurrency":"USD"}', "5.00", "USD"),
    ('[{"priceSpecification":{"price":"7.25","priceCurrency":"GBP"}},{"price":"8"}]', "7.25", "GBP"),
    ('{"priceSpecification":[{"minPrice":3}]}', "3.00", None),
    ('{"price":{"@value":"4.5"}}', "4.50", None),
    ("[]", None, None),
    ('"see shop"', None, None),
]
VALUES = [
    ('"brand":[{"name":"B"}],"image":[{"url":"u"},"v"]', "B", ["u", "v"]),
    ('"brand":{"@type":"Brand"},"image":{"@type":"ImageObject","contentUrl":"w"}', None, ["w"]),
    ('"brand":"[New] B","image":"x"', "[New] B", ["x"]),
    ('"brand":["P","Q"],"image":[]', "P", []),
    ('"brand":null,"image":{"a":1}', None, []),
]


def test_offers_and_values_by_their_kind(spark):
    blocks = [f'{{"@type":"Product","name":"n","offers":{o}}}' for o, _, _ in OFFERS] + [f'{{"@type":"https://schema.org/Product","name":"n",{v}}}' for v, _, _ in VALUES]
    found = [rows[0] for rows in products(spark, blocks)]
    assert [(None if r.price is None else str(r.price), r.currency) for r in found[: len(OFFERS)]] == [(p, c) for _, p, c in OFFERS]
    assert [(r.brand, r.image_urls) for r in found[len(OFFERS) :]] == [(b, i) for _, b, i in VALUES]


def test_nodes_inside_others(spark):
    json = """[{"@type":"WebPage","mainEntity":{"@type":"ItemList","itemListElement":[{"item":{"@type":"Product","name":"a","sku":"1"}},
      {"@type":"ProductGroup","hasVariant":[{"@type":"Product","name":"b","sku":"2"},{"@type":["x","schema:Product"],"name":"c","sku":"3"}]}]}},{"@type":"Product","name":"d","sku":"4"}]"""
    inside, related = products(spark, [json, '{"@type":"Thing","isRelatedTo":{"@type":"Product","name":"other"}}'])
    assert sorted(r.name for r in inside) == ["a", "b", "c", "d"] and related == []


def test_machine_and_shown_prices_in_microdata(spark):
    scope = '<html lang="de"><div itemscope itemtype="https://schema.org/Product"><b itemprop="name">{}</b>'
    html = [scope.format("given") + '<b itemprop="price" content="19.999">', scope.format("shown") + '<b itemprop="price">19.999</b>', scope.format("deep") + '<p itemprop=offers itemscope><b itemprop="price" content="0.125"></b></p>']
    found = plan.extract(spark.createDataFrame([(i, f"https://a.example/{i}", h) for i, h in enumerate(html)], PAGES)).collect()
    assert {r.name: str(r.price) for r in found} == {"given": "20.00", "shown": "19999.00", "deep": "0.13"}
    assert _nested_items.returnType.elementType.names[0] == "sku"


ENTITIES = {"caf&eacute; &#8364;": "café €", "&#x1F642;": "🙂", "&amp;lt;": "&lt;", "a & b &": "a & b &", "&nothing; &#0; &#xD800; &#9999999;": "&nothing; &#0; &#xD800; &#9999999;", "&Eacute;&AMP;": "É&AMP;", "": "", None: None, "&lt;&gt;&quot;&#39;&apos;": "<>\"''"}


def test_entities(spark):
    df = spark.createDataFrame([(k,) for k in ENTITIES], "t string")
    assert [r.t for r in df.select(text.decode_entities(F.col("t")).alias("t")).collect()] == list(ENTITIES.values())


def test_chains_of_identities(spark):
    good = ["4006381333931", "96385074", "036000291452"]
    rows = [(i, None, "b", f"c{(i + 1) // 2}", f"k{i // 2}") for i in range(50)]
    random.Random(5).shuffle(rows)
    keys = F.array(F.col("sku"), F.col("other"))
    chain = spark.createDataFrame(rows, "id long, gtin string, brand string, sku string, other string")
    assert {(r.id, r.product_id) for r in closure.identity_closure(chain, keys=keys).collect()} == {(i, 0) for i in range(50)}
    rows = [(9, good[0], "X", "1"), (3, good[0], None, None), (7, None, "x", "1"), (4, "4006381333932", "Y", None), (5, "4006381333932", None, "2"), (6, None, "Y", "2"), (6, good[1], None, None), (2, good[1], None, None), (None, good[0], None, None)]
    mixed = spark.createDataFrame(rows, "id long, gtin string, brand string, sku string")
    got = {r.id: r.product_id for r in closure.identity_closure(mixed).collect()}
    assert got == {9: 3, 3: 3, 7: 3, 4: 4, 5: 5, 6: 2, 2: 2}
    merged = {(r.id, r.n_merged) for r in closure.merged_products(mixed).collect()}
    assert merged == {(3, 3), (4, 1), (5, 1), (2, 2), (None, 1)}
    assert closure.identity_closure(mixed.limit(0)).count() == 0


def test_hot_key_closes_in_few_rounds(spark):
    df = spark.range(3000).select("id", F.lit("4006381333931").alias("gtin"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("sku"))
    assert {r.product_id for r in closure.identity_closure(df).collect()} == {0}


def shop(spark, rows):
    """rows: page_id, url number, name."""
    return spark.createDataFrame([(i, f"https://a.example/{u}" if u is not None else None, f'<script type="application/ld+json">{{"@type":"Product","name":"{n}","sku":"{u}"}}</script>' if n else "<html>") for i, u, n in rows], PAGES)


def test_stream_keeps_the_latest_version_over_restarts(spark):
    at = fresh_path(spark, "test-stream")
    parts = [[(5, 1, "five"), (1, 2, "one"), (2, None, "loose")], [(4, 1, "four"), (6, 2, None), (3, None, "free")], [(9, 3, "nine"), (8, 1, "eight")]]
    for rows in parts:
        shop(spark, rows).coalesce(1).write.mode("append").parquet(f"{at}/pages")
        latest_stream(spark, f"{at}/pages", f"{at}/sink", f"{at}/checkpoint", files_per_batch=1).awaitTermination()
    everything = shop(spark, sum(parts, []))
    want = sorted(map(str, plan.extract(everything).collect()))
    assert sorted(map(str, stream_products(spark, f"{at}/sink").collect())) == want and len(want) == 4
    assert {(r.url_key, r.page_id) for r in latest_rows(spark, f"{at}/sink").collect()} == {("a.example/1", 8), ("a.example/2", 6), ("a.example/3", 9), (None, 2), (None, 3)}
    again = spark.read.parquet(f"{at}/sink/batch_id=1")
    again = spark.createDataFrame(again.collect(), again.schema)
    before = sorted(map(str, spark.read.parquet(f"{at}/sink").collect()))
    upsert(f"{at}/sink")(again, 1)
    assert sorted(map(str, spark.read.parquet(f"{at}/sink").collect())) == before
    compact(spark, f"{at}/sink", f"{at}/small")
    assert sorted(map(str, stream_products(spark, f"{at}/small").collect())) == want


def test_only_changed_pages_are_parsed(spark):
    old = shop(spark, [(i, i, f"n{i}") for i in range(20)] + [(99, 99, "gone")])
    new = shop(spark, [(i, i, f"n{i}" if i % 10 else f"new{i}") for i in range(21)] + [(40, None, None)])
    at = fresh_path(spark, "test-manifest")
    incremental.update_manifest(old).write.parquet(at)
    manifest = spark.read.parquet(at)
    assert sorted(r.page_id for r in incremental.changed_pages(new, manifest).collect()) == [0, 10, 20, 40]
    updated = incremental.update_manifest(new, manifest)
    assert sorted(map(str, incremental.products_now(updated).collect())) == sorted(map(str, plan.extract(new).collect()))
    assert incremental.update_manifest(new.limit(0), manifest).count() == 0
    explained = updated._jdf.queryExecution().executedPlan().toString()
    assert explained.index("LeftAnti") > explained.index("_nested_items")  # html is parsed above the join that leaves the changed pages


def test_near_prices_over_band_borders(spark):
    rows = [(i, "k", p) for i, p in enumerate([100.0, 100.9, 101.0, 101.1, 105.0, 0.0, -3.0, None, 100.0])] + [(20, None, 5.0), (21, None, 5.01)]
    df = spark.createDataFrame(rows, "id long, kind string, price double")
    got = {(r.a, r.b) for r in prices.near_prices(df, "id", ["kind"], "price", 1.01).collect()}
    known = [(i, k, p) for i, k, p in rows if p and p > 0 and i != 8]
    assert got == {(min(a, b), max(a, b)) for a, k, p in known for b, other, q in known if k == other and p < q <= p * 1.01}


def test_neighbours_and_rollup(spark):
    df = spark.createDataFrame([(1, "k", 1.0), (2, "k", 1.5), (3, "k", 3.0), (4, "k", None)], "id long, kind string, price double")
    assert {(r.id, r.n_near, r.n_below) for r in prices.price_neighbours(df, ["kind"], "price", 50).collect()} == {(1, 2, 1), (2, 2, 2), (3, 1, 3), (4, None, None)}
    found = spark.createDataFrame([("h", "jsonld", "a"), ("h", "meta", None), (None, "meta", "b")], "host string, source string, name string")
    assert {tuple(r) for r in prices.quality_rollup(found, ["name"]).collect()} == {("h", "jsonld", 0, 1, 1), ("h", "meta", 0, 1, 0), (None, "meta", 0, 1, 1), ("h", None, 1, 2, 1), (None, None, 1, 1, 1), (None, "jsonld", 2, 1, 1), (None, "meta", 2, 2, 1), (None, None, 3, 3, 2)}
