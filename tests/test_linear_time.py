"""No page, however broken, may take longer than its length allows."""

import time

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import embedded
from pagequarry.operators import pages as page_ops
from pagequarry.plans import extract as plan

SIZE = 60_000
SCOPE = '<div itemscope itemtype="https://schema.org/Product">'
TAILS = {
    "opened": "<",
    "meta": "<meta ",
    "meta_property": '<meta property="og:title ',
    "script": "<script ",
    "ld_json": '<script type="application/ld+json">',
    "double_quotes": '<b title="',
    "single_quotes": "<b title='",
    "empty_quotes": '<meta ""',
    "quoted_opens": '<meta "<b" ',
    "itemprop": "<b itemprop=name ",
    "spaces": "<b itemprop" + " " * 50,
    "entities": "&amp",
    "title": "<title ",
    "many_products": '{"@type":"Product","item":',
}


def test_broken_pages_take_linear_time(spark):
    tails = [(t * (SIZE // len(t) + 1))[:SIZE] for t in TAILS.values()]
    html = [f"<html>{SCOPE}<h1 itemprop=name>n{t}" for t in tails] + [f'<script type="application/ld+json">{t}</script>' for t in tails]
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    read = plan.read_pages(pages)
    read.filter("page_id < 0").collect()  # plans and classes
    began = time.time()
    assert len(read.collect()) == 2 * len(TAILS)
    assert time.time() - began < 30  # quadratic regular expressions took minutes for each


@pytest.mark.parametrize("tag", ["<b itemprop=x>", "<b itemscope>", "</i>", "<!--", "<b><i>", '<p itemprop="'])
def test_nested_scopes_take_linear_time(tag):
    parser = embedded._Items()
    text = SCOPE + "<div itemprop=offers itemscope>" + (tag * (SIZE // len(tag)))
    began = time.time()
    parser.feed(text)
    assert time.time() - began < 5


def test_deep_json_is_read_by_its_own_depth(spark):
    depth = 60
    block = '{"@type":"ItemList","item":' * depth + '{"@type":"Product","name":"deep"}' + "}" * depth
    pages = spark.createDataFrame([(1, "u", f'<script type="application/ld+json">{block}</script>')], "page_id long, url string, html string")
    assert [r.name for r in embedded.jsonld_products(pages).collect()] == ["deep"]


def test_quoted_opens_and_closes_belong_to_the_tag(spark):
    html = """<meta property="og:title" content="a < b > c"><meta content='x > "y"' property="product:brand"><meta property="product:price:amount" content="5">"""
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    (r,) = embedded.meta_products(pages).collect()
    assert (r.name, r.brand, r.price) == ("a < b > c", 'x > "y"', "5")
    flat = f'{SCOPE}<b title="1 > 0" itemprop="name">N<b></b><img itemprop=image src="https://i.example/1"><link itemprop="availability" href="https://schema.org/InStock"></div>'
    (r,) = embedded.microdata_products(pages.withColumn("html", F.lit(flat))).collect()
    assert (r.name, r.image_urls, r.availability) == ("N", ["https://i.example/1"], "https://schema.org/InStock")


def test_unclosed_scripts_and_others_between(spark):
    html = '<script>var a = 1</script><script type="application/ld+json">{"a":1}</script><SCRIPT TYPE=application/ld+json id=x>{"b":2}</SCRIPT ><script type="application/ld+json">{"never":'
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.pos, r.block) for r in embedded.jsonld_blocks(pages).collect()) == [(1, 0, '{"a":1}'), (1, 1, '{"b":2}')]
    assert page_ops.page_fallback(pages).count() == 3
