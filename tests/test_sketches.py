"""Sketches that merge, and the table function over nested microdata."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import embedded, sketches
from pagequarry.sources.pages import rendered

SCHEMA = "host string, source string, sku string, price decimal(18,2)"


def seen(df, *by):
    """What a table of sketches says, by group."""
    shown = [sketches.distinct_items(F.col("items")).alias("items"), *[sketches.quantile(F.col("prices"), q).alias(f"q{i}") for i, q in enumerate((0.0, 0.25, 0.5, 0.99, 1.0))]]
    return {tuple(r[b] for b in by): tuple(r)[len(by) :] for r in df.select(*by, "n", "n_priced", "prices", *shown).collect()}


@pytest.fixture(scope="module")
def offers(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice("xy"), f"s{rng.randrange(50_000)}", None if i % 11 == 0 else f"{math.exp(rng.uniform(-3, 12)):.2f}") for i in range(9000)]
    df = spark.createDataFrame(rows, "host string, source string, sku string, price string")
    return df.withColumn("price", F.col("price").cast("decimal(18,2)")).cache()


def test_merged_sketches_say_what_one_over_all_rows_says(offers):
    whole = seen(sketches.sketches(offers, ["host"], "sku", "price"), "host")
    parts = [sketches.sketches(offers.filter(F.pmod(F.xxhash64("sku", "price"), F.lit(4)) == i), ["host", "source"], "sku", "price") for i in range(4)]
    held = parts[0]
    for part in parts[1:]:
        held = held.unionByName(part)
    assert seen(sketches.merge_sketches(held, ["host"]), "host") == whole
    assert seen(sketches.merge_sketches(sketches.merge_sketches(held, ["host", "source"]), ["host"]), "host") == whole
    assert set(whole) == {("a",), ("b",), (None,)}


def test_error_against_exact_counts(offers):
    rows = offers.collect()
    for (host,), found in seen(sketches.sketches(offers, ["host"], "sku", "price"), "host").items():
        own = [r for r in rows if r.host == host]
        prices = sorted(r.price for r in own if r.price)
        n, n_priced, bins, items, *got = found
        assert (n, n_priced) == (len(own), len(prices)) and sum(b.n for b in bins) == len(prices)
        different = len({r.sku for r in own})
        assert abs(items - different) <= 0.05 * different
        for q, value in zip((0.0, 0.25, 0.5, 0.99, 1.0), got, strict=True):
            exact = float(prices[max(math.ceil(q * len(prices)) - 1, 0)])
            assert abs(value - exact) <= 0.00501 * exact + 1e-9


def test_odd_sketches(spark):
    rows = [("a", "x", None, None), ("a", "x", None, "0.00"), ("a", "x", "s", "-3.00"), ("b", "x", "s", "999.50"), ("b", "x", "s", "999.49"), ("b", "x", "t", "9999999999999999.99"), ("b", "x", "t", "0.01")]
    df = spark.createDataFrame(rows, "host string, source string, sku string, price string").withColumn("price", F.col("price").cast("decimal(18,2)"))
    held = sketches.sketches(df, ["host"], "sku", "price")
    found = seen(held, "host")
    assert found[("a",)][:2] == (3, 0) and found[("a",)][3] == 1 and found[("a",)][4:] == (None,) * 5
    assert [tuple(p) for p in found[("b",)][2]] == [(1, 1), (99900, 1), (100000, 1), (10**18, 1)]
    assert seen(sketches.merge_sketches(held, ["host"]), "host") == found
    empty = sketches.sketches(df.limit(0), ["host"], "sku", "price")
    assert empty.count() == 0 and sketches.merge_sketches(empty, ["host"]).count() == 0


def test_table_function_gives_the_rows_of_the_candidates(spark, sf_dir):
    pages = rendered(spark.read.parquet(f"{sf_dir}/part.parquet"), "nested")
    two = F.concat("html", "html")
    pages = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, two).when(F.col("page_id") % 7 == 1, None).when(F.col("page_id") % 7 == 2, "<p>no product</p>").otherwise(F.col("html")))
    found = embedded.nested_rows(pages)
    fields = ["page_id", "sku", "name", "brand", "price", "currency"]
    want = sorted(map(repr, embedded.microdata_nested(pages).select(*fields).collect()))
    assert sorted(map(repr, found.select(*fields).collect())) == want
    assert found.filter("pos = 1").count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == plan.count("PythonUDTF") == 1
