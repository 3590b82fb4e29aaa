"""Work that grows with the rows, whatever their bytes: tasks for pages made of small rows, calls of the table function, passes over html."""

import os
import types

import pytest
from pyspark.sql import functions as F

from pagequarry import queries
from pagequarry.functions.text import decode_entities
from pagequarry.operators import embedded
from pagequarry.plans import incremental
from pagequarry.sources import pages
from pagequarry.sources.pages import spread


@pytest.fixture(scope="module")
def big_dir(spark, sf_dir, tmp_path_factory):
    """``part`` of sf0.001 in 120 copies with keys of their own, as one file that a scan reads in one task."""
    path = str(tmp_path_factory.mktemp("big"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    copies = spark.range(120).withColumnRenamed("id", "copy")
    columns = [(F.col("p_partkey") + F.col("copy") * 1000).alias("p_partkey"), *[c for c in part.columns if c != "p_partkey"]]
    part.crossJoin(copies).select(*columns).coalesce(1).write.parquet(f"{path}/part.parquet")
    spark.read.parquet(f"{sf_dir}/pages.parquet").write.parquet(f"{path}/pages.parquet")
    return path


def test_tasks_grow_with_the_rows_of_pages(spark, big_dir):
    for kind in ("jsonld", "mixed", "nested"):
        shown = queries._rendered(spark, big_dir, kind)
        sizes = [r["count"] for r in shown.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 24_000 and len(sizes) >= 4 and max(sizes) <= 10_000
    one = spark.range(0)
    assert spread(one).count() == 0 and spread(spark.range(95_000)).rdd.getNumPartitions() == 10


def test_table_function_sends_no_batch_a_page(spark, big_dir):
    found = queries.nested_rows(spark, big_dir)
    assert "ArrowEvalPythonUDTF" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 24_000


def test_files_of_a_batch_grow_with_the_pages(spark, big_dir, monkeypatch):
    seen = []

    def recorded(spark, source, sink, checkpoint, files_per_batch):
        seen.append((len([f for f in os.listdir(source) if f.endswith(".parquet")]), files_per_batch))
        return types.SimpleNamespace(awaitTermination=lambda: None)

    monkeypatch.setattr(pages, "ROWS", 2_000)
    monkeypatch.setattr(queries, "latest_stream", recorded)
    monkeypatch.setattr(queries, "stream_products", lambda *_: None)
    monkeypatch.setattr(queries, "_shown", lambda _: None)
    queries.product_stream(spark, big_dir)
    assert seen == [(12, 6), (24, 6)]


def test_page_quality_reads_the_products_once(spark, big_dir):
    plan = queries.page_quality(spark, big_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_nested_items" not in plan


def test_entities_work_their_text_out_once(spark):
    found = spark.createDataFrame([("a &amp; b",)], "x string").select(decode_entities(F.upper("x")).alias("y"))
    assert found._jdf.queryExecution().analyzed().toString().count("upper(") == 1


def _dealt(found):
    """Of each dealing in a plan, the lines from there to its scan."""
    lines = [line.strip(" :+-") for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    starts = [i for i, line in enumerate(lines) if line.startswith("Repartition")]
    return [lines[i : next(j for j in range(i, len(lines)) if lines[j].startswith("Relation")) + 1] for i in starts]


@pytest.mark.parametrize("name", ["incremental_extract", "microdata_nested", "fill_rate_products", "page_quality", "nested_rows"])
def test_pages_are_not_made_below_the_dealing(spark, big_dir, name):
    dealt = _dealt(queries.QUERIES[name](spark, big_dir))
    assert dealt and not [line for below in dealt for line in below if "concat(" in line]


def test_conditions_on_pages_stay_above_the_dealing(spark, big_dir):
    shown = queries._rendered(spark, big_dir, "nested")
    (below,) = _dealt(shown.filter(F.contains("html", F.lit("Brand")) & F.col("url").isNotNull()))
    assert not [line for line in below if "concat(" in line]


def test_print_needs_no_test_for_null(spark):
    held = incremental._printed(spark.createDataFrame([(1, None, None), (2, "", "")], "page_id long, url string, html string"))
    assert not held.schema["print"].nullable
    assert len({r["print"] for r in held.collect()}) == 2


def test_fill_rate_products_makes_pages_twice(spark, big_dir):
    """For the counts of pages and for the products; not once more for their urls."""
    assert len(_dealt(queries.fill_rate_products(spark, big_dir))) == 2


def test_nested_microdata_counts_scopes_once(spark, big_dir):
    plan = queries.microdata_nested(spark, big_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("itemscope\\b") == 1


def test_incremental_extract_reads_no_pages_below_a_limit(spark, big_dir, monkeypatch):
    """A page that is gone is one row from the start: pages and Python below a limit would run on whole tasks for it."""
    seen = []
    real = incremental.update_manifest

    def recorded(shown, manifest=None):
        if manifest is None:
            seen.append(shown)
        return real(shown, manifest)

    monkeypatch.setattr(incremental, "update_manifest", recorded)
    queries.incremental_extract(spark, big_dir)
    (shown,) = seen
    assert "Limit" not in shown._jdf.queryExecution().optimizedPlan().toString()
    assert shown.filter("page_id = -1").count() == 1 and shown.count() == 24_001


def test_product_sketches_makes_all_increments_in_one_pass(spark, tmp_path, sf_dir, monkeypatch):
    """One grouping for the increments and one for the whole, not one an increment; no row of ``part`` gives no row."""
    seen = []
    real = queries.sketches.sketches
    monkeypatch.setattr(queries.sketches, "sketches", lambda products, by, *more: seen.append(by) or real(products, by, *more))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.filter("p_partkey % 50 = 7").write.parquet(f"{tmp_path}/few/part.parquet")
    part.limit(0).write.parquet(f"{tmp_path}/none/part.parquet")
    assert {r["as_whole"] for r in queries.product_sketches(spark, f"{tmp_path}/few").collect()} == {True}
    assert seen == [["host", "part"], ["host"]]
    assert queries.product_sketches(spark, f"{tmp_path}/none").count() == 0


def test_tags_without_the_letters_are_not_searched_for_an_attribute(spark):
    rows = [("<a>",), ("<a content='x'>",), ('<a CONTENT = "y" content=\'x\'>',), ('<a content="" Content=\'z\'>',), ('<a content="">',), ("<a name='n' property=\"p\">",), (None,)]
    held = spark.createDataFrame(rows, "tag string")
    found = held.select(embedded._attribute(F.col("tag"), "content").alias("one"), embedded._attribute(F.col("tag"), "property", "name").alias("either"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Contains(lower(tag") == 3
    assert [tuple(r) for r in found.collect()] == [(None, None), ("x", None), ("y", None), ("z", None), (None, None), (None, "p"), (None, None)]


def test_a_block_is_searched_once(spark):
    """A second time only where the first gave no text: an empty block, or no JSON-LD."""
    script = "<script type='application/ld+json'>"
    rows = [(f"{script}{{}}</script>",), (f"{script}</script>",), ("<p>ld+json</script>",), (f"{script}open",), (f"a</script>{script}1</SCRIPT>{script}2</script>",), (None,)]
    found = spark.createDataFrame(rows, "html string").select(embedded.blocks_of(F.col("html")).alias("b"))
    assert "CASE WHEN RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["b"] for r in found.collect()] == [["{}"], [""], [], [], ["1", "2"], None]


def test_pages_without_the_letters_are_not_searched_for_scopes(spark):
    rows = [("<p>",), ("<p itemscope>",), ("<p ITEMSCOPE><b ItemScope=''>",), ("<p itemscopes xitemscope>",), ("itemſcope",), ("",), (None,)]
    found = spark.createDataFrame(rows, "html string").select(embedded._scopes(F.col("html")).alias("n"))
    assert "CASE WHEN Contains(lower(html" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["n"] for r in found.collect()] == [0, 1, 2, 0, 0, 0, 0]


def test_values_are_told_from_objects_without_a_pattern(spark, big_dir):
    plan = queries.jsonld_products(spark, big_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert r"^[\[{]" not in plan
