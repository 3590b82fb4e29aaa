"""Extraction that parses only what has changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import pages as page_ops
from pagequarry.plans.extract import latest_of, products_of, read_pages

KEYS = ["page_id", "print"]


def _printed(pages: DataFrame) -> DataFrame:
    """Pages with a digest of url and html, nulls told from empty texts. It is never null, and says so: else a join by it would work it out
    once more, to leave nulls out."""
    return pages.withColumn("print", F.coalesce(F.sha2(F.to_json(F.struct("url", "html")), 256), F.lit("")))


def changed_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``pages`` with ``print``, of those whose id or content the manifest doesn't know."""
    return _printed(pages).join(manifest.select(*KEYS), KEYS, "left_anti")


def update_manifest(pages: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """The manifest of ``pages`` now: ``page_id, print, url_key, lang, found``, a row per page.

    What the last manifest knows is taken from there; html is parsed of new and changed pages only. Pages that are gone leave it. Rows that
    repeat an id and content stay as many as they are in ``pages`` when first read, and once each when taken over."""
    fields = [*KEYS, "url_key", "lang", "found"]
    if manifest is None:
        return read_pages(page_ops.with_url_key(_printed(pages)), "print", "url_key").select(*fields)
    fresh = read_pages(page_ops.with_url_key(changed_pages(pages, manifest)), "print", "url_key").select(*fields)
    still = manifest.dropDuplicates(KEYS).join(_printed(pages).select(*KEYS).distinct(), KEYS, "left_semi").select(*fields)
    return still.unionByName(fresh)


def products_now(manifest: DataFrame) -> DataFrame:
    """What ``extract`` gives for the pages of a manifest."""
    return products_of(latest_of(manifest))
