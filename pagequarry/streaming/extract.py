"""Extraction on a stream of page files: no state, each page gives its candidates as it comes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagequarry.plans.extract import read_pages
from pagequarry.sources.pages import page_stream


def extract_stream(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """One query over the files in ``source``, until all are read: ``page_id, title, h1, lang, found`` (the candidates) to ``sink``."""
    found = read_pages(page_stream(spark, source), with_fallback=False)
    return found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
