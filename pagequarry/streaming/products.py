"""Products from a stream of pages: the latest version of each page is kept as state, changes go to a sink that takes a batch twice without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators import pages as page_ops
from pagequarry.plans.extract import products_of, read_pages
from pagequarry.sources.pages import page_stream

BATCH = "batch_id"


def upsert(sink: str):
    """A writer for ``foreachBatch``: each batch has a folder named by its id, which a repeated batch overwrites with the same rows."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")

    return write


def latest_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 8) -> StreamingQuery:
    """``url_key, page_id, lang, found`` of every page whose latest version a batch has changed, to ``sink``, until all files in ``source`` are read.

    The state is one row per page, without its html: what was found in the version with the highest ``page_id``, so files may come in any order. A restart from
    ``checkpoint`` goes on where the last one ended. A page without a ``url_key`` is its own latest version."""
    held = read_pages(page_ops.with_url_key(page_stream(spark, source, files_per_batch)), "url_key")
    own = F.when(F.col("url_key").isNull(), F.col("page_id")).alias("own")
    latest = held.groupBy("url_key", own).agg(F.max_by(F.struct("page_id", "lang", "found"), "page_id").alias("p")).select("url_key", "p.*")
    return latest.writeStream.outputMode("update").foreachBatch(upsert(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, sink: str) -> DataFrame:
    """``url_key, page_id, lang, found``: of each page what the last batch with it says."""
    rows = spark.read.parquet(sink)
    own = F.when(F.col("url_key").isNull(), F.col("page_id")).alias("own")
    return rows.groupBy("url_key", own).agg(F.max_by(F.struct("page_id", "lang", "found"), BATCH).alias("p")).select("url_key", "p.*")


def compact(spark: SparkSession, sink: str, into: str) -> None:
    """Write the latest rows of ``sink`` to a new sink, as the batch before all others."""
    latest_rows(spark, sink).write.mode("overwrite").parquet(f"{into}/{BATCH}=-1")


def stream_products(spark: SparkSession, sink: str) -> DataFrame:
    """What ``extract`` gives for all pages that have come so far."""
    return products_of(latest_rows(spark, sink))
