"""A corpus pipeline from raw documents to packed sequences: quality, lines, near-duplicates, repeats, packing.

Every stage takes null ids, null, empty and very long texts, repeated rows, empty tables and further columns of any name: an empty table
gives an empty one, further columns pass through (but for the last stage, which leaves them out), and ``n_chars`` follows the text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import common, line_dedup, ngram_join, packing, quality, suffix_dedup


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps. Null texts are scored as empty; a rejected document goes with all rows
    that repeat its id and text; a score at the threshold stays; without labels of both classes all stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of repeated three-line windows, later by id, then place. Null texts stay null; rows
    that repeat id and text come out alike."""
    return _counted(line_dedup.dedup_lines(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles and a similarity of 0.8 or more: the smallest id. Rows that repeat id and
    text come out once; texts without words, null ones too, are in no group; a row without an id stays only where its group has none."""
    return ngram_join.one_of_each(docs, size=5, num=80, den=100)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that start more than once, characters that a cut runs through kept whole. Null
    texts stay null; rows that repeat lose what they share."""
    return _counted(suffix_dedup.dedup_text(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their ids, packed into sequences of 1024 tokens. Null and empty texts are the end id alone; repeated rows are
    packed as often as they occur; of equal lengths the order of the scan decides."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can express a trained classifier or a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """Each stage's output is written to ``out`` (default: a new folder in the shared one) under the stage's name and
    read from there by the next. So the texts that the pieces' places refer to stay at hand."""
    out = out or f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        df = stage(spark, docs, sf_dir)
        df.write.option("compression", "zstd").parquet(f"{out}/{name}")
        docs = spark.read.schema(df.schema).parquet(f"{out}/{name}")
    return docs
