"""What the operators share: the shared folder, bounded Arrow slices, a key for documents."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master; on a cluster an
    error, as executors share no folder of the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Tables:
    """Tables of one run in the shared folder: what is ``written`` goes when the run ends, what is ``kept`` for the
    result, which is read later, when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            held, system = self._file(path)
            system.delete(held, True)

    def _file(self, path: str):
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return held, held.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends, and lost executors cost nothing."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return self._write(df, path)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        held, system = self._file(path)
        df = self._write(df, path)
        system.deleteOnExit(held)
        return df


def slices(batch: pa.RecordBatch, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that what Python holds at once stays small, however long the texts are."""
    rows = SLICE_ROWS
    if text is not None and batch.num_rows:
        mean = batch.column(batch.schema.get_field_index(text)).nbytes / batch.num_rows
        rows = max(1, min(rows, int(SLICE_BYTES / max(mean, 1))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # workers live on between stages; what Arrow keeps would add up


def columns(batch: pa.RecordBatch) -> dict[str, list]:
    return {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that name a document by id and text; rows that repeat both share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on; whatever else a table carries can't clash with its own names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table of ``Tables.kept`` by itself."""
    return Tables(df.sparkSession).kept(df, name)
