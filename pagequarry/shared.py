"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Written:
    """Tables of one run; those written go when the run ends, the one to be ``kept`` for its result when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Written:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            held, system = self._file(path)
            system.delete(held, True)

    def _file(self, path: str):
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return held, held.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __call__(self, df: DataFrame, name: str, kept: bool = False) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        if kept:
            held, system = self._file(path)
            system.deleteOnExit(held)
        else:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)
