"""Tables between the steps of a job, in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again: an executor that is lost afterwards
costs nothing that was written, and numbers that were drawn once stay as they are. Without the setting a local session takes
a temporary folder; a cluster needs one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tapeloom-bars-"))
    return _LOCAL[0]


class Scratch:
    """The written tables of one job; they go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove)

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}-{tag}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone before Python's exit hooks run
            return
