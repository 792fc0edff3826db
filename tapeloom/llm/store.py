"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again: an executor that is lost
afterwards costs nothing that was written. Where the setting is missing (tests, local mode) a temporary folder is used.
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
        _LOCAL.append(tempfile.mkdtemp(prefix="tapeloom-"))
    return "file://" + _LOCAL[0]


class Scratch:
    """Tables of one operator run. ``cut`` writes and rereads one; ``drop`` removes it once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[str, str] = {}
        atexit.register(self._remove, self.folder)

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.folder}/{tag}-{len(self._paths)}"
        df.write.parquet(path)
        self._paths[tag] = path
        del df
        # Shuffle files of the stages just written go once the JVM sees that nothing refers to them.
        self.spark.sparkContext._jvm.System.gc()
        found = self.spark.read.parquet(path)
        return found

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._remove(self._paths.pop(tag))
            self._paths[f"{tag} gone {len(self._paths)}"] = ""

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # at exit the JVM may be gone
            if not path.startswith("file:"):
                return
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
