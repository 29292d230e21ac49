"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts the lineage like ``checkpoint()`` does, survives lost executors, and stays
columnar, so later jobs read only the columns they need.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error elsewhere."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", found)
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Named tables of one run: ``save`` writes and rereads, ``drop`` deletes what is no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracewell/{label}-{uuid.uuid4().hex}"
        self.folders: dict[str, str] = {}
        atexit.register(self._forget)

    def partitioned(self, name: str, column: str) -> None:
        """The table of this name, once it is saved, has a folder for each value of the column."""
        self.folders[name] = column

    def save(self, df: DataFrame, name: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if name in self.folders:
            writer = writer.partitionBy(self.folders[name])
        writer.parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _forget(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # the JVM may be gone by now; the folder's owner clears it then
            pass
