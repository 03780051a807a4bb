"""Intermediate tables in the folder all executors share.

Iterative plans cut their lineage by writing a table and reading it back, so
a lost executor never forces earlier rounds to run again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the session has one; in local mode without
    it, a temporary folder that is set for the rest of the session. A cluster
    without the setting is an error, as no machine-local folder is shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="symloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Named tables below one fresh folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def cut(self, df: DataFrame, **seen: Column) -> Table:
        """Write ``df`` and return the written table. ``seen`` are aggregates
        that are taken while the rows are written, without a job of their own."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        schema, watch = df.schema, Observation() if seen else None
        if watch:
            df = df.observe(watch, *[c.alias(n) for n, c in seen.items()])
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if self._n == 1:
            target, files = self._at(self.root)
            files.deleteOnExit(target)  # what a lazy result still reads goes with the session
        return Table(self, path, schema, watch.get if watch else {})

    def _at(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        target, files = self._at(path)
        files.delete(target, True)


class Table:
    def __init__(self, scratch: Scratch, path: str, schema, seen: dict) -> None:
        self.scratch, self.path, self.schema, self.seen = scratch, path, schema, seen

    @property
    def df(self) -> DataFrame:
        return self.scratch.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Free the disk; only after every plan over the table has run."""
        self.scratch._delete(self.path)


