"""Keeping an index current, and bursts of events, with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.plans.scratch import shared_dir
from symloom.sources import fs


def watch(spark: SparkSession, refresh: Callable[[], object], every: str = "2 seconds", checkpoint: str | None = None, errors: list | None = None) -> StreamingQuery:
    """Call ``refresh`` once per micro-batch of a clock. The batch interval is
    the debounce: all changes since the last batch are met at once and none is
    lost, deletions included. An error is kept in ``errors`` and the loop goes
    on; ``stop()`` on the result ends it."""

    def one(_: DataFrame, __: int) -> None:
        try:
            refresh()
        except Exception as e:  # noqa: BLE001  the watch must outlive a bad state
            if errors is None:
                raise
            errors.append(e)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    where = checkpoint or f"{shared_dir(spark)}/watch-{uuid.uuid4().hex[:8]}"
    return clock.writeStream.foreachBatch(one).option("checkpointLocation", where).trigger(processingTime=every).start()


def session_stream(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a stream of events; rows later than ``late`` are left out."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    burst = rows.groupBy(key, F.session_window("_at", gap)).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("n"))
    return burst.select(key, "first", "last", "n")


def run_available(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming plan over what is there now and return its result. It
    goes through a written table, not through memory, in append mode."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:8]}"
    if mode == "append":
        df.writeStream.format("parquet").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/out")
    last: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out-{n}")
        last[:] = [f"{base}/out-{n}"]

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(*last) if last else spark.createDataFrame([], df.schema)


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder, or of one file's name in its folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if fs.is_file(spark, path):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)
