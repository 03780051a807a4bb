"""Reading the tables of a data folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over at least as many tasks as there are cores, for work that
    costs far more than its bytes tell. A table that already comes in as many
    parts is left as it is, and so is what a shuffle brings (to count its parts
    would run it)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"^[\s:+|-]*(Join|Aggregate|Window|Sort|Repartition\w*|RebalancePartitions|GlobalLimit|Deduplicate|Distinct)\b", plan, re.M):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
