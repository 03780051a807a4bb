"""What changed between two states, and bursts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """``key, change``: ``A`` for keys only in the new table, ``D`` for those
    only in the old, ``M`` for those whose state differs (a null state differs
    from any other). Each key counts once; of several rows with different
    states all states are compared as a set. Null keys are skipped."""
    side = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce(F.col(state).cast("string"), F.lit("\0")))).alias(name))
    both = side(old, "old").join(side(new, "new"), key, "full_outer")
    change = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def changed_since(files: DataFrame, moment, mtime: str = "mtime") -> DataFrame:
    """Rows with a time after the moment; a null time counts as unchanged."""
    return files.where(F.col(mtime) > F.lit(moment))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """``key, first, last, n``: bursts of events of a key with less than
    ``gap`` between neighbours. Null keys and times are skipped, repeated
    events count as often as they come."""
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("timestamp").alias("_at"))
    burst = rows.groupBy(key, F.session_window("_at", gap)).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("n"))
    return burst.select(key, "first", "last", "n")


def attribute_sites(spans: DataFrame, sites: DataFrame, innermost: bool = False) -> DataFrame:
    """``site, owner``: for each site (``file, at, site``) the span (``file,
    start, stop, id, ord``; the stop is outside) that holds it: the first by
    ``ord`` and id, or the shortest. Sites in no span are dropped.

    Spans and sites of a file are sorted into one stream; each bucket of the
    file's offsets is its own group, so a huge file is spread over many.
    """
    width = 4096
    low = F.floor(F.col("start") / width).cast("int")
    high = F.floor(F.greatest(F.col("stop") - 1, F.col("start")) / width).cast("int")
    cut = spans.where("file IS NOT NULL AND start < stop").withColumn("bucket", F.explode(F.sequence(low, high)))
    met = sites.where("file IS NOT NULL AND at IS NOT NULL").withColumn("bucket", F.floor(F.col("at") / width).cast("int")).join(cut, ["file", "bucket"])
    order = F.struct(F.col("stop") - F.col("start"), "ord", "id") if innermost else F.struct("ord", "id")
    return met.where("at >= start AND at < stop").groupBy("site").agg(F.min_by("id", order).alias("owner"))

