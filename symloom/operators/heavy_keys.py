"""Per-key results where a few keys hold most rows.

Rows are first compressed to value frequencies: one row per key *and* value
with its weight. That grouping spreads even a key with a third of all rows
over every task, and both groupings combine on the map side, so the second
one, per key, moves at most one row per key and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.keys import pack_id, unpack_id


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per key and value with its weight ``w``; a null value is a
    value of its own, rows with a null key are kept under the null key."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("w"), *extra)


def pair_stats(edges: DataFrame, to: str = "dst", kind: str = "kind", caller: str = "src", at: str = "indexed_at") -> DataFrame:
    """Per pair of target and kind: edges, distinct callers, first and last sight.

    Columns: ``dst, kind, n_edges, n_callers, first_seen, last_seen``. Copies
    of a row count as rows. A pair with a null part gets no row; null callers
    add edges but no caller; null times are skipped. An empty table gives an
    empty result; further columns are ignored.
    """
    rows = edges.select(
        pack_id(to).alias("_to"), F.col(kind).alias("_kind"), pack_id(caller).alias("_from"), F.col(at).alias("_at")
    ).where(F.col("_to").isNotNull() & F.col("_kind").isNotNull())
    freq = value_frequencies(rows, ["_to", "_kind"], "_from", [F.min("_at").alias("_lo"), F.max("_at").alias("_hi")])
    per_key = freq.groupBy("_to", "_kind").agg(
        F.sum("w").alias("n_edges"),
        F.count("_from").alias("n_callers"),
        F.min("_lo").alias("first_seen"),
        F.max("_hi").alias("last_seen"),
    )
    return per_key.select(
        unpack_id("_to").alias("dst"), F.col("_kind").alias("kind"), "n_edges", "n_callers", "first_seen", "last_seen"
    )


def heavy_pairs(edges: DataFrame, share: float = 0.015) -> DataFrame:
    """The pairs that hold at least ``share`` of all rows, null ones included
    in the total. An empty table has no heavy pair."""
    total = edges.count()
    return pair_stats(edges).where(F.col("n_edges") >= F.lit(share) * F.lit(total))


def weighted_mode(freq: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key from value frequencies; of equally
    frequent ones the smallest. Null values never win."""
    best = F.min(F.struct((-F.col("w")).alias("neg"), F.col(value).alias("v"))).alias("_best")
    return (
        freq.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(best)
        .select(*keys, F.col("_best.v").alias("mode"), (-F.col("_best.neg")).alias("mode_w"))
    )


def weighted_percentiles(freq: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles per key from value frequencies. Meant
    for values with a bounded number of distinct ones (days, hours, sizes in
    classes): the state per key is one entry per distinct value."""
    return freq.groupBy(*keys).agg(
        F.percentile(F.col(value), F.array(*[F.lit(p) for p in ps]), F.col("w")).alias("percentiles")
    )
