"""References whose target does not exist at the time of the reference.

References and the begin and end of every target's validity are brought to
the same partition by key, sorted by time and merged in one pass: a running
sum says how many intervals are open when a reference comes by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.keys import BLANKS, clean_name, pack_id
from symloom.plans.scratch import Scratch

#: References of one key that a task is to hold: a key with more is split into
#: as many parts as that takes, however large its share is.
PART_ROWS = 100_000
#: The list of such keys (some 30 bytes each) is broadcast up to this length;
#: beyond it, it is joined by a shuffle, in which skew of a key is split.
BROADCAST_KEYS = 200_000


def intervals(parents: DataFrame, key: Column, start: str = "indexed_at", end: str = "deleted_at") -> DataFrame:
    """``(key, start, end)`` of the targets, copies and equal ends merged.

    Intervals of one key with the same end (or open ones) collapse to the
    longest, combined on the map side, so that a name borne by very many
    symbols stays small. Empty intervals and null keys or starts are dropped.
    """
    return (
        parents.select(key.alias("key"), F.col(start).alias("start"), F.col(end).alias("end"))
        .where(F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
        .groupBy("key", "end")
        .agg(F.min("start").alias("start"))
        .select("key", "start", "end")
    )


def classify_references(refs: DataFrame, targets: DataFrame, part_rows: int = PART_ROWS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Every row of ``refs`` (``key, t, ...``) with a ``status``.

    ``present``: a target interval holds ``t`` (start inclusive, end
    exclusive). ``deleted``: none does, but one began before. ``late``: all
    begin after ``t``. ``missing``: the key has no interval at all. Null keys
    are no references and dropped; a null ``t`` counts as after everything.
    Column names other than key and t are passed through. The references of
    a key are split into parts of about ``part_rows``; its intervals, which
    :func:`intervals` has merged, go to each of them.
    """
    rest = [c for c in refs.columns if c not in ("key", "t")]
    refs = refs.where(F.col("key").isNotNull())
    counts = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows)
    split = Scratch(refs.sparkSession, "orphans").cut(counts.select("key", F.ceil(F.col("n") / F.lit(part_rows)).cast("int").alias("n_salts")), n=F.count(F.lit(1)))
    hot = F.broadcast(split.df) if (split.seen["n"] or 0) <= broadcast_keys else split.df
    mine = refs.join(hot, "key", "left").select(
        "key",
        F.when(F.col("n_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rest, "t"), F.col("n_salts"))).cast("int").alias("salt"),
        "t",
        F.lit(0).alias("delta"),
        F.struct(*[F.col(c) for c in rest]).alias("ref"),
    )
    steps = F.filter(
        F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("delta"))),
        lambda s: s["t"].isNotNull(),
    )
    theirs = (
        targets.join(hot, "key", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1)))
        .withColumn("step", F.explode(steps))
        .select(
            "key", "salt", F.col("step.t").alias("t"), F.col("step.delta").alias("delta"),
            F.lit(None).cast(mine.schema["ref"].dataType).alias("ref"),
        )
    )
    group = Window.partitionBy("key", "salt")
    so_far = group.orderBy(F.col("t").asc_nulls_last(), F.col("ref").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    merged = mine.unionByName(theirs).select(
        "*",
        F.sum("delta").over(so_far).alias("open"),
        F.sum(F.greatest("delta", F.lit(0))).over(so_far).alias("begun"),
        F.max(F.col("delta") > 0).over(group).alias("ever"),
    )
    status = (
        F.when(F.col("open") > 0, "present").when(F.col("begun") > 0, "deleted").when(F.col("ever"), "late").otherwise("missing")
    )
    return merged.where(F.col("ref").isNotNull()).select("ref.*", "key", "t", status.alias("status"))



def orphans(
    edges: DataFrame, refs: DataFrame, symbols: DataFrame, stdlib: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """References without a target, of ``edges.dst``, ``refs.src`` and ``refs.to_name``.

    Columns: ``ref_table, ref_field, ref_seq, t, status`` with status
    ``missing``, ``deleted`` or ``late``; copies of a reference appear once.
    Values are compared whole (ids) or by :func:`clean_name` (names); null,
    empty and blank values are no references. Empty tables give no rows, or
    orphans only when the target tables are empty. Extra columns are ignored.
    """
    named = F.lit("n").cast("binary")

    def one(df: DataFrame, table: str, field: str, seq: str, key: Column) -> DataFrame:
        value = F.col(field)
        return df.where(value.isNotNull() & (F.btrim(value, F.lit(BLANKS)) != "")).select(
            key.alias("key"), F.col("indexed_at").alias("t"), F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(seq).alias("ref_seq")
        )

    name_key = lambda c: F.concat(named, F.encode(clean_name(c), "UTF-8"))
    asked = (
        one(edges, "edges", "dst", "seq", pack_id("dst"))
        .unionByName(one(refs, "refs", "src", "ref_seq", pack_id("src")))
        .unionByName(one(refs, "refs", "to_name", "ref_seq", name_key("to_name")))
    )
    span = ("id", "name", "indexed_at", "deleted_at")
    parents = symbols.select(*span).unionByName(stdlib.select(*span))
    keyed = parents.select(
        F.explode(F.array(pack_id("id"), name_key("name"))).alias("key"), "indexed_at", "deleted_at"
    )
    found = classify_references(asked, intervals(keyed, F.col("key")), part_rows).where(F.col("status") != "present")
    return found.select("ref_table", "ref_field", "ref_seq", "t", "status").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, day (as yyyy-mm-dd) and status; a null time
    has a null day."""
    return found.groupBy("ref_table", "ref_field", F.date_format("t", "yyyy-MM-dd").alias("day"), "status").agg(F.count(F.lit(1)).alias("n"))
