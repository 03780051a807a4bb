"""Queries of the general operators over the tables of the code-graph index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.keys import clean_kind, pack_id, unpack_id
from symloom.operators import forest, heavy_keys, orphans
from symloom.plans.tables import table


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "edges").withColumn("kind", clean_kind("kind"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys.heavy_pairs(_edges(spark, sf)).select("dst", "kind")


def p2_pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys.pair_stats(_edges(spark, sf))


def p2_caller_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _edges(spark, sf).where("dst IS NOT NULL AND kind IS NOT NULL")
    freq = heavy_keys.value_frequencies(rows, ["dst", "kind"], "src")
    return heavy_keys.weighted_mode(freq, ["dst", "kind"], "src").withColumnRenamed("mode", "src").withColumnRenamed("mode_w", "n")


def p2_day_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _edges(spark, sf).where("dst IS NOT NULL AND kind IS NOT NULL").withColumn("day", F.date_diff(F.col("indexed_at").cast("date"), F.lit("2024-01-01").cast("date")))
    freq = heavy_keys.value_frequencies(rows, ["dst", "kind"], "day")
    p = heavy_keys.weighted_percentiles(freq, ["dst", "kind"], "day", [0.25, 0.5, 0.9])
    return p.select("dst", "kind", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(("p25", "p50", "p90"))])


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphans(*(table(spark, sf, n) for n in ("edges", "refs", "symbols", "stdlib_symbols")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_table", "ref_field", "ref_seq")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """defines runs from parent to child, inherits from child to parent."""
    edges = _edges(spark, sf).where(F.col("kind").isin("defines", "inherits"))
    down = F.col("kind") == "defines"
    return edges.select(
        F.col("kind").alias("tree"),
        pack_id(F.when(down, F.col("dst")).otherwise(F.col("src"))).alias("node"),
        pack_id(F.when(down, F.col("src")).otherwise(F.col("dst"))).alias("parent"),
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    out = forest.hierarchy(_links(spark, sf), with_path=False)
    return out.select(F.col("tree").alias("kind"), unpack_id("node").alias("id"), unpack_id("root").alias("root"))


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A depth of -1 and no path where the way up ends in a circle."""
    out = forest.hierarchy(_links(spark, sf))
    path = F.array_join(F.transform("path", unpack_id), "/")
    return out.select(F.col("tree").alias("kind"), unpack_id("node").alias("id"), unpack_id("root").alias("root"), F.coalesce("depth", F.lit(-1).cast("long")).alias("depth"), "in_circle", path.alias("path"))


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    pairs = forest.descendants(forest.hierarchy(_links(spark, sf)))
    return pairs.select(F.col("tree").alias("kind"), unpack_id("ancestor").alias("ancestor"), unpack_id("descendant").alias("descendant"), "distance")


def p6_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = forest.subtree_sizes(forest.sound_links(_links(spark, sf)))
    return sizes.select(F.col("tree").alias("kind"), unpack_id("ancestor").alias("id"), "n_descendants", "height")


def _all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return forest.hierarchy(forest.open_circles(_links(spark, sf)))


def p6_all_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """As p6_descendants, with the subtrees that hang below circles."""
    pairs = forest.descendants(_all_pairs(spark, sf))
    return pairs.select(F.col("tree").alias("kind"), unpack_id("ancestor").alias("ancestor"), unpack_id("descendant").alias("descendant"), "distance")


def p6_all_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = forest.subtree_sizes(forest.open_circles(_links(spark, sf)))
    return sizes.select(F.col("tree").alias("kind"), unpack_id("ancestor").alias("id"), "n_descendants", "height")


def p6_further_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Links that the hierarchies do not follow, as the child has another parent."""
    out = forest.further_parents(_links(spark, sf))
    return out.select(F.col("tree").alias("kind"), unpack_id("node").alias("id"), unpack_id("parent").alias("parent"))


def p6_supply(spark: SparkSession, sf: str) -> DataFrame:
    """The same where children do have several parents: suppliers of parts."""
    links = table(spark, sf, "lineitem").select(F.lit("supply").alias("tree"), F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("parent"))
    return forest.further_parents(links).select("node", "parent")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_pair_stats, p2_caller_mode, p2_day_percentiles, p4_found, p4_report, p6_found, p6_paths, p6_descendants, p6_sizes, p6_all_descendants, p6_all_sizes, p6_further_parents, p6_supply)
}

_KIND = "lower(trim(kind, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)))"
_PAIRS = f"SELECT dst, {_KIND} AS kind, src, indexed_at FROM edges WHERE dst IS NOT NULL AND kind IS NOT NULL"
_NAME = r"regexp_replace(lower({}), '^[\s''\"`<>]+|[\s''\"`<>]+$', '', 'g')"
_ORPHANS = f"""
WITH s AS (SELECT id, {_NAME.format('name')} AS name, indexed_at AS f, deleted_at AS d FROM symbols
           UNION SELECT id, {_NAME.format('name')}, indexed_at, deleted_at FROM stdlib_symbols),
p AS (SELECT DISTINCT 'i' || id AS k, f, d FROM s UNION SELECT DISTINCT 'n' || name, f, d FROM s),
r AS (SELECT DISTINCT 'edges' AS ref_table, 'dst' AS ref_field, seq AS ref_seq, 'i' || dst AS k, indexed_at AS t FROM edges WHERE trim(dst) <> ''
      UNION SELECT 'refs', 'src', ref_seq, 'i' || src, indexed_at FROM refs WHERE trim(src) <> ''
      UNION SELECT 'refs', 'to_name', ref_seq, 'n' || {_NAME.format('to_name')}, indexed_at FROM refs WHERE trim(to_name) <> ''),
o AS (SELECT ref_table, ref_field, ref_seq, t,
        CASE WHEN count(p.f) = 0 THEN 'missing' WHEN min(p.f) > t THEN 'late' ELSE 'deleted' END AS status
      FROM r LEFT JOIN p USING (k) GROUP BY ref_table, ref_field, ref_seq, t, k
      HAVING count(CASE WHEN p.f <= t AND (p.d IS NULL OR p.d > t) THEN 1 END) = 0)
"""
#: The way up from every child, to a depth that the trees of the test data do not reach; what is still on its way then runs in a circle.
_UP = f"""
WITH RECURSIVE k AS (SELECT src, dst, {_KIND} AS kind FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
e AS (SELECT DISTINCT kind, CASE WHEN kind = 'defines' THEN dst ELSE src END AS id, CASE WHEN kind = 'defines' THEN src ELSE dst END AS parent FROM k WHERE kind IN ('defines', 'inherits')),
up AS (SELECT kind, id, parent AS at, 1 AS d FROM e
       UNION ALL SELECT up.kind, up.id, e.parent, up.d + 1 FROM up JOIN e ON e.kind = up.kind AND e.id = up.at WHERE up.d < 300),
top AS (SELECT up.kind, up.id, max(CASE WHEN e.id IS NULL THEN up.at END) AS top, max(CASE WHEN e.id IS NULL THEN up.d END) AS depth,
               min(CASE WHEN up.d > 200 THEN up.at END) AS low, bool_or(up.at = up.id) AS ring
        FROM up LEFT JOIN e ON e.kind = up.kind AND e.id = up.at GROUP BY up.kind, up.id)
"""
#: Up to the circle node where the way enters its circle; nodes on a circle have no ancestors.
_ALL_PAIRS = _UP + """,
ent AS (SELECT up.kind, up.id, min(up.d) AS d FROM up JOIN top ON top.kind = up.kind AND top.id = up.at AND top.ring GROUP BY up.kind, up.id),
pairs AS (SELECT up.kind, up.at AS ancestor, up.id AS descendant, up.d AS distance FROM up JOIN top ON top.kind = up.kind AND top.id = up.id
          LEFT JOIN ent ON ent.kind = up.kind AND ent.id = up.id WHERE NOT top.ring AND (ent.d IS NULL OR up.d <= ent.d))
"""

ORACLE = {
    "p2_found": f"SELECT dst, kind FROM ({_PAIRS}) GROUP BY ALL HAVING count(*) >= 0.015 * (SELECT count(*) FROM edges)",
    "p2_pair_stats": f"SELECT dst, kind, count(*) AS n_edges, count(DISTINCT src) AS n_callers, min(indexed_at) AS first_seen, max(indexed_at) AS last_seen FROM ({_PAIRS}) GROUP BY dst, kind",
    "p2_caller_mode": f"SELECT dst, kind, src, n FROM (SELECT dst, kind, src, count(*) AS n, row_number() OVER (PARTITION BY dst, kind ORDER BY count(*) DESC, src) AS r FROM ({_PAIRS}) WHERE src IS NOT NULL GROUP BY dst, kind, src) WHERE r = 1",
    "p2_day_percentiles": f"SELECT dst, kind, quantile_cont(day, 0.25) AS p25, quantile_cont(day, 0.5) AS p50, quantile_cont(day, 0.9) AS p90 FROM (SELECT dst, kind, date_diff('day', DATE '2024-01-01', indexed_at::DATE)::DOUBLE AS day FROM ({_PAIRS})) GROUP BY dst, kind",
    "p4_found": _ORPHANS + "SELECT ref_table, ref_field, ref_seq FROM o",
    "p4_report": _ORPHANS + "SELECT ref_table, ref_field, strftime(t, '%Y-%m-%d') AS day, status, count(*) AS n FROM o GROUP BY ALL",
    "p6_found": _UP + "SELECT kind, id, coalesce(top, low) AS root FROM top",
    "p6_paths": _UP + """, way AS (SELECT kind, id, string_agg(up.at, '/' ORDER BY d DESC) AS way FROM up GROUP BY kind, id)
        SELECT kind, id, coalesce(top, low) AS root, coalesce(depth, -1)::BIGINT AS depth, ring AS in_circle, CASE WHEN top IS NOT NULL THEN way || '/' || id END AS path FROM top JOIN way USING (kind, id)""",
    "p6_descendants": _UP + "SELECT up.kind, up.at AS ancestor, up.id AS descendant, up.d AS distance FROM up JOIN top ON top.kind = up.kind AND top.id = up.id WHERE top.top IS NOT NULL",
    "p6_sizes": _UP + "SELECT up.kind, up.at AS id, count(*) AS n_descendants, max(up.d) AS height FROM up JOIN top ON top.kind = up.kind AND top.id = up.id WHERE top.top IS NOT NULL GROUP BY up.kind, up.at",
    "p6_further_parents": _UP + "SELECT e.kind, e.id, e.parent FROM e JOIN (SELECT kind, id, min(parent) AS first FROM e GROUP BY kind, id) f ON f.kind = e.kind AND f.id = e.id WHERE e.parent <> f.first",
    "p6_supply": "SELECT DISTINCT l_partkey AS node, l_suppkey AS parent FROM lineitem JOIN (SELECT l_partkey AS k, min(l_suppkey) AS first FROM lineitem GROUP BY l_partkey) ON k = l_partkey WHERE l_suppkey <> first",
    "p6_all_descendants": _ALL_PAIRS + "SELECT * FROM pairs",
    "p6_all_sizes": _ALL_PAIRS + "SELECT kind, ancestor AS id, count(*) AS n_descendants, max(distance) AS height FROM pairs GROUP BY kind, ancestor",
}
