"""Lookups, edges and traversal over the symbol graph.

Tables: ``symbols`` (id, name, kind, lang, file, ord, ...) and ``edges`` (src,
dst, kind, seq). Column names beyond those named here pass through untouched.
Null ids, names and endpoints never match anything. Every result on an empty
table is empty.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.plans.scratch import Scratch


def current_symbols(symbols: DataFrame) -> DataFrame:
    """One row per id: the one indexed last (then of highest ``ord``), unless
    it says that the symbol was deleted. Copies count once."""
    rest = [c for c in symbols.columns if c != "id"]
    newest = F.max_by(F.struct(*rest), F.struct(F.col("indexed_at").isNotNull(), "indexed_at", "ord")).alias("r")
    rows = symbols.where(F.col("id").isNotNull()).groupBy("id").agg(newest)
    return rows.select("id", "r.*").where(F.col("deleted_at").isNull())


def get_symbols(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """The symbols with the given ids (column ``id``)."""
    return symbols.join(ids.select("id").distinct(), "id", "left_semi")


def find(symbols: DataFrame, needle: str = "", kind: str | None = None, lang: str | None = None, exact: bool = False) -> DataFrame:
    """Symbols whose name contains the needle, or equals it, without regard to
    case; kind and language, if given, must be equal. An empty needle is
    contained in every name."""
    name = F.lower("name")
    hit = name == needle.lower() if exact else name.contains(needle.lower())
    for column, value in (("kind", kind), ("lang", lang)):
        if value is not None:
            hit &= F.col(column) == value
    return symbols.where(hit)


def resolve_names(symbols: DataFrame, names: DataFrame, contained: bool = True) -> DataFrame:
    """``asked, id``: for each distinct name the symbol that it most likely
    means: of those whose name contains it, one of the very name, else one that
    begins with it, else the shortest name, else the first by ``ord`` and id.

    Equality and beginnings are met by equi-joins on all prefixes of a name.
    What neither finds is compared with the symbols that hold its rarest three
    characters in a row (the whole of a shorter one); without ``contained`` it
    is left out.
    """
    asked = names.select(F.col("name").alias("asked")).where("asked <> ''").distinct()
    first = F.min(F.struct("ord", "id"))
    by_name = symbols.where("name IS NOT NULL").groupBy("name").agg(first.alias("first"))
    same = asked.join(by_name, F.col("asked") == F.col("name")).select("asked", F.col("first.id").alias("id"))
    rest = asked.join(same, "asked", "left_anti")
    low = by_name.select(F.lower("name").alias("low"), "name", "first")
    prefixes = low.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("low")), lambda n: F.substring(F.col("low"), F.lit(1), n))))
    best = F.min_by("first", F.struct(F.length("name"), "first"))
    begin = rest.join(prefixes, F.lower("asked") == F.col("prefix")).groupBy("asked").agg(best.alias("first")).select("asked", F.col("first.id").alias("id"))
    if not contained:
        return same.unionByName(begin)
    grams = low.where("low <> ''").withColumn("gram", F.explode(F.array_distinct(F.concat(*[_grams("low", n, F.length("low")) for n in (1, 2, 3)]))))
    parts = rest.join(begin, "asked", "left_anti").withColumn("gram", F.explode(_grams(F.lower("asked"), 3, F.greatest(F.length(F.lower("asked")) - 2, F.lit(1)))))
    held = parts.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")
    rarest = held.groupBy("asked").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    hits = rarest.join(grams, "gram").where(F.col("low").contains(F.lower("asked")))
    inside = hits.groupBy("asked").agg(best.alias("first")).select("asked", F.col("first.id").alias("id"))
    return same.unionByName(begin).unionByName(inside)


def _grams(text: str | Column, n: int, last: Column) -> Column:
    """The ``n`` characters, at the end fewer, from each place up to ``last``."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(text, at, F.lit(n)))


def resolve_name(symbols: DataFrame, name: str) -> str | None:
    """The id that one name most likely means; also by a part of the name."""
    hits = find(symbols, name)
    order = [(F.col("name") == name).desc(), F.lower("name").startswith(name.lower()).desc(), F.length("name"), "ord", "id"]
    row = hits.orderBy(*order).select("id").first()
    return row.id if row else None


def linked(edges: DataFrame, symbols: DataFrame, of: DataFrame, incoming: bool = True, newest_kind: bool = False) -> DataFrame:
    """Callers (``incoming``) or callees of the ids in ``of``: one row per
    edge, ``id`` (the asked one), ``other, name, edge_kind``. With
    ``newest_kind`` parallel edges all show the kind of the one with the
    highest ``seq``. Edges to symbols that are not there give no row."""
    mine, other = ("dst", "src") if incoming else ("src", "dst")
    met = edges.join(of.select(F.col("id").alias(mine)).distinct(), mine, "left_semi").select(F.col(mine).alias("id"), F.col(other).alias("other"), "kind", "seq")
    kind = F.max_by("kind", "seq").over(Window.partitionBy("id", "other")) if newest_kind else F.col("kind")
    rows = met.select("id", "other", kind.alias("edge_kind"))
    return rows.join(symbols.select(F.col("id").alias("other"), "name"), "other").select("id", "other", "name", "edge_kind")


def insert_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edges whose two ends are known symbols; parallel ones stay."""
    known = symbols.select("id").distinct()
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def remove_files(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without the symbols of the given files (column
    ``file``) and without every edge at one of those."""
    gone_files = files.select("file").where("file IS NOT NULL").distinct()
    gone = symbols.join(gone_files, "file", "left_semi").select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return symbols.join(gone_files, "file", "left_anti"), kept


def counts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, kind, n``: symbols and edges of each kind, rows as they are."""
    one = lambda df, what: df.groupBy("kind").count().select(F.lit(what).alias("what"), "kind", F.col("count").alias("n"))
    return one(symbols, "symbol").unionByName(one(edges, "edge"))


def resolve_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``src, dst, kind, ref_seq`` of every reference by name that meets a symbol.

    Names compare without regard to case; of several symbols the first (by
    ``ord``, then id) in the file of the reference is taken, else the first of
    all. Candidates are cut down to one per name and one per name and file
    before they are joined, so that a name borne by very many symbols costs
    one row. References without a source or to an unknown source are dropped.
    """
    known = symbols.where("name IS NOT NULL").select("id", F.lower("name").alias("name_ci"), "file", "ord")
    first = F.min(F.struct("ord", "id"))
    anywhere = known.groupBy("name_ci").agg(first.alias("any"))
    in_file = known.groupBy("name_ci", "file").agg(first.alias("near"))
    asked = refs.where("src IS NOT NULL AND to_name <> ''").select("ref_seq", "src", "kind", "file", F.lower("to_name").alias("name_ci"))
    met = asked.join(anywhere, "name_ci").join(in_file, ["name_ci", "file"], "left")
    out = met.select("src", F.coalesce("near.id", "any.id").alias("dst"), "kind", "ref_seq")
    return out.join(symbols.select(F.col("id").alias("src")).distinct(), "src", "left_semi").distinct()


class Neighborhood(NamedTuple):
    """``nodes``: id, depth; ``edges``: src, dst, kind, as often as met."""

    nodes: DataFrame
    edges: DataFrame


def _around(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges at the frontier (``id, ...``), once from each end."""
    rest = [c for c in frontier.columns if c != "id"]
    out = edges.join(frontier, F.col("src") == F.col("id")).select(*rest, F.col("dst").alias("near"), F.lit(0).alias("side"), "seq", "src", "dst", "kind")
    back = edges.join(frontier, F.col("dst") == F.col("id")).select(*rest, F.col("src").alias("near"), F.lit(1).alias("side"), "seq", "src", "dst", "kind")
    return out.unionByName(back)


def neighborhood(edges: DataFrame, center: str, depth: int = 2) -> Neighborhood:
    """Everything within ``depth`` steps of the center, edges taken both ways.

    Each round is written out; only ids that were not met before go on, so
    circles end. The center is a node even if no edge names it.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "around")
    live = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    frontier = spark.createDataFrame([(center, 0)], "id string, depth int")
    nodes, met = frontier, None
    for d in range(1, depth + 1):
        around = scratch.cut(_around(live, frontier.select("id")))
        met = around.df if met is None else met.unionByName(around.df)
        new = around.df.select(F.col("near").alias("id")).distinct().join(nodes, "id", "left_anti")
        frontier = scratch.cut(new.withColumn("depth", F.lit(d))).df
        nodes = nodes.unionByName(frontier)
        if frontier.isEmpty():
            break
    if met is None:
        met = _around(live.limit(0), frontier.select("id"))
    return Neighborhood(nodes, met.select("src", "dst", "kind"))


def capped_neighborhood(edges: DataFrame, center: str, depth: int = 2, cap: int = 50) -> Neighborhood:
    """Breadth-first search that stops before expanding a node once ``cap``
    nodes are known; the last expansion may lead beyond the cap.

    Neighbours are met outgoing before incoming, newest edge (highest ``seq``)
    first, then by id. At most ``cap`` nodes are ever expanded, so that only
    so many are held by the driver; what a hub has around it never is.
    """
    spark = edges.sparkSession
    live = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    scratch = Scratch(spark, "capped")
    nodes = spark.createDataFrame([(center, 0)], "id string, depth int")
    met = _around(live.limit(0), nodes.select("id", F.lit(0).alias("pos"))).select("src", "dst", "kind")
    frontier, total = [center], 1
    for d in range(1, depth + 1):
        if not frontier or total >= cap:
            break
        asked = spark.createDataFrame(list(enumerate(frontier)), "pos int, id string")
        around = scratch.cut(_around(live, F.broadcast(asked.select("id", "pos")))).df
        first = F.min(F.struct("pos", "side", (-F.col("seq")).alias("age"), "near")).alias("first")
        new = scratch.cut(around.groupBy("near").agg(first).join(nodes.select(F.col("id").alias("near")), "near", "left_anti")).df
        found = {r.pos: r.n for r in new.groupBy(F.col("first.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n")).collect()}
        expanded = 0
        for pos in range(len(frontier)):
            if total >= cap:
                break
            expanded, total = pos + 1, total + found.get(pos, 0)
        kept = new.where(F.col("first.pos") < expanded)
        met = met.unionByName(around.where(F.col("pos") < expanded).select("src", "dst", "kind"))
        nodes = nodes.unionByName(kept.select(F.col("near").alias("id"), F.lit(d).alias("depth")))
        if expanded < len(frontier):
            break
        frontier = [r.near for r in kept.orderBy("first").limit(cap).select("near").collect()]
    return Neighborhood(nodes, met)


def describe(around: Neighborhood, symbols: DataFrame, center: str) -> str:
    """The neighbourhood as text: counts, nodes (known ones), edges."""
    known = symbols.select("id", "name", "kind", "file")
    nodes = around.nodes.join(known, "id").orderBy("depth", "name", "id").collect()
    name = lambda end: known.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    rows = around.edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    edges = rows.select(F.coalesce("src_name", F.lit("?")).alias("a"), F.coalesce("dst_name", F.lit("?")).alias("b"), "kind").orderBy("a", "b", "kind").collect()
    lines = [f"{around.nodes.count()} nodes, {len(edges)} edges", "Nodes:"]
    lines += [f"  {n.name} ({n.kind}) {n.file}" + (" [CENTER]" if n.id == center else "") for n in nodes]
    lines += ["Edges:", *(f"  {e.a} --[{e.kind}]--> {e.b}" for e in edges)]
    return "\n".join(lines)
