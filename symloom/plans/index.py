"""Building, storing and refreshing the index of a set of files.

An index is a folder of versions; a pointer file names the current one, so
that a reader never sees half of a new one and a refresh may read the old
tables while it writes the new. References by name are stored, and a refresh
resolves all of them again: a new symbol may change what an untouched file
refers to.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.extract.rules import Registry
from symloom.extract.tables import PluginRegistry, extracted, references_of, symbols_of
from symloom.functions.embedders import Embedder, HashEmbedder
from symloom.operators import deltas, fulltext, graph, vectors
from symloom.plans.scratch import Scratch
from symloom.sources import fs

TABLES = ("files", "symbols", "refs", "edges", "postings", "lengths", "stats", "vectors")
POINTER, STATE = "CURRENT", "state.json"


class IndexNotFound(RuntimeError):
    """There is no index yet; build one first."""


@dataclass
class Index:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def symbols(self) -> DataFrame:
        return self.table("symbols")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    @property
    def text(self) -> fulltext.TextIndex:
        return fulltext.TextIndex(self.table("postings"), self.table("lengths"), self.table("stats"))

    @property
    def state(self) -> dict:
        return json.loads(fs.read_text(self.spark, f"{self.path}/{STATE}"))


def open_index(spark: SparkSession, folder: str) -> Index:
    pointer = f"{folder}/{POINTER}"
    if not fs.exists(spark, pointer):
        raise IndexNotFound(f"no index in {folder}; run index first")
    return Index(spark, f"{folder}/{fs.read_text(spark, pointer).strip()}")


def with_positions(files: DataFrame, first: int = 0) -> DataFrame:
    """``pos``: the place of each file in the order of paths, from ``first`` on
    without gaps. The names are range-partitioned, sorted and written once
    with their place in their part, as a plan that runs twice draws the
    bounds of its ranges anew; the sizes of the parts, one number each, then
    say where each begins. A null name has no place and is left out."""
    spark = files.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = files.select("file").where("file IS NOT NULL").distinct().repartitionByRange(parts, "file").sortWithinPartitions("file")
    # the upper bits are the part, the lower ones the place in it
    written = Scratch(spark, "positions").cut(ranged.withColumn("at", F.monotonically_increasing_id())).df
    placed = written.select("file", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("n"))
    sizes = placed.groupBy("part").agg((F.max("n") + 1).alias("n")).collect()
    before, offsets = first, []
    for r in sorted(sizes):
        offsets.append((r.part, before))
        before += r.n
    start = spark.createDataFrame(offsets or [(0, first)], "part int, start long")
    numbered = placed.join(F.broadcast(start), "part").select("file", (F.col("start") + F.col("n")).alias("pos"))
    return files.join(numbered, "file")


def newest_files(files: DataFrame) -> DataFrame:
    """One row a file name: of several the one changed last, then the one of
    the greatest content hash; null names are left out. Copies count once."""
    order = [F.col(c) for c in ("mtime", "content_hash") if c in files.columns] or [F.xxhash64("content")]
    rest = [c for c in files.columns if c != "file"]
    # combined before the shuffle, so that a name borne by very many rows costs one
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return files.where("file IS NOT NULL").groupBy("file").agg(newest).select("file", "r.*")


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``src, dst, kind, seq``: references by name, in their order. Those that
    come with an end (``dst``) need no name; they are kept if both ends are
    known, once, and count as newer than all others."""
    asked = refs.withColumnRenamed("ord", "ref_seq")
    given = asked.where("dst IS NOT NULL").groupBy("src", "dst", "kind").agg(F.max("ref_seq").alias("seq"))
    named = graph.resolve_references(asked.where("dst IS NULL"), symbols).select("src", "dst", "kind", F.col("ref_seq").alias("seq"))
    return named.unionByName(graph.insert_edges(given, symbols))


def _write(spark: SparkSession, folder: str, files: DataFrame, symbols: DataFrame, refs: DataFrame, vecs: DataFrame | None, state: dict, embedder: Embedder, text: fulltext.TextIndex | None = None) -> Index:
    version = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:6]}"
    index = Index(spark, f"{folder}/{version}")

    def put(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{index.path}/{name}")
        try:
            return index.table(name)
        except AnalysisException:  # partitioned and empty: no file tells the schema
            df.limit(0).write.mode("overwrite").parquet(f"{index.path}/{name}")
            return index.table(name)

    kept_files = put(files, "files")
    kept = put(symbols, "symbols", "lang")
    put(resolve(put(refs, "refs"), kept), "edges")
    text = text or fulltext.index_symbols(kept)
    put(text.postings, "postings", "field")
    put(text.lengths, "lengths")
    put(text.stats, "stats")
    put(vectors.index_names(kept, embedder) if vecs is None else vecs, "vectors")
    state = state | {"indexed_at": int(time.time()), "file_count": kept_files.where("status = 'ok'").count(), "embedder": embedder.name, "dim": embedder.dim}
    fs.write_text(spark, f"{index.path}/{STATE}", json.dumps(state, indent=2))
    fs.write_text(spark, f"{folder}/{POINTER}", version)
    return index


def _extract(files: DataFrame, registry: Registry, plugins: PluginRegistry | None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files without contents, symbols, references of the given files."""
    done = extracted(files, registry)
    symbols, refs = symbols_of(done), references_of(done).withColumn("dst", F.lit(None).cast("string"))
    if plugins and plugins.plugins:
        around = symbols if known is None else known.unionByName(symbols, allowMissingColumns=True)
        added = plugins.apply(files, around).distinct()
        last = F.xxhash64("src", "to_name", "kind", "dst").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
        refs = refs.unionByName(added.select("src", "to_name", F.lower("to_name").alias("to_name_ci"), "kind", "file", last.alias("ord"), "dst"))
    kept = files.select([c for c in files.columns if c not in ("content", "status")]).join(done.select("file", F.col("status").alias("status")), "file")
    return kept, symbols, refs


def build(spark: SparkSession, files: DataFrame, registry: Registry, folder: str, plugins: PluginRegistry | None = None, git_head: str | None = None, embedder: Embedder | None = None) -> Index:
    """A new index of ``files`` (``file, content, content_hash, ...``),
    replacing any that the folder holds."""
    placed = with_positions(newest_files(files))
    return _write(spark, folder, *_extract(placed, registry, plugins), None, {"git_head": git_head}, embedder or HashEmbedder())


def store(spark: SparkSession, files: DataFrame, symbols: DataFrame, refs: DataFrame, folder: str, vecs: DataFrame | None = None, git_head: str | None = None, embedder: Embedder | None = None) -> Index:
    """An index of tables that were extracted elsewhere: ``files`` (``file,
    status, ...``), current ``symbols`` (``id, lang, kind, name, fqname, file,
    signature, doc, ord, ...``) and ``refs`` (``src, to_name, kind, file,
    ord`` and, if known, ``dst``). Vectors are those given, else of names."""
    if "dst" not in refs.columns:
        refs = refs.withColumn("dst", F.lit(None).cast("string"))
    named = symbols if "name_ci" in symbols.columns else symbols.withColumn("name_ci", F.lower("name"))
    return _write(spark, folder, files, named, refs, vecs, {"git_head": git_head}, embedder or HashEmbedder())


@dataclass
class Refreshed:
    files_updated: int
    files_deleted: int
    symbols_added: int
    symbols_removed: int


def refresh(spark: SparkSession, files: DataFrame, registry: Registry, folder: str, plugins: PluginRegistry | None = None, git_head: str | None = None, embedder: Embedder | None = None, listed: DataFrame | None = None) -> Refreshed:
    """Bring the index to the state of ``files``: only files whose content
    hash is new or differs are read by the extractor; what vanished is
    removed. ``files`` are all of them, or, with ``listed`` (``file``: all
    that are there), those that may have changed. Text and vectors of what is
    untouched are kept as they are. The result equals a full build but for
    positions. An index made with another embedder is refused, as vectors
    would not compare."""
    old, embedder = open_index(spark, folder), embedder or HashEmbedder()
    if old.state["embedder"] != embedder.name:
        raise RuntimeError(f"the index was made with {old.state['embedder']!r}; build it anew for {embedder.name!r}")
    before, old_files = old.symbols, old.table("files")
    files = newest_files(files)
    compared = old_files
    if listed is not None:
        gone_files = old_files.join(listed.select("file"), "file", "left_anti")
        compared = old_files.join(files.select("file"), "file", "left_semi").unionByName(gone_files)
    diff = Scratch(spark, "refresh").cut(deltas.snapshot_diff(compared, files, "file", "content_hash")).df
    n = {r.change: r["count"] for r in diff.groupBy("change").count().collect()}
    if not n:
        return Refreshed(0, 0, 0, 0)
    touched = diff.select("file")
    last = old_files.agg(F.max("pos")).first()[0]
    fresh = with_positions(files.join(diff.where("change <> 'D'").select("file"), "file", "left_semi"), (last if last is not None else -1) + 1)
    new_files, new_symbols, new_refs = _extract(fresh, registry, plugins, before.join(touched, "file", "left_anti"))
    new_symbols = Scratch(spark, "refresh").cut(new_symbols).df
    keep = lambda df: df.join(touched, "file", "left_anti")
    symbols = keep(before).unionByName(new_symbols.select(*before.columns))
    gone = before.join(touched, "file", "left_semi")
    vecs = vectors.upsert(old.table("vectors").join(gone.select("id"), "id", "left_anti"), vectors.index_names(new_symbols, embedder))
    text = fulltext.add_documents(fulltext.remove_documents(old.text, gone), fulltext.index_symbols(new_symbols))
    removed = gone.count()
    added = new_symbols.count()
    all_files = keep(old_files).unionByName(new_files.select(*old_files.columns))
    _write(spark, folder, all_files, symbols, keep(old.table("refs")).unionByName(new_refs), vecs, {"git_head": git_head}, embedder, text)
    return Refreshed(n.get("A", 0) + n.get("M", 0), n.get("D", 0), added, removed)


def drop_old(spark: SparkSession, folder: str, versions: list[str]) -> None:
    """Delete versions that nobody reads any more."""
    current = fs.read_text(spark, f"{folder}/{POINTER}").strip()
    for v in versions:
        if v != current:
            fs.delete(spark, f"{folder}/{v}")
