"""The engine of one project: everything the command line and the server do."""

from __future__ import annotations

import datetime
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.extract.rules import PACKAGED, Registry, parse_language
from symloom.extract.tables import PluginRegistry
from symloom.functions.embedders import Embedder, HashEmbedder
from symloom.operators import deltas, fulltext, graph, vectors
from symloom.plans import index as indexing
from symloom.plans.deploy import ship
from symloom.sources import config as conf
from symloom.sources import walk as walking
from symloom.streaming import watch as watching

SYMBOL_COLUMNS = ("id", "name", "kind", "lang", "file")


class Engine:
    def __init__(self, spark: SparkSession, base: str | Path = ".", plugins: PluginRegistry | None = None, embedder: Embedder | None = None, folder: str | None = None) -> None:
        """``folder``: where the index is, on any file system; else in the project."""
        self.spark, self.base, self.plugins, self._folder = spark, Path(base), plugins or PluginRegistry(), folder
        self.embedder = embedder or HashEmbedder()
        ship(spark)
        self.config = conf.Config.load(self.base)
        self._index: indexing.Index | None = None

    @property
    def folder(self) -> str:
        return self._folder or str(self.config.index_path.resolve())

    @property
    def registry(self) -> Registry:
        return conf.load_registry(self.base)

    @property
    def index_tables(self) -> indexing.Index:
        if self._index is None:
            self._index = indexing.open_index(self.spark, self.folder)
        return self._index

    # -- project ------------------------------------------------------------

    def init(self) -> bool:
        """Write the rule files, an editor's server entry and an ignore line.
        False if that was done before."""
        target = self.base / conf.INDEX_DIR / "languages"
        if target.exists():
            return False
        shutil.copytree(PACKAGED, target, ignore=shutil.ignore_patterns("__pycache__"))
        editor = self.base / ".vscode/mcp.json"
        if not editor.exists():
            editor.parent.mkdir(exist_ok=True)
            editor.write_text('{"servers": {"symloom": {"type": "stdio", "command": "python", "args": ["-m", "symloom.rpc", "--base", "${workspaceFolder}"]}}}\n')
        ignore = self.base / ".gitignore"
        if (self.base / ".git").exists():
            text = ignore.read_text() if ignore.exists() else ""
            if conf.INDEX_DIR not in text:
                ignore.write_text(text + ("" if text.endswith("\n") or not text else "\n") + f"{conf.INDEX_DIR}/\n")
        return True

    def add_language(self, toml: str | Path) -> str:
        """Check a rule file and add it to the project's languages."""
        target = self.base / conf.INDEX_DIR / "languages"
        if not target.is_dir():
            raise RuntimeError("run init first")
        path = Path(toml)
        lang = parse_language(path.read_text(encoding="utf-8"), path.name)
        shutil.copy(path, target / f"{lang.id}.toml")
        return lang.id

    def languages(self) -> list[str]:
        return list(self.registry.languages) or list(conf.BUILTIN)

    def _files(self) -> DataFrame:
        return walking.read_files(self.spark, self.base, walking.walk(self.config, self.registry), self.registry)

    def _candidates(self) -> tuple[DataFrame, DataFrame]:
        """The files whose time or size is not that of the index, read; and the
        names of all that are there."""
        there = walking.stat_files(self.base, walking.walk(self.config, self.registry))
        listed = self.spark.createDataFrame(there, "file string, micros long, n_bytes long")
        old = indexing.open_index(self.spark, self.folder).table("files").where("status = 'ok'").select("file", F.unix_micros(F.col("mtime").cast("timestamp")).alias("micros"), "n_bytes")
        paths = [r.file for r in listed.join(old, ["file", "micros", "n_bytes"], "left_anti").select("file").collect()]
        return walking.read_files(self.spark, self.base, paths, self.registry), listed

    def index(self, incremental: bool = False, by: str = "stat") -> indexing.Refreshed | None:
        """Build the index, or bring it up to date; null after a full build.
        A refresh reads the files whose time or size differs; ``by="content"``
        reads and hashes all."""
        head = walking.git_head(self.base)
        self._index = None
        if incremental:
            try:
                files, listed = (self._files(), None) if by == "content" else self._candidates()
                return indexing.refresh(self.spark, files, self.registry, self.folder, self.plugins, head, self.embedder, listed)
            except indexing.IndexNotFound:
                pass
        self._index = indexing.build(self.spark, self._files(), self.registry, self.folder, self.plugins, head, self.embedder)
        return None

    def changes(self, by: str = "content") -> DataFrame:
        """``file, change`` (A, M, D) since the index was made: by ``content``
        hash, by ``git`` against the recorded commit, or by ``mtime`` (which
        sees no deletion). Git that cannot tell falls back to content."""
        now = self.index_tables
        if by == "git" and now.state.get("git_head"):
            found = walking.git_changes(self.base, now.state["git_head"])
            if found is not None:
                known = {f: c for f, c in found.items() if self.registry.for_file(f)}
                return self.spark.createDataFrame(sorted(known.items()), "file string, change string")
        if by == "mtime":
            moment = datetime.datetime.fromtimestamp(now.state["indexed_at"], datetime.UTC)
            old = now.table("files").select("file", F.lit("M").alias("was"))
            return deltas.changed_since(self._files(), moment).select("file").join(old, "file", "left").select("file", F.coalesce("was", F.lit("A")).alias("change"))
        return deltas.snapshot_diff(now.table("files"), self._files(), "file", "content_hash")

    def register_views(self, prefix: str = "code_") -> list[str]:
        """The tables as temporary views for SQL."""
        names = [f"{prefix}{t}" for t in indexing.TABLES]
        for name, t in zip(names, indexing.TABLES, strict=True):
            self.index_tables.table(t).createOrReplaceTempView(name)
        return names

    def watch(self, every: str = "2 seconds", errors: list | None = None):
        """Refresh the index whenever the listing of the source files (names of
        known languages, times, sizes) is not that of the last look."""
        seen: list = []

        def refresh() -> None:
            there = walking.stat_files(self.base, walking.walk(self.config, self.registry))
            if there not in seen:
                self.index(incremental=True)
                seen[:] = [there]

        return watching.watch(self.spark, refresh, every, errors=errors)

    # -- questions --------------------------------------------------------------

    def search(self, query: str, limit: int = 20) -> DataFrame:
        hits = fulltext.search(self.index_tables.text, query, limit)
        return hits.join(self.index_tables.symbols.select(*SYMBOL_COLUMNS), "id").select(*SYMBOL_COLUMNS, "score").orderBy(F.desc("score"), "id")

    def semantic_search(self, query: str, limit: int = 10) -> DataFrame:
        live = self.index_tables.table("vectors").join(self.index_tables.symbols.select("id"), "id", "left_semi")
        hits = vectors.top_k(live, self.embedder.one(query), limit)
        return hits.join(self.index_tables.symbols.select(*SYMBOL_COLUMNS), "id").select(*SYMBOL_COLUMNS, "score").orderBy(F.desc("score"), "id")

    def find(self, needle: str, kind: str | None = None, lang: str | None = None, limit: int = 20) -> DataFrame:
        return graph.find(self.index_tables.symbols, needle, kind, lang).orderBy("name_ci", "ord", "id").limit(limit)

    def get(self, symbol_id: str) -> DataFrame:
        return self.index_tables.symbols.where(F.col("id") == symbol_id)

    def resolve(self, name: str) -> str:
        found = graph.resolve_name(self.index_tables.symbols, name)
        if found is None:
            raise KeyError(f"no symbol named {name!r}")
        return found

    def linked(self, symbol_id: str, incoming: bool) -> DataFrame:
        of = self.spark.createDataFrame([(symbol_id,)], "id string")
        rows = graph.linked(self.index_tables.edges, self.index_tables.symbols, of, incoming, newest_kind=True)
        known = self.index_tables.symbols.select(F.col("id").alias("other"), "kind", "file")
        return rows.join(known, "other").select(F.col("other").alias("id"), "name", "kind", "file", "edge_kind").orderBy("name", "id")

    def callers(self, name: str) -> DataFrame:
        return self.linked(self.resolve(name), True)

    def callees(self, name: str) -> DataFrame:
        return self.linked(self.resolve(name), False)

    def neighborhood(self, symbol_id: str, depth: int = 2, cap: int = 50) -> tuple[graph.Neighborhood, str]:
        around = graph.capped_neighborhood(self.index_tables.edges, symbol_id, depth, cap)
        return around, graph.describe(around, self.index_tables.symbols, symbol_id)

    def status(self) -> dict:
        try:
            now = self.index_tables
        except indexing.IndexNotFound:
            return {"status": "no_index"}
        return now.state | {"symbols": now.symbols.count(), "edges": now.edges.count(), "vectors": now.table("vectors").count()}
