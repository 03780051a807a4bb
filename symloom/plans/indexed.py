"""Queries that go through a stored index, the tool server, the command line
and folders of files, each with the SQL that must give the same rows.

The index is made of the test tables as they are, so that what it answers can
be told from those tables. It is built once a session and table folder.
"""

from __future__ import annotations

import io
import json
import subprocess
import uuid
import warnings
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import cli
from symloom.engine import Engine
from symloom.extract.model import KINDS, Found, clean_comment, kind_of, owners, qualified_names, signature
from symloom.extract.rules import LanguageError, Registry, parse_language
from symloom.extract.tables import PluginRegistry, RegexEdges, extracted, references_of, symbols_of
from symloom.functions.embedders import create_embedder
from symloom.functions.keys import clean_name, plain_path
from symloom.functions.scalars import hash_embedding, parse_id
from symloom.operators import fulltext, graph, vectors
from symloom.plans import index as indexing
from symloom.plans.codegraph import _ALL, _CUR, _E, _WORDS, _current, _edges, _symbols
from symloom.plans.codegraph import ORACLE as _PLAIN
from symloom.plans.scratch import shared_dir
from symloom.plans.tables import table
from symloom.rpc import Server
from symloom.sources import walk as walking
from symloom.sources.config import BUILTIN, Config, detect_languages

RESOLVED, POSTINGS = _PLAIN["resolve_refs"], _PLAIN["postings"]
MOMENT = "2024-04-01 00:00:00"
ASKED = "parser"

# -- a stored index -----------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors that an index may hold: of each id the latest, if it is whole."""
    rows = table(spark, sf, "vectors").where("id IS NOT NULL").groupBy("id").agg(F.max_by("vec", "seq").alias("vec"))
    return rows.where(F.col("vec").isNotNull() & (F.size("vec") == 32) & ~F.exists("vec", lambda e: e.isNull() | F.isnan(e)))


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "refs").select("src", clean_name("to_name").alias("to_name"), "kind", plain_path("file").alias("file"), F.col("ref_seq").alias("ord"))
    return rows.distinct()


@lru_cache
def _stored(spark: SparkSession, sf: str) -> str:
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}"
    files = indexing.newest_files(table(spark, sf, "source_files")).drop("content")
    indexing.store(spark, files, _current(spark, sf), _refs(spark, sf), folder, _vectors(spark, sf), git_head="none")
    return folder


def _engine(spark: SparkSession, sf: str) -> Engine:
    return Engine(spark, "/nonexistent", folder=_stored(spark, sf))


def stored_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).index_tables.symbols.select("id", "name", "name_ci", "kind", "lang", "file")


def stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).index_tables.edges.select("src", "dst", "kind", "seq")


def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).index_tables.table("vectors").select("id", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, e: s + e.cast("double")), 4).alias("total"))


def stored_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).index_tables.text.postings.select("field", "term", "id", "tf", F.element_at("positions", 1).alias("first_at"))


def stored_state(spark: SparkSession, sf: str) -> DataFrame:
    s = _engine(spark, sf).status()
    row = (s["file_count"], s["symbols"], s["edges"], s["vectors"], s["embedder"], s["dim"], s["git_head"])
    return spark.createDataFrame([row], "file_count long, symbols long, edges long, vectors long, embedder string, dim long, git_head string")


def removed_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The text index without the symbols of files that cannot be parsed."""
    e = _engine(spark, sf).index_tables
    gone = e.symbols.join(e.table("files").where("status <> 'ok'").select("file"), "file", "left_semi")
    left = fulltext.remove_documents(e.text, gone)
    return left.stats.select("field", "n_docs", F.round("avg_dl", 6).alias("avg_dl")).join(left.postings.groupBy("field").agg(F.count(F.lit(1)).alias("n_postings")), "field")


def engine_search(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).search(ASKED).select("id", "name", "kind", "lang", "file", F.round("score", 4).alias("score"))


def engine_search_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).search(f"+kind:function +{ASKED}", 1_000_000).select("id", "kind")


def engine_semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    """Those nearest to the empty text, whose hash is a published test vector."""
    return _engine(spark, sf).semantic_search("").select("id", "name", F.round("score", 4).alias("score"))


def engine_find(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).find("shift").select("id", "name", "kind", "file")


def _hub(spark: SparkSession, sf: str, end: str = "dst") -> str:
    """The symbol at which most edges end (or begin); of several the first id."""
    e = _engine(spark, sf).index_tables
    top = e.edges.groupBy(F.col(end).alias("id")).count().orderBy(F.desc("count"), "id").first()
    return top.id


def engine_resolve(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, sf)
    return spark.createDataFrame([(n, e.resolve(n)) for n in ("a", "shift", "e_p", "er")], "asked string, id string")


def engine_callers(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).linked(_hub(spark, sf), True)


def engine_callees(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).linked(_hub(spark, sf, "src"), False)


def engine_languages(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, sf)
    return spark.createDataFrame([(n, x, e.registry.by_extension[x]) for n, lang in e.registry.languages.items() for x in lang.extensions], "language string, extension string, dispatched string")


def neighborhood_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text of a neighbourhood, a line a row."""
    e = _engine(spark, sf).index_tables
    center = _hub(spark, sf)
    around = graph.neighborhood(e.edges, center, 1)
    lines = graph.describe(around, e.symbols, center).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


# -- the tool server and the command line --------------------------------------


def _tool(spark: SparkSession, sf: str, name: str, **args):
    request = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}}
    reply = json.loads(Server(_engine(spark, sf)).answer(json.dumps(request)))
    return json.loads(reply["result"]["content"][0]["text"])


def _frame(spark: SparkSession, rows: list[dict], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], columns)


def tool_search(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, _tool(spark, sf, "search", query=ASKED), "id string, name string, kind string, lang string, file string, score double").withColumn("score", F.round("score", 4))


def tool_semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, _tool(spark, sf, "semantic_search", query=""), "id string, name string, score double").withColumn("score", F.round("score", 4))


def tool_find_symbol(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tool(spark, sf, "find_symbol", needle="e", kind="method", lang="python", limit=30)
    return _frame(spark, rows, "id string, name string, kind string, lang string, file string, start_line long, end_line long, signature string")


def tool_get_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, [_tool(spark, sf, "get_symbol", id=_hub(spark, sf).upper())], "id string, name string, kind string, lang string, file string, fqname string, signature string, doc string")


def tool_find_callers(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, _tool(spark, sf, "find_callers", id=_hub(spark, sf)), "id string, name string, kind string, file string, edge_kind string")


def tool_find_callees(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, _tool(spark, sf, "find_callees", id=_hub(spark, sf, "src")), "id string, name string, kind string, file string, edge_kind string")


def tool_expand_neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    got = _tool(spark, sf, "expand_neighborhood", id=_hub(spark, sf), depth=1, cap=50)
    return _frame(spark, [got], "node_count long, edge_count long")


def tool_index_status(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, [_tool(spark, sf, "index_status")], "symbols long, edges long, file_count long")


def console_find(spark: SparkSession, sf: str) -> DataFrame:
    """What the command line prints for a search by name, a line a row."""
    out = io.StringIO()
    cli.run(_engine(spark, sf), cli.parser().parse_args(["find", "shift"]), out)
    return spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")


# The kinds of node types.
NODES = [
    *((n, "function") for n in ("function_definition", "function_declaration", "function_item", "method_definition", "method_declaration", "generator_function_declaration", "abstract_method_signature")),
    ("class_definition", "class"), ("class_declaration", "class"), ("struct_item", "struct"), ("struct_specifier", "struct"), ("enum_item", "enum"), ("enum_specifier", "enum"),
    ("enum_declaration", "enum"), ("enum_variant", "enum_variant"), ("enumerator", "enum_variant"), ("enum_assignment", "enum_variant"), ("type_alias_declaration", "type_alias"),
    ("type_item", "type_alias"), ("type_definition", "type_alias"), ("interface_declaration", "interface"), ("impl_item", "impl"), ("trait_item", "trait"), ("module", "module"), ("mod_item", "module"),
    ("field_declaration", "field"), ("public_field_definition", "field"), ("field_definition", "field"), ("macro_definition", "macro"), ("preproc_def", "macro"), ("preproc_function_def", "macro"),
    ("const_item", "constant"), ("const_spec", "constant"), ("const_declaration", "constant"), ("static_item", "static"), ("union_specifier", "union"), ("type_spec", "type"), ("type_declaration", "type"),
    ("var_declaration", "variable"), ("var_spec", "variable"), ("lexical_declaration", "variable"), ("variable_declarator", "variable"), ("assignment", "variable"), ("decorated_definition", "decorated"),
    ("export_statement", "definition"), ("declaration", "definition"), ("pair", "definition"),
]


# -- functions and front ends -----------------------------------------------------


def kind_of_node(spark: SparkSession, sf: str) -> DataFrame:
    nodes = [*(n for ns in KINDS.values() for n in ns), "export_statement", "declaration", "pair"]
    return spark.createDataFrame([(n, kind_of(n)) for n in nodes], "node string, kind string")


def qualified(spark: SparkSession, sf: str) -> DataFrame:
    """Qualified names from the places of the symbols of each file."""
    scope = {"class": "class_definition", "struct": "struct_item", "trait": "trait_item", "module": "mod_item", "function": "function_item"}

    def name(rows: pd.DataFrame) -> pd.DataFrame:
        found = [Found(r.name, scope.get(r.kind, "field_declaration"), int(r.start_byte), int(r.end_byte)) for r in rows.itertuples(index=False)]
        return pd.DataFrame({"id": rows["id"], "fqname": qualified_names(rows["file"].iloc[0], found)})

    now = _current(spark, sf).where("file IS NOT NULL AND name IS NOT NULL AND start_byte < end_byte")
    return now.select("id", "name", "kind", "file", "start_byte", "end_byte").groupBy("file").applyInPandas(name, "id string, fqname string")


def first_owner(spark: SparkSession, sf: str) -> DataFrame:
    """To which symbol a call at the beginning of each member would belong."""

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "id"])
        spans = rows[~rows["kind"].isin(["method", "field", "module"])]
        sites = rows[rows["kind"].isin(["method", "field"])].sort_values("start_byte")
        found = [Found(r.id, r.kind, int(r.start_byte), int(r.end_byte)) for r in spans.itertuples(index=False)]
        got = owners(found, sites["start_byte"].astype(int).tolist())
        return pd.DataFrame([(s, found[g].name) for s, g in zip(sites["id"], got, strict=True) if g is not None], columns=["site", "owner"])

    now = _current(spark, sf).where("file IS NOT NULL AND start_byte < end_byte")
    return now.select("id", "kind", "file", "ord", "start_byte", "end_byte").groupBy("file").applyInPandas(own, "site string, owner string")


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.udf(lambda t: signature(t) if t is not None else None, "string")
    return table(spark, sf, "eval_items").select("item_id", cut("text").alias("signature"))


def comment_lines(spark: SparkSession, sf: str) -> DataFrame:
    clean = F.udf(lambda t: clean_comment(t) if t is not None else None, "string")
    lines = table(spark, sf, "symbols").select(F.explode(F.split("doc", "\n")).alias("line")).distinct()
    return lines.where(F.col("line").rlike(r"^[\x20-\x7e]*$")).select("line", clean("line").alias("text"))


def id_forms(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "symbols").select(F.upper("id").alias("text")).union(table(spark, sf, "refs").select("to_name")).distinct()
    return names.select("text", parse_id("text").alias("id"))


def hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of the inputs whose hashes are published as test vectors."""
    inputs = spark.createDataFrame([(n, "".join(map(chr, range(n)))) for n in range(4)], "n int, text string")
    return inputs.select("n", F.posexplode(F.transform(hash_embedding("text"), lambda e: F.round(e * 255).cast("int"))).alias("place", "byte"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings with those of every fifth id replaced by their double."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    new = rows.where("id % 5 = 0").withColumn("vec", F.transform("vec", lambda e: e * 2))
    return vectors.upsert(rows, new).select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, e: s + e.cast("double")), 4).alias("total"))


def regex_plugin(spark: SparkSession, sf: str) -> DataFrame:
    """Two plug-ins: what a function returns, and what it is told to do."""
    files = indexing.newest_files(table(spark, sf, "source_files"))
    plugins = PluginRegistry([RegexEdges("returns", _RETURNS, "returns"), RegexEdges("called", _ASSIGNS, "assigned", 2, 1)])
    return plugins.apply(files, _current(spark, sf)).groupBy("src", "to_name", "kind", "file").agg(F.count(F.lit(1)).alias("n"))


_RETURNS, _ASSIGNS = r"(?:func|fn|def|function) (\w+)\(\w*\) ?(?:->|:) ?(\w+)", r"(\w+) = (\w+)\("


def given_edges(spark: SparkSession, sf: str) -> DataFrame:
    """References by name beside edges whose other end is known."""
    known = _edges(spark, sf).where("kind = 'inherits'").select("src", F.lit("").alias("to_name"), "kind", F.lit(None).cast("string").alias("file"), (F.col("seq") + F.lit(1 << 40)).alias("ord"), "dst")
    refs = _refs(spark, sf).withColumn("dst", F.lit(None).cast("string")).unionByName(known)
    return indexing.resolve(refs, _current(spark, sf))


# -- files on disk -------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> Path:
    """A folder that this machine and the executors share."""
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file://"):
        raise RuntimeError("these queries need a shared folder that is mounted")
    return Path(root.removeprefix("file://").removeprefix("file:")) / f"{name}-{uuid.uuid4().hex[:12]}"


def _write_files(files: DataFrame, top: Path) -> None:
    """Each row's content under its name below the folder, by the executors."""
    base = str(top)

    def put(rows) -> None:
        for r in rows:
            path = Path(base) / r.file
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(bytes(r.content))

    top.mkdir(parents=True, exist_ok=True)
    files.select("file", "content").where("content IS NOT NULL").foreachPartition(put)


@lru_cache
def _on_disk(spark: SparkSession, sf: str) -> Path:
    top = _folder(spark, "files")
    _write_files(indexing.newest_files(table(spark, sf, "source_files")), top)
    return top


def walked_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of all projects on disk, walked with the default excludes and read."""
    config, registry = Config(base=_on_disk(spark, sf)), Registry.load()
    rows = walking.read_files(spark, config.base, walking.walk(config, registry), registry)
    return rows.select("file", "lang", "n_bytes", "status", "content_hash")


def loaded_configs(spark: SparkSession, sf: str) -> DataFrame:
    """The settings of every project, written as its file and read again."""
    top, rows = _folder(spark, "configs"), []
    for r in table(spark, sf, "configs").collect():  # one row a project
        base = top / r.project
        base.mkdir(parents=True)
        given = {k: v for k, v in (("roots", r.roots), ("exclude", r.exclude), ("index_dir", r.index_dir), ("languages", r.languages)) if v is not None}
        (base / ".symloom.toml").write_text("".join(f"{k} = {json.dumps(v)}\n" for k, v in given.items()))
        c = Config.load(base)
        rows.append((r.project, "|".join(c.roots), "|".join(c.exclude), c.index_dir, "|".join(c.languages), c.declared))
    return spark.createDataFrame(rows, "project string, roots string, exclude string, index_dir string, languages string, declared boolean")


def detected_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The languages that each project shows one level below its top, with
    every file moved up to there."""
    top, rows = _folder(spark, "detect"), []
    parts = F.split("file", "/")
    shown = table(spark, sf, "source_files").where("file IS NOT NULL").select(F.concat_ws("/", parts[0], parts[1], F.element_at(parts, -1)).alias("file")).distinct()
    for r in shown.toLocalIterator():
        path = top / r.file
        path.parent.mkdir(parents=True, exist_ok=True)
        path.touch()
    for project in sorted(p for p in top.iterdir() if p.is_dir()):
        rows += [(project.name, lang) for lang in detect_languages(project)]
    return spark.createDataFrame(rows, "project string, language string")


def builtin_extensions(spark: SparkSession, sf: str) -> DataFrame:
    every = Config(languages=list(BUILTIN)).extensions()
    return spark.createDataFrame([(x,) for x in every], "extension string")


def dispatched(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each file by its extension."""
    registry = Registry.load()

    def lang(path):
        found = registry.for_file(path) if path else None
        return found.id if found else None

    return table(spark, sf, "source_files").select("file").distinct().select("file", F.udf(lang, "string")("file").alias("lang"))


def git_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What git sees between a commit of the older files, one of which is then
    changed and one removed, and all files."""
    files = indexing.newest_files(table(spark, sf, "source_files")).where("mtime IS NOT NULL AND content IS NOT NULL")
    top = _folder(spark, "git")
    old = files.where(F.col("mtime").cast("timestamp_ntz") < F.lit(MOMENT).cast("timestamp_ntz"))
    _write_files(old, top)

    def git(*args: str) -> None:
        subprocess.run(["git", "-C", str(top), "-c", "user.name=x", "-c", "user.email=x@x", "-c", "core.autocrlf=false", *args], check=True, capture_output=True)

    git("init", "-q")
    git("add", "-A", "-f")
    git("commit", "-q", "-m", "older files")
    head = walking.git_head(top)
    names = [r.file for r in old.agg(F.min("file").alias("file")).union(old.agg(F.max("file"))).collect()]
    _write_files(files.join(old.select("file"), "file", "left_anti"), top)
    (top / names[0]).write_bytes(b"changed")
    (top / names[1]).unlink()
    return spark.createDataFrame(sorted(walking.git_changes(top, head).items()), "file string, change string")


def _project(spark: SparkSession, sf: str) -> Engine:
    """An engine over a folder of its own with all files."""
    top = _folder(spark, "project")
    _write_files(indexing.newest_files(table(spark, sf, "source_files")), top)
    return Engine(spark, top)


def _called(engine: Engine, name: str) -> dict:
    request = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": {}}}
    return json.loads(json.loads(Server(engine).answer(json.dumps(request)))["result"]["content"][0]["text"])


def tool_index(spark: SparkSession, sf: str) -> DataFrame:
    """A whole index of the files on disk by way of the tool server."""
    engine = _project(spark, sf)
    return _frame(spark, [_called(engine, "index") | {"file_count": engine.status()["file_count"]}], "status string, file_count long")


def tool_incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """A refresh after one file was changed, one added and one removed."""
    engine = _project(spark, sf)
    engine.index()
    paths = walking.walk(engine.config, engine.registry)
    (engine.base / paths[0]).write_bytes(b"changed")
    (engine.base / paths[1]).unlink()
    (engine.base / "added.py").write_text("def added():\n    return 1\n")
    return _frame(spark, [_called(engine, "incremental_index") | {"file_count": engine.status()["file_count"]}], "status string, files_updated long, files_deleted long, file_count long")


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    """What a project shows since its index was made, by content."""
    engine = _project(spark, sf)
    engine.index()
    paths = walking.walk(engine.config, engine.registry)
    (engine.base / paths[0]).write_bytes(b"changed")
    (engine.base / paths[1]).unlink()
    (engine.base / "added.py").write_text("def added():\n    return 1\n")
    return engine.changes("content")


def initialised(spark: SparkSession, sf: str) -> DataFrame:
    """What preparing a project writes, and that it does so once."""
    engine = Engine(spark, _folder(spark, "init"))
    engine.base.mkdir(parents=True)
    done = [engine.init(), engine.init()]
    found = sorted(p.relative_to(engine.base).as_posix() for p in engine.base.rglob("*.toml"))
    return spark.createDataFrame([(f, done[0], done[1]) for f in found], "file string, first boolean, again boolean")


_RULES = """
id = "toy"
extensions = ["toy", ".TOY2"]
family = "hash"
[[symbol]]
node = "function_definition"
match = '^to (?P<def>(?P<name>\\w+))'
ends = "line"
"""


def added_language(spark: SparkSession, sf: str) -> DataFrame:
    """A language added to a project, and which language files of it have then."""
    engine = Engine(spark, _folder(spark, "language"))
    engine.base.mkdir(parents=True)
    engine.init()
    rules = engine.base / "toy.toml"
    rules.write_text(_RULES)
    engine.add_language(rules)
    return spark.createDataFrame([(f, lang.id) for f in ("a.toy", "b.Toy2", "c.py", "d.toys", ".toy") if (lang := engine.registry.for_file(f))], "file string, language string")


def rule_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Which rule files are refused: no id, a broken pattern, an unknown family or front end, no TOML."""
    cases = {
        "good": _RULES, "no_id": _RULES.replace("id =", "ident ="), "pattern": _RULES.replace("(?P<name>", "(?P<name"), "family": _RULES.replace('"hash"', '"none"'),
        "front_end": 'frontend = "other"' + _RULES, "no_toml": "id = ",
    }

    def refused(text: str) -> bool:
        try:
            return not parse_language(text).rules
        except LanguageError:
            return True

    return spark.createDataFrame([(n, refused(t)) for n, t in cases.items()], "rules string, refused boolean")


def without_index(spark: SparkSession, sf: str) -> DataFrame:
    """What a project without an index says: its status, and that asking fails."""
    engine = Engine(spark, _folder(spark, "none"))
    try:
        engine.find("a")
        asked = "answered"
    except indexing.IndexNotFound:
        asked = "refused"
    return spark.createDataFrame([(engine.status()["status"], asked)], "status string, asked string")


def chosen_embedder(spark: SparkSession, sf: str) -> DataFrame:
    """The embedder where no model loads, and the length of what it makes of names."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        made = create_embedder("/nonexistent/model")
    lengths = vectors.index_names(_current(spark, sf), made).groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return lengths.select(F.lit(made.name).alias("name"), F.lit(made.dim).alias("dim"), "length", "n")


def _read(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(indexing.with_positions(indexing.newest_files(table(spark, sf, "source_files"))), Registry.load())


def extracted_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """The functions and classes of the symbols table, by file, name and place,
    that the extractor finds in the files that parse. Minified files, whose
    rows of one letter all lie at the file's beginning, are left aside."""
    found = symbols_of(_read(spark, sf)).select("file", "name", "start_byte", F.lit(True).alias("found")).distinct()
    rows = _symbols(spark, sf).join(indexing.newest_files(table(spark, sf, "source_files")).where("status = 'ok'").select("file"), "file", "left_semi")
    asked = rows.where("kind IN ('function', 'class', 'struct', 'trait') AND start_byte IS NOT NULL AND length(name) > 1").select("lang", "file", "name", "start_byte").distinct()
    return asked.join(found, ["file", "name", "start_byte"], "left_semi")


def extracted_imports(spark: SparkSession, sf: str) -> DataFrame:
    """What Python files that parse import, as often as they do."""
    ok = indexing.newest_files(table(spark, sf, "source_files")).where("status = 'ok'").select("file")
    rows = references_of(_read(spark, sf)).where("kind = 'imports'").where(F.col("file").endswith(".py")).join(ok, "file", "left_semi")
    return rows.groupBy("file", "to_name").agg(F.count(F.lit(1)).alias("n"))


def refreshed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of an index of the older files that was then refreshed with all."""
    files = indexing.newest_files(table(spark, sf, "source_files")).withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
    folder, registry = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex[:12]}", Registry.load()
    indexing.build(spark, files.where(F.col("mtime") < F.lit(MOMENT).cast("timestamp_ntz")), registry, folder)
    indexing.refresh(spark, files, registry, folder)
    return indexing.open_index(spark, folder).table("files").select("file", "content_hash", "n_bytes")


def refresh_differences(spark: SparkSession, sf: str) -> DataFrame:
    """How many symbols a refreshed index has or lacks against one built at once."""
    files = indexing.newest_files(table(spark, sf, "source_files")).withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
    folder, registry = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex[:12]}", Registry.load()
    indexing.build(spark, files.where(F.col("mtime") < F.lit(MOMENT).cast("timestamp_ntz")), registry, folder)
    indexing.refresh(spark, files, registry, folder)
    shown = ("id", "name", "kind", "fqname", "file", "start_byte", "end_byte", "signature", "doc")
    done = indexing.open_index(spark, folder).symbols.select(*shown)
    whole = indexing.build(spark, files, registry, folder + "-whole").symbols.select(*shown)
    return done.exceptAll(whole).unionByName(whole.exceptAll(done)).agg(F.count(F.lit(1)).alias("differences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        stored_symbols, stored_edges, stored_vectors, stored_postings, stored_state, removed_postings, engine_search, engine_search_kind, engine_semantic_search, engine_find,
        engine_resolve, engine_callers, engine_callees, engine_languages, neighborhood_text, tool_search, tool_semantic_search, tool_find_symbol, tool_get_symbol,
        tool_find_callers, tool_find_callees, tool_expand_neighborhood, tool_index_status, console_find, kind_of_node, qualified, first_owner, signatures, comment_lines,
        id_forms, hash_vectors, vector_upsert, regex_plugin, given_edges, walked_files, loaded_configs, detected_languages, builtin_extensions, dispatched, git_changes,
        refreshed_files, refresh_differences, tool_index, tool_incremental_index, changed_files, initialised, added_language, rule_errors, without_index,
        chosen_embedder, extracted_definitions, extracted_imports,
    )
}

_EDGES = f"ed AS (SELECT src, dst, kind, ref_seq AS seq FROM ({RESOLVED}))"
_HUB = "hub AS (SELECT dst AS id FROM ed GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
_VEC = """vx AS (SELECT id, vec FROM (SELECT id, vec, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM vectors WHERE id IS NOT NULL)
    WHERE r = 1 AND len(vec) = 32 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0)"""
# The published hashes of no byte, of 0, of 0 1 and of 0 1 2.
PUBLISHED = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    2: "7b7015bb92cf0b318037702a6cdd81dee41224f734684c2c122cd6359cb1ee63", 3: "e1be4d7a8ab5560aa4199eea339849ba8e293d55ca0a81006726d184519e647f",
}
_EMPTY = "[" + ", ".join(f"{b}::DOUBLE / 255" for b in bytes.fromhex(PUBLISHED[0])) + "]"
_F = f"""f AS (SELECT id, 'name' AS field, {_WORDS.format('name')} AS w FROM cur UNION ALL SELECT id, 'fqname', {_WORDS.format('fqname')} FROM cur
    UNION ALL SELECT id, 'file_text', {_WORDS.format('file')} FROM cur UNION ALL SELECT id, 'signature', coalesce({_WORDS.format('signature')}, []) FROM cur)"""
_RAW = "r AS (SELECT id, field, list_filter([v], lambda x: x IS NOT NULL) AS w FROM (SELECT id, 'file' AS field, file AS v FROM cur UNION ALL SELECT id, 'kind', kind FROM cur UNION ALL SELECT id, 'lang', lang FROM cur UNION ALL SELECT id, 'id', id FROM cur))"
_HITS = f"""{_F}, ln AS (SELECT id, field, coalesce(len(w), 0) AS dl, w FROM f), st AS (SELECT field, count(*) AS n, avg(dl) AS av FROM ln GROUP BY field),
    tf AS (SELECT id, field, dl, len(list_filter(w, lambda x: x = '{ASKED}')) AS tf FROM ln), df AS (SELECT field, count(*) AS df FROM tf WHERE tf > 0 GROUP BY field),
    hit AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 9) AS sc FROM tf JOIN df USING (field) JOIN st USING (field) WHERE tf > 0 GROUP BY id)"""
_SEARCH = f"WITH {_CUR}, {_HITS} SELECT id, name, kind, lang, file, round(sc, 4) AS score FROM hit JOIN cur USING (id) ORDER BY sc DESC, id LIMIT 20"
_SEMANTIC = f"WITH {_CUR}, {_VEC}, c AS (SELECT id, name, round(list_cosine_similarity(vec::DOUBLE[], {_EMPTY}), 9) AS s FROM vx JOIN cur USING (id) WHERE list_aggregate(list_transform(vec, lambda x: abs(x)), 'max') > 0) SELECT id, name, round(s, 4) AS score FROM c ORDER BY s DESC, id LIMIT 10"
_AROUND = f"""WITH {_CUR}, {_EDGES}, {_HUB}, n AS (SELECT id, 0 AS d FROM hub UNION ALL SELECT x, 1 FROM (SELECT dst AS x FROM ed WHERE src IN (SELECT id FROM hub) UNION SELECT src FROM ed WHERE dst IN (SELECT id FROM hub)) WHERE x NOT IN (SELECT id FROM hub)),
    m AS (SELECT src, dst, kind FROM ed WHERE src IN (SELECT id FROM hub) UNION ALL SELECT src, dst, kind FROM ed WHERE dst IN (SELECT id FROM hub))"""


def _at_hub(mine: str, other: str) -> str:
    return f"""WITH {_CUR}, {_EDGES}, {_HUB.replace('dst', mine)} SELECT o.id, o.name, o.kind, o.file, first_value(ed.kind) OVER (PARTITION BY ed.src, ed.dst ORDER BY ed.seq DESC) AS edge_kind
        FROM ed JOIN cur o ON o.id = ed.{other} WHERE ed.{mine} IN (SELECT id FROM hub)"""


_LANG = "CASE WHEN x IN ('c', 'h') THEN 'c' WHEN x = 'go' THEN 'go' WHEN x IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN x = 'py' THEN 'python' WHEN x = 'rs' THEN 'rust' WHEN x IN ('ts', 'tsx') THEN 'typescript' END"
_EXT = r"lower(regexp_extract(file, '[^/]\.([^./]+)$', 1))"
_DEFAULTS = "**/.git/**|**/node_modules/**|**/target/**|**/build/**|**/__pycache__/**|**/.venv/**|**/*.min.js|**/vendor/**|**/dist/**"
_VALID = "SELECT DISTINCT file, try(decode(content)) AS t FROM source_files WHERE file IS NOT NULL"
_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) AS v({names})"


_WALKED = f"""SELECT DISTINCT file, {_LANG} AS lang, octet_length(content) AS n_bytes, 'ok' AS status, sha256(content) AS content_hash FROM (SELECT file, content, {_EXT} AS x FROM source_files WHERE content IS NOT NULL)
        WHERE {_LANG} IS NOT NULL AND NOT regexp_matches(file, '(^|/)(node_modules|target|build|__pycache__|vendor|dist|[.][^/]*)(/|$)') AND NOT ends_with(file, '.min.js')"""

ORACLE = {
    "stored_symbols": f"WITH {_CUR} SELECT id, name, lower(name) AS name_ci, kind, lang, file FROM cur",
    "stored_edges": f"WITH {_EDGES} SELECT * FROM ed",
    "stored_vectors": f"WITH {_VEC} SELECT id, len(vec) AS n, round(list_sum(vec::DOUBLE[]), 4) AS total FROM vx",
    "stored_postings": POSTINGS,
    "stored_state": f"WITH {_CUR}, {_EDGES}, {_VEC} SELECT (SELECT count(DISTINCT file) FROM source_files WHERE status = 'ok') AS file_count, (SELECT count(*) FROM cur) AS symbols, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM vx) AS vectors, 'hash' AS embedder, 32::BIGINT AS dim, 'none' AS git_head",
    "removed_postings": f"""WITH {_CUR.replace('cur AS', 'whole AS', 1)}, cur AS (SELECT * FROM whole WHERE id NOT IN (SELECT id FROM whole WHERE file IN (SELECT file FROM source_files WHERE status <> 'ok'))), {_F}, {_RAW},
        a AS (SELECT id, field, coalesce(w, []) AS w FROM f UNION ALL SELECT * FROM r)
        SELECT field, count(*) AS n_docs, round(avg(len(w)), 6) AS avg_dl, sum(len(list_distinct(w)))::BIGINT AS n_postings FROM a GROUP BY field""",
    "engine_search": _SEARCH,
    "engine_search_kind": f"WITH {_CUR}, {_F} SELECT DISTINCT id, kind FROM cur JOIN f USING (id) WHERE kind = 'function' AND list_contains(w, '{ASKED}')",
    "engine_semantic_search": _SEMANTIC,
    "engine_find": f"WITH {_CUR} SELECT id, name, kind, file FROM cur WHERE contains(lower(name), 'shift') ORDER BY lower(name), ord, id LIMIT 20",
    "engine_resolve": f"""WITH {_CUR}, a AS (SELECT unnest(['a', 'shift', 'e_p', 'er']) AS asked)
        SELECT asked, id FROM (SELECT asked, id, row_number() OVER (PARTITION BY asked ORDER BY name = asked DESC, starts_with(lower(name), asked) DESC, length(name), ord, id) AS r FROM a JOIN cur ON contains(lower(name), asked)) WHERE r = 1""",
    "engine_callers": _at_hub("dst", "src"),
    "engine_callees": _at_hub("src", "dst"),
    "engine_languages": f"SELECT {_LANG} AS language, x AS extension, {_LANG} AS dispatched FROM (SELECT unnest(['c', 'h', 'go', 'js', 'jsx', 'mjs', 'cjs', 'py', 'rs', 'ts', 'tsx']) AS x)",
    "neighborhood_text": f"""{_AROUND}, nl AS (SELECT row_number() OVER (ORDER BY d, name NULLS FIRST, cur.id) AS r, '  ' || coalesce(name, 'None') || ' (' || coalesce(kind, 'None') || ') ' || coalesce(file, 'None') || CASE WHEN d = 0 THEN ' [CENTER]' ELSE '' END AS line FROM n JOIN cur USING (id)),
        el AS (SELECT row_number() OVER (ORDER BY a, b, kind NULLS FIRST) AS r, '  ' || a || ' --[' || coalesce(kind, 'None') || ']--> ' || b AS line FROM (SELECT coalesce(s.name, '?') AS a, coalesce(t.name, '?') AS b, m.kind FROM m LEFT JOIN cur s ON s.id = m.src LEFT JOIN cur t ON t.id = m.dst))
        SELECT 0::BIGINT AS n, (SELECT count(*) FROM n) || ' nodes, ' || (SELECT count(*) FROM m) || ' edges' AS line UNION ALL SELECT 1, 'Nodes:' UNION ALL SELECT 1 + r, line FROM nl
        UNION ALL SELECT 2 + (SELECT count(*) FROM nl), 'Edges:' UNION ALL SELECT 2 + (SELECT count(*) FROM nl) + r, line FROM el""",
    "tool_search": _SEARCH,
    "tool_semantic_search": _SEMANTIC,
    "tool_find_symbol": f"WITH {_CUR} SELECT id, name, kind, lang, file, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, signature FROM cur WHERE contains(lower(name), 'e') AND kind = 'method' AND lang = 'python' ORDER BY lower(name), ord, id LIMIT 30",
    "tool_get_symbol": f"WITH {_CUR}, {_EDGES}, {_HUB} SELECT id, name, kind, lang, file, fqname, signature, doc FROM cur WHERE id IN (SELECT id FROM hub)",
    "tool_find_callers": _at_hub("dst", "src"),
    "tool_find_callees": _at_hub("src", "dst"),
    "tool_expand_neighborhood": f"{_AROUND} SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM m) AS edge_count",
    "tool_index_status": f"WITH {_CUR}, {_EDGES} SELECT (SELECT count(*) FROM cur) AS symbols, (SELECT count(*) FROM ed) AS edges, (SELECT count(DISTINCT file) FROM source_files WHERE status = 'ok') AS file_count",
    "console_find": f"""WITH {_CUR}, l AS (SELECT rtrim(name || ' (' || coalesce(kind, 'None') || ', ' || coalesce(lang, 'None') || ') ' || coalesce(file, 'None') || ':' || coalesce(start_line::VARCHAR, 'None') || ' ' || coalesce(signature, ''), ' ' || chr(9) || chr(10) || chr(13)) AS line
        FROM cur WHERE contains(lower(name), 'shift') ORDER BY lower(name), ord, id LIMIT 20) SELECT unnest(regexp_split_to_array(line, '\r\n|\n|\r')) AS line FROM l""",
    "kind_of_node": _values(NODES, "node, kind"),
    "qualified": f"""WITH {_CUR}, k AS (SELECT * FROM cur WHERE file IS NOT NULL AND name IS NOT NULL AND start_byte < end_byte),
        sc AS (SELECT DISTINCT file, start_byte AS a, end_byte AS b, name FROM k WHERE kind IN ('class', 'struct', 'trait', 'module', 'function')),
        q AS (SELECT k.id, string_agg(sc.name, '::' ORDER BY sc.a, -sc.b, sc.name) AS names FROM k JOIN sc ON sc.file = k.file AND (sc.a < k.start_byte OR (sc.a = k.start_byte AND sc.b >= k.end_byte)) AND sc.b >= k.end_byte GROUP BY k.id)
        SELECT k.id, k.file || '::' || coalesce(names || '::', '') || k.name AS fqname FROM k LEFT JOIN q USING (id)""",
    "first_owner": f"""WITH {_CUR}, k AS (SELECT * FROM cur WHERE file IS NOT NULL AND start_byte < end_byte),
        x AS (SELECT m.id AS site, o.id AS owner, row_number() OVER (PARTITION BY m.id ORDER BY o.ord, o.id) AS r FROM k m JOIN k o ON o.file = m.file AND m.start_byte >= o.start_byte AND m.start_byte < o.end_byte
        WHERE m.kind IN ('method', 'field') AND o.kind NOT IN ('method', 'field', 'module')) SELECT site, owner FROM x WHERE r = 1""",
    "signatures": f"""WITH c AS (SELECT item_id, text, i, substr(text, i, 1) AS c FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM eval_items)),
        d AS (SELECT *, coalesce(sum(CASE WHEN c IN ('(', '[') THEN 1 WHEN c IN (')', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
              coalesce(lead(c) OVER (PARTITION BY item_id ORDER BY i), '') AS nxt FROM c),
        e AS (SELECT item_id, min(CASE WHEN c = '{{' THEN i - 1 ELSE i END) AS stop FROM d WHERE depth = 0 AND (c = '{{' OR (c = ':' AND i > 1 AND nxt IN ('', ' ', chr(10)))) GROUP BY item_id)
        SELECT t.item_id, trim(regexp_replace(CASE WHEN stop IS NULL THEN text ELSE substr(text, 1, stop) END, '{_BLANKS}', ' ', 'g'), ' ') AS signature FROM eval_items t LEFT JOIN e USING (item_id)""",
    "comment_lines": r"""WITH l AS (SELECT DISTINCT unnest(string_split(doc, chr(10))) AS line FROM symbols)
        SELECT line, trim(ltrim(trim(ltrim(trim(regexp_replace(trim(regexp_replace(trim(line), '^(///|//!|//|/\*\*)+', '')), '\*/$', '')), '*')), '#')) AS text FROM l WHERE regexp_full_match(line, '[\x20-\x7e]*')""",
    "id_forms": "SELECT text, CASE WHEN regexp_full_match(text, '[0-9a-fA-F]{32}') THEN lower(text) END AS id FROM (SELECT upper(id) AS text FROM symbols UNION SELECT to_name FROM refs)",
    "hash_vectors": f"SELECT n, i::INT AS place, ('0x' || substr(h, 2 * i + 1, 2))::INT AS byte FROM (SELECT n, h, unnest(range(32)) AS i FROM ({_values([*PUBLISHED.items()], 'n, h')}))",
    "vector_upsert": "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]) * CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END, 4) AS total FROM embeddings",
    "regex_plugin": f"""WITH {_CUR}, v AS ({_VALID}), last AS (SELECT name, arg_max(id, ord) AS src FROM cur WHERE name IS NOT NULL GROUP BY name),
        h AS (SELECT file, unnest(regexp_extract_all(t, '{_RETURNS}', 1)) AS name, unnest(regexp_extract_all(t, '{_RETURNS}', 2)) AS to_name, 'returns' AS kind FROM v
              UNION ALL SELECT file, unnest(regexp_extract_all(t, '{_ASSIGNS}', 2)), unnest(regexp_extract_all(t, '{_ASSIGNS}', 1)), 'assigned' FROM v)
        SELECT src, to_name, kind, file, count(*) AS n FROM h JOIN last USING (name) GROUP BY ALL""",
    "given_edges": f"WITH {_CUR}, {_EDGES}, {_E} SELECT src, dst, kind, seq FROM ed UNION ALL SELECT src, dst, kind, max(seq) + {1 << 40} FROM e WHERE kind = 'inherits' AND src IN (SELECT id FROM cur) AND dst IN (SELECT id FROM cur) GROUP BY src, dst, kind",
    "walked_files": _WALKED,
    "loaded_configs": f"SELECT project, array_to_string(coalesce(roots, ['.']), '|') AS roots, coalesce(array_to_string(exclude, '|'), '{_DEFAULTS}') AS exclude, coalesce(index_dir, '.symloom') AS index_dir, coalesce(array_to_string(languages, '|'), '') AS languages, coalesce(len(languages), 0) > 0 AS declared FROM configs",
    "detected_languages": f"SELECT DISTINCT split_part(file, '/', 1) AS project, {_LANG} AS language FROM (SELECT file, {_EXT} AS x FROM source_files) WHERE {_LANG} IS NOT NULL AND split_part(file, '/', 2) NOT IN ('node_modules', 'target')",
    "builtin_extensions": _values([(x,) for x in "c h rs py js jsx mjs cjs ts tsx go java rb cs cpp cc cxx hpp hxx sql html htm".split()], "extension"),
    "dispatched": f"SELECT file, {_LANG} AS lang FROM (SELECT DISTINCT file, {_EXT} AS x FROM source_files)",
    "git_changes": f"""WITH f AS (SELECT DISTINCT file, mtime::TIMESTAMP < TIMESTAMP '{MOMENT}' AS old FROM source_files WHERE mtime IS NOT NULL AND content IS NOT NULL)
        SELECT file, 'A' AS change FROM f WHERE NOT old UNION ALL SELECT min(file), 'M' FROM f WHERE old UNION ALL SELECT max(file), 'D' FROM f WHERE old""",
    "extracted_definitions": f"SELECT DISTINCT lang, file, name, start_byte FROM ({_ALL}) WHERE kind IN ('function', 'class', 'struct', 'trait') AND start_byte IS NOT NULL AND length(name) > 1 AND file IN (SELECT file FROM source_files WHERE status = 'ok')",
    "extracted_imports": r"""WITH v AS (SELECT DISTINCT file, decode(content) AS t FROM source_files WHERE status = 'ok' AND ends_with(file, '.py'))
        SELECT file, to_name, count(*) AS n FROM (SELECT file, unnest(regexp_extract_all(t, '(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b', 1)) AS to_name FROM v UNION ALL SELECT file, unnest(regexp_extract_all(t, '(?m)^[ \t]*import[ \t]+([\w.]+)', 1)) FROM v) GROUP BY ALL""",
    "changed_files": f"WITH w AS (SELECT file, row_number() OVER (ORDER BY file) AS r FROM ({_WALKED})) SELECT file, CASE r WHEN 1 THEN 'M' ELSE 'D' END AS change FROM w WHERE r <= 2 UNION ALL SELECT 'added.py', 'A'",
    "initialised": "SELECT '.symloom/languages/' || unnest(['c', 'go', 'javascript', 'python', 'rust', 'typescript']) || '.toml' AS file, true AS first, false AS again",
    "added_language": _values([("a.toy", "toy"), ("b.Toy2", "toy"), ("c.py", "python")], "file, language"),
    "rule_errors": "SELECT * FROM (VALUES ('good', false), ('no_id', true), ('pattern', true), ('family', true), ('front_end', true), ('no_toml', true)) AS v(rules, refused)",
    "without_index": "SELECT 'no_index' AS status, 'refused' AS asked",
    "chosen_embedder": f"WITH {_CUR} SELECT 'hash' AS name, 32 AS dim, 32 AS length, count(*) AS n FROM cur WHERE name IS NOT NULL UNION ALL SELECT 'hash', 32, -1, count(*) FROM cur WHERE name IS NULL HAVING count(*) > 0",
    "tool_index": f"SELECT 'ok' AS status, count(DISTINCT file) AS file_count FROM ({_WALKED})",
    "tool_incremental_index": f"SELECT 'ok' AS status, 2::BIGINT AS files_updated, 1::BIGINT AS files_deleted, count(DISTINCT file) AS file_count FROM ({_WALKED})",
    "refreshed_files": "SELECT DISTINCT file, content_hash, n_bytes FROM source_files WHERE file IS NOT NULL",
    "refresh_differences": "SELECT 0::BIGINT AS differences",
}
