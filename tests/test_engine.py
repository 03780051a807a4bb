"""The whole pipeline on a small project: build, refresh, ask, serve, stream."""

import io
import json
import os
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from symloom import cli, rpc
from symloom.engine import Engine
from symloom.extract.rules import Registry
from symloom.extract.tables import PluginRegistry, RegexEdges
from symloom.functions.embedders import HashEmbedder, create_embedder
from symloom.plans import index as indexing
from symloom.sources import config as conf
from symloom.sources import walk as walking
from symloom.streaming import watch as watching


def put(base, files):
    for name, text in files.items():
        path = base / name
        if text is None:
            path.unlink()
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text if isinstance(text, bytes) else text.encode())


FILES = {
    "main.py": "from lib import helper\n\ndef main():\n    helper()\n    process_data()\n",
    "lib/__init__.py": "def helper():\n    return process_data()\n",
    "lib/data.py": "# Works on rows.\ndef process_data():\n    pass\n",
    "app/run.go": "package app\n\nfunc Run() {\n\thelper()\n}\n",
    "notes.txt": "no code",
    ".hidden/x.py": "def hidden(): pass\n",
    "node_modules/m.js": "function vendored() {}\n",
    "skipped/s.py": "def skipped(): pass\n",
    "skipped/keep.py": "def kept(): pass\n",
    ".gitignore": "skipped/*\n!skipped/keep.py\n",
}


@pytest.fixture
def project(tmp_path):
    put(tmp_path, FILES)
    return tmp_path


def edges(engine):
    s = engine.index_tables.symbols
    rows = engine.index_tables.edges.join(s.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return Counter((r.a, r.b, r.kind) for r in rows.collect())


def content(index, name, *drop):
    df = index.table(name)
    return Counter(map(tuple, (r for r in df.select(*sorted(c for c in df.columns if c not in drop)).selectExpr("to_json(struct(*))").collect())))


def test_config_and_walk(project):
    config = conf.Config.load(project)
    assert set(config.languages) >= {"python", "go"} and not config.declared and config.roots == ["."]
    assert walking.walk(config, Registry.load()) == ["app/run.go", "lib/__init__.py", "lib/data.py", "main.py", "skipped/keep.py"]
    put(project, {conf.CONFIG_FILE: 'roots = ["lib", "app"]\nlanguages = ["python"]\nexclude = ["**/data.py"]\n'})
    config = conf.Config.load(project)
    assert walking.walk(config, Registry.load()) == ["lib/__init__.py"] and config.extensions() == ["py"]
    put(project, {conf.CONFIG_FILE: "nonsense = 1\n"})
    with pytest.raises(ValueError, match="unknown settings"):
        conf.Config.load(project)


def test_languages_dir_and_init(project, spark, monkeypatch):
    monkeypatch.delenv(conf.LANGUAGES_ENV, raising=False)
    monkeypatch.setenv("XDG_DATA_HOME", str(project / "none"))
    engine = Engine(spark, project)
    assert conf.languages_dir(project) == conf.PACKAGED
    with pytest.raises(RuntimeError, match="init"):
        engine.add_language("x.toml")
    (project / ".git").mkdir()
    assert engine.init() and not engine.init()
    assert conf.INDEX_DIR in (project / ".gitignore").read_text() and (project / ".vscode/mcp.json").exists()
    put(project, {"ini.toml": "id='ini'\nextensions=['ini']\nfamily='hash'\n[[symbol]]\nnode='module'\nmatch='^\\[(?P<name>\\w+)\\]'\nends='line'\n"})
    assert engine.add_language(project / "ini.toml") == "ini" and "ini" in engine.languages()


def test_build_ask_and_refresh_equals_rebuild(project, spark):
    engine = Engine(spark, project)
    assert engine.status() == {"status": "no_index"}
    with pytest.raises(indexing.IndexNotFound):
        engine.find("x")
    engine.index()
    assert edges(engine) == {("main", "helper", "calls"): 1, ("main", "process_data", "calls"): 1, ("helper", "process_data", "calls"): 1, ("Run", "helper", "calls"): 1}
    assert [r.name for r in engine.search("process_data").collect()] == ["process_data"]
    assert {r.file for r in engine.search("file_text:lib").collect()} == {"lib/__init__.py", "lib/data.py"}
    assert engine.semantic_search("helper", 1).first().name == "helper" and engine.semantic_search("helper", 1).first().score > 0.999
    assert [r.name for r in engine.callers("process_data").collect()] == ["helper", "main"] and [r.name for r in engine.callees("Run").collect()] == ["helper"]
    status = engine.status()
    assert (status["file_count"], status["symbols"], status["edges"]) == (5, 5, 4)
    assert engine.index(incremental=True) == indexing.Refreshed(0, 0, 0, 0)
    put(project, {"lib/data.py": "def other():\n    pass\n", "app/run.go": None, "new.py": "def process_data():\n    main()\n", "lib/bad.py": b"\xff\xfe def x("})
    done = engine.index(incremental=True)
    assert (done.files_updated, done.files_deleted, done.symbols_removed) == (3, 1, 2)
    refreshed = engine.index_tables
    assert edges(engine) == {("main", "helper", "calls"): 1, ("main", "process_data", "calls"): 1, ("helper", "process_data", "calls"): 1, ("process_data", "main", "calls"): 1}
    engine.index()
    fresh = engine.index_tables
    for table, drop in (("symbols", ("ord",)), ("refs", ("ord",)), ("edges", ("seq",)), ("postings", ()), ("vectors", ()), ("files", ("pos",))):
        assert content(refreshed, table, *drop) == content(fresh, table, *drop), table
    indexing.drop_old(spark, engine.folder, [v for v in os.listdir(engine.folder) if v.startswith("v-")])
    assert len([v for v in os.listdir(engine.folder) if v.startswith("v-")]) == 1


def test_refresh_reads_only_what_may_have_changed(project, spark, monkeypatch):
    from symloom.sources import walk

    engine, read, asked = Engine(spark, project), walk.read_files, []
    engine.index()
    monkeypatch.setattr(walk, "read_files", lambda s, b, paths, r: asked.append(list(paths)) or read(s, b, paths, r))
    assert engine.index(incremental=True) == indexing.Refreshed(0, 0, 0, 0)
    (project / "added_later.py").write_text("def added_later():\n    return 1\n")
    assert engine.index(incremental=True).files_updated == 1
    (project / "added_later.py").unlink()
    assert engine.index(incremental=True).files_deleted == 1
    assert asked == [[], ["added_later.py"], []]
    assert engine.search("added_later").count() == 0 and engine.index_tables.table("vectors").count() == engine.index_tables.symbols.count()
    assert engine.index(incremental=True, by="content") == indexing.Refreshed(0, 0, 0, 0) and len(asked[-1]) > 1


def test_changes_views_and_embedders(project, spark):
    run = lambda *a: subprocess.run(["git", "-C", str(project), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    engine = Engine(spark, project)
    engine.index()
    put(project, {"main.py": "x = 1\n", "lib/data.py": None, "added.py": "y = 2\n"})
    os.utime(project / "main.py", (2e9, 2e9))
    want = {("main.py", "M"), ("lib/data.py", "D"), ("added.py", "A")}
    assert {tuple(r) for r in engine.changes().collect()} == want
    assert {tuple(r) for r in engine.changes("git").collect()} == want
    assert ("main.py", "M") in {tuple(r) for r in engine.changes("mtime").collect()}
    assert "code_symbols" in engine.register_views() and spark.sql("SELECT count(*) FROM code_symbols").first()[0] == 5
    with pytest.warns(UserWarning, match="hashed"):
        assert create_embedder("/no/such/model").name == "hash"

    class Other(HashEmbedder):
        name = "other"

    with pytest.raises(RuntimeError, match="build it anew"):
        Engine(spark, project, embedder=Other()).index(incremental=True)


def test_plugins_in_the_pipeline(project, spark):
    plugins = PluginRegistry()
    plugins.register(RegexEdges("doc", r"def (\w+)\(\):\n    return (\w+)", "returns"))
    engine = Engine(spark, project, plugins)
    engine.index()
    assert edges(engine)[("helper", "process_data", "returns")] == 1 and sum(edges(engine).values()) == 5


def test_empty_project(tmp_path, spark):
    engine = Engine(spark, tmp_path)
    engine.index()
    assert engine.status()["symbols"] == 0 and engine.search("x").count() == 0 and engine.semantic_search("x").count() == 0


def test_git(project):
    run = lambda *a: subprocess.run(["git", "-C", str(project), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    assert walking.git_head(project) is None and walking.git_changes(project, "HEAD") is None
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    head = walking.git_head(project)
    put(project, {"main.py": "x = 1\n", "lib/data.py": None, "a b.py": "y = 2\n"})
    assert walking.git_changes(project, head) == {"main.py": "M", "lib/data.py": "D", "a b.py": "A"}


def test_cli(project, spark):
    engine = Engine(spark, project)

    def out(*argv):
        text = io.StringIO()
        cli.run(engine, cli.parser().parse_args(argv), text)
        return text.getvalue()

    assert out("index").startswith("indexed in")
    assert "process_data (function, python) - lib/data.py [score:" in out("search", "process_data")
    assert "helper (function, python) lib/__init__.py:0 def helper():" in out("find", "HELP")
    assert "main (function) main.py [calls]" in out("callers", "helper")
    assert "process_data" in out("callees", "main") and "[CENTER]" in out("neighborhood", "main", "--depth", "1")
    assert "file_count: 5" in out("status") and "rust" in out("languages") and "score" in out("semantic-search", "main", "--limit", "1")
    assert "files_updated=0" in out("index", "--incremental")


def test_rpc(project, spark):
    server = rpc.Server(Engine(spark, project))
    ask = lambda method, **params: json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))

    def tool(name, **args):
        reply = ask("tools/call", name=name, arguments=args)
        return json.loads(reply["result"]["content"][0]["text"]) if "result" in reply else reply["error"]["code"]

    assert server.answer("  \n") is None
    assert json.loads(server.answer("{"))["error"]["code"] == -32700 and json.loads(server.answer("[]"))["error"]["code"] == -32600
    assert json.loads(server.answer('{"id": 3, "method": "x"}'))["error"]["code"] == -32600
    assert ask("nothing")["error"]["code"] == -32601 and ask("tools/call")["error"]["code"] == -32602
    assert ask("initialize")["result"]["protocolVersion"] and len(ask("tools/list")["result"]["tools"]) == 10
    assert tool("index_status") == {"status": "no_index"} and tool("search", query="x") == []
    assert tool("index")["symbols"] == 5
    hit = tool("find_symbol", needle="helper")[0]
    assert hit["start_line"] == 0 and tool("get_symbol", id=hit["id"])["fqname"].endswith("helper::helper")
    assert {r["name"] for r in tool("find_callers", id=hit["id"])} == {"main", "Run"} and [r["name"] for r in tool("find_callees", id=hit["id"])] == ["process_data"]
    assert tool("expand_neighborhood", id=hit["id"], depth=1)["node_count"] == 4
    assert tool("get_symbol", id="zz") == -32602 and tool("get_symbol", id="0" * 32) == -32602 and tool("find_callers", id="0" * 32) == [] and tool("nope") == -32601
    assert tool("search", query="helper")[0]["name"] == "helper" and tool("semantic_search", query="main", limit=1)[0]["name"] == "main"
    assert tool("incremental_index") == {"files_updated": 0, "files_deleted": 0, "symbols_added": 0, "symbols_removed": 0, "status": "ok"}
    assert tool("search", query="(")  == -32602
    replies = []
    rpc.serve(server, ["\n", '{"jsonrpc": "2.0", "id": 9, "method": "initialize"}\n'], replies.append)
    assert len(replies) == 1


def test_watch_refreshes_and_survives_errors(project, spark):
    engine, errors = Engine(spark, project), []
    engine.index()
    query = engine.watch("1 second", errors)
    try:
        put(project, {"late.py": "def late(): pass\n", "main.py": None})
        for _ in range(60):
            query.awaitTermination(1)
            names = {r.name for r in indexing.open_index(spark, engine.folder).symbols.collect()}
            if "late" in names:
                break
        assert "late" in names and "main" not in names
    finally:
        query.stop()
    failing = watching.watch(spark, lambda: 1 / 0, "1 second", errors=errors)
    failing.awaitTermination(4)
    assert failing.isActive and errors
    failing.stop()


def test_session_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = watching.session_stream(watching.read_stream(spark, path, batch.schema), "user_id", "ts")
    got = watching.run_available(stream)
    from symloom.operators.deltas import sessions

    want = sessions(batch, "user_id", "ts")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
