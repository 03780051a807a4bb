"""Operators over the code graph: properties against plain Python, and every
query that has SQL against that SQL on the smallest tables."""

import random
from collections import Counter, deque

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from symloom.functions import blake
from symloom.functions.scalars import collapse_blanks, cosine, extension, hash_embedding, parse_id, symbol_id, tokens
from symloom.operators import deltas, fulltext, graph, vectors

SF = "/root/testdata/sf0.001"
SYMBOLS = "id string, name string, kind string, lang string, file string, ord long"
EDGES = "src string, dst string, kind string, seq long"


# -- functions --------------------------------------------------------------


def test_blake_published_vectors():
    # The specification's vectors for inputs of 0, 1, 1024, 1025 and 2049 bytes counting up to 250.
    want = {0: "af1349b9f5f9a1a6a0404dea36dcc949", 1: "2d3adedff11b61f14c886e35afa03673", 1024: "42214739f095a406f3fc83deb889744a", 1025: "d00278ae47eb27b34faecf67b4fe263f", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3"}
    data = [bytes(i % 251 for i in range(n)) for n in want]
    assert [h[:16].tobytes().hex() for h in blake.hashes(data)] == list(want.values())


def test_scalars(spark):
    df = spark.createDataFrame([("go", "function", "a.go::f", "a.go"), ("go", None, "a", "b")], "l string, k string, q string, f string")
    ids = [r[0] for r in df.select(symbol_id("l", "k", "q", "f")).collect()]
    assert ids == [blake.hex_hash(b"go:function:a.go::f:a.go")[:32], None]
    texts = ["  a \n\t b ", "", None, "process_data x2 " + "y" * 41, "x/a.b.go", "x/.hidden", "F" * 32, "zz"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(collapse_blanks("t"), tokens("t"), extension("t"), parse_id("t"), hash_embedding("t")).collect()
    assert [r[0] for r in rows][:3] == ["a b", "", None]
    assert rows[3][1] == ["process", "data", "x2"] and rows[1][1] == [] and rows[2][1] is None
    assert (rows[4][2], rows[5][2], rows[7][2]) == ("go", "", "")
    assert (rows[6][3], rows[7][3]) == ("f" * 32, None)
    assert rows[2][4] is None and len(rows[1][4]) == 32 and rows[7][4] == pytest.approx([b / 255 for b in blake.hashes([b"zz"])[0].tolist()])
    pairs = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0, 5.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<float>, b array<float>").select(cosine("a", "b")).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(5 / (5**0.5 * 30**0.5)) and got[2] == 0 and got[3] is None


# -- graph ------------------------------------------------------------------


def plain_bfs(edges, center, depth, cap):
    """Breadth-first search with the same order of neighbours, one node at a time."""
    seen, met, queue = {center: 0}, [], deque([(center, 0)])
    while queue:
        if len(seen) >= cap:
            break
        node, d = queue.popleft()
        if d >= depth:
            continue
        around = sorted([(0, -s, b, (a, b, k)) for a, b, k, s in edges if a == node]) + sorted([(1, -s, a, (a, b, k)) for a, b, k, s in edges if b == node])
        for _, _, other, edge in around:
            met.append(edge)
            if other not in seen:
                seen[other] = d + 1
                queue.append((other, d + 1))
    return seen, Counter(met)


@pytest.mark.parametrize("seed", range(6))
def test_neighborhoods_against_plain_search(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 10)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("xy"), i) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame([*edges, (None, "n0", "x", 99), ("n1", None, "x", 98)], EDGES)
    depth, cap = rng.randrange(0, 4), rng.randrange(1, 9)
    got = graph.capped_neighborhood(df, "n0", depth, cap)
    seen, met = plain_bfs(edges, "n0", depth, cap)
    assert {r.id: r.depth for r in got.nodes.collect()} == seen
    assert Counter((r.src, r.dst, r.kind) for r in got.edges.collect()) == met
    got = graph.neighborhood(df, "n0", depth)
    seen, met = plain_bfs(edges, "n0", depth, 10**9)
    assert {r.id: r.depth for r in got.nodes.collect()} == seen
    assert Counter((r.src, r.dst, r.kind) for r in got.edges.collect()) == met


@pytest.fixture(scope="module")
def small(spark):
    symbols = [("1", "main", "function", "rust", "a.rs", 0), ("2", "process", "function", "rust", "a.rs", 1), ("3", "helper", "function", "python", "b.py", 2), ("4", "Process", "struct", "rust", "b.py", 3), ("5", None, "field", None, None, 4), (None, "ghost", "x", "y", "z", 5)]
    edges = [("1", "2", "calls", 1), ("2", "3", "calls", 2), ("1", "2", "uses", 3), ("1", "9", "calls", 4), (None, "2", "calls", 5), ("2", None, "calls", 6), ("4", "4", "calls", 7)]
    return spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES)


def test_lookups_and_edges(spark, small):
    symbols, edges = small
    of = spark.createDataFrame([("2",), ("2",), ("7",)], "id string")
    assert {r.id for r in graph.find(symbols, "PROC").collect()} == {"2", "4"}
    assert {r.id for r in graph.find(symbols, "process", exact=True, kind="struct").collect()} == {"4"}
    assert graph.find(symbols, "").where("name IS NULL").count() == 0
    assert sorted((r.other, r.edge_kind) for r in graph.linked(edges, symbols, of).collect()) == [("1", "calls"), ("1", "uses")]
    assert [r.edge_kind for r in graph.linked(edges, symbols, of, newest_kind=True).collect()] == ["uses", "uses"]
    assert [r.other for r in graph.linked(edges, symbols, of, incoming=False).collect()] == ["3"]
    assert graph.insert_edges(edges, symbols).count() == 4
    left, kept = graph.remove_files(symbols, edges, spark.createDataFrame([("a.rs",), (None,)], "file string"))
    assert {r.id for r in left.collect()} == {"3", "4", "5", None} and {r.seq for r in kept.collect()} == {7}
    assert [graph.resolve_name(symbols, x) for x in ("Process", "proc", "elp", "zzz")] == ["4", "2", "3", None]
    asked = spark.createDataFrame([("Process",), ("proc",), ("zzz",), ("",), (None,)], "name string")
    assert {(r.asked, r.id) for r in graph.resolve_names(symbols, asked).collect()} == {("Process", "4"), ("proc", "2")}
    text = graph.describe(graph.neighborhood(edges, "1", 1), symbols, "1")
    assert "main (function) a.rs [CENTER]" in text and "main --[calls]--> ?" in text and text.startswith("3 nodes, 3 edges")


def test_names_inside_names_resolve_as_one_by_one(spark, small):
    symbols, _ = small
    names = ["Process", "proc", "elp", "ELPER", "ss", "p", "rocx", "ocess", "zzz"]
    got = {r.asked: r.id for r in graph.resolve_names(symbols, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {"Process": "4", "proc": "2", "elp": "3", "ELPER": "3", "ss": "2", "p": "2", "ocess": "2"}
    assert got == {n: i for n in names if (i := graph.resolve_name(symbols, n))}


def test_resolution_against_plain_python(spark):
    rng = random.Random(4)
    symbols = [(str(i), rng.choice(["get", "Get", "run", None]), "f", "l", rng.choice(["a", "b", None]), rng.randrange(5)) for i in range(30)]
    refs = [(i, rng.choice(["1", "2", "77", None]), rng.choice(["GET", "run", "nope", "", None]), "calls", rng.choice(["a", "b", "c", None])) for i in range(80)]
    refs += refs[:9]
    got = graph.resolve_references(spark.createDataFrame(refs, "ref_seq long, src string, to_name string, kind string, file string"), spark.createDataFrame(symbols, SYMBOLS))
    want = set()
    for seq, src, to, kind, file in refs:
        hits = sorted((0 if s[4] is not None and s[4] == file else 1, s[5], s[0]) for s in symbols if s[1] and to and s[1].lower() == to.lower())
        if hits and src in {s[0] for s in symbols}:
            want.add((src, hits[0][2], kind, seq))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


# -- text, vectors, deltas -----------------------------------------------------


DOCS = [("1", "process_data in the main parser", "python"), ("2", "Config of the parser parser", "rust"), ("3", "data process", "go"), ("4", None, "go"), ("5", "", None), (None, "parser", "go")]


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("parser", ["2", "1"]), ("process_data", ["1"]), ("+parser -config", ["1"]), ("data AND process", ["1", "3"]), ("lang:go", ["3", "4"]), ("lang:[p TO z]", ["1", "2"]),
        ("(config OR main) AND parser", ["1", "2"]), ("NOT parser", []), ('"the parser"', ["2"]), ("missing", []), ("data NOT main", ["3"]), ('text:"data process"', ["3"]), ("config^5 parser", ["2", "1"]), ("", []), ("...", []),
    ],
)
def test_query_language(spark, query, ids):
    index = fulltext.build_index(spark.createDataFrame(DOCS, "id string, text string, lang string"), ["text"], ["lang"])
    got = [r.id for r in fulltext.search(index, query, 20, ["text"], ["lang"]).collect()]
    assert sorted(got) == sorted(ids)
    if query in ("parser", "config^5 parser"):
        assert got == ids


@pytest.mark.parametrize("query", ["(a", "a)", "nofield:a", "AND a", "a AND", "+", 'x:"'])
def test_query_errors(query):
    with pytest.raises(fulltext.QueryError):
        fulltext.parse_query(query, ["text"], ["lang"])


def test_remove_documents_and_symbol_fields(spark, small):
    symbols, _ = small
    index = fulltext.index_symbols(symbols.selectExpr("*", "concat_ws('::', file, name) AS fqname", "CAST(NULL AS string) AS signature"))
    assert {r.id for r in fulltext.search(index, "process").collect()} == {"2", "4"}
    assert {r.id for r in fulltext.search(index, "file:a.rs").collect()} == {"1", "2"}
    gone = fulltext.remove_documents(index, spark.createDataFrame([("2",)], "id string"))
    assert {r.id for r in fulltext.search(gone, "process").collect()} == {"4"}


def test_vector_search_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(4)]) for i in range(60)] + [(100, None), (101, [1.0]), (102, [0.0] * 4), (103, [float("nan")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    good = {i: v for i, v in rows if i is not None and i < 100 and norm(v) > 0}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 9)
    for block in (2000, 64):
        got = {}
        for r in vectors.search(df, df.where("id % 3 = 0"), 5, block=block).collect():
            got.setdefault(r.query, []).append((-r.score, r.id))
        for q, hits in got.items():
            want = sorted((-cos(good[q], v), i) for i, v in good.items() if i != q)[:5]
            assert [x[0] for x in sorted(hits)] == pytest.approx([x[0] for x in want])
        assert set(got) == {i for i in good if i % 3 == 0}
    assert [r.id for r in vectors.top_k(df.where("id < 100"), rows[0][1], 1).collect()] == [min(i for i in good if cos(good[i], rows[0][1]) == max(cos(v, rows[0][1]) for v in good.values()))]
    kept = vectors.upsert(df, spark.createDataFrame([(1, [2.0])], "id long, vec array<float>"))
    assert kept.where("id = 1").first().vec == [2.0]


def test_deltas(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), (None, "x"), ("d", "1"), ("d", "1")], "k string, s string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "0"), ("e", None), ("d", "1")], "k string, s string")
    assert {(r.k, r.change) for r in deltas.snapshot_diff(old, new, "k", "s").collect()} == {("b", "M"), ("c", "M"), ("e", "A")}
    assert {(r.k, r.change) for r in deltas.snapshot_diff(new, old, "k", "s").collect()} == {("b", "M"), ("c", "M"), ("e", "D")}
    assert deltas.snapshot_diff(old.limit(0), new.limit(0), "k", "s").count() == 0
    spans = spark.createDataFrame([("f", 0, 9000, "out", 1), ("f", 10, 20, "in", 2), ("f", 5, 5, "none", 0), (None, 0, 9, "x", 0)], "file string, start long, stop long, id string, ord long")
    sites = spark.createDataFrame([("f", 15, 1), ("f", 20, 2), ("f", 8999, 3), ("f", 9000, 4), ("g", 1, 5), ("f", None, 6)], "file string, at long, site long")
    assert {(r.site, r.owner) for r in deltas.attribute_sites(spans, sites).collect()} == {(1, "out"), (2, "out"), (3, "out")}
    assert {(r.site, r.owner) for r in deltas.attribute_sites(spans, sites, innermost=True).collect()} == {(1, "in"), (2, "out"), (3, "out")}


# -- every query with SQL ---------------------------------------------------------


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    import glob
    import os

    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NaT or v != v else round(float(v), 4) if hasattr(v, "__float__") and not isinstance(v, str | pd.Timestamp) else str(v)
    return Counter(tuple(map(cell, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for m in entry._modules() if "llm" not in m.__name__ for n in m.QUERIES))
def test_query(spark, database, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        want = database.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
