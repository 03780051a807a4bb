"""Positions, choice of files, names within names, edges given by plug-ins."""

from pyspark.sql import functions as F

from symloom.operators import graph
from symloom.plans import index as indexing

def test_positions_are_stable(spark):
    files = spark.range(20_000).select(F.concat(F.lit("p/"), F.sha2(F.col("id").cast("string"), 256)).alias("file"))
    files = files.union(files.limit(50)).union(spark.createDataFrame([(None,)], "file string"))
    runs = [indexing.with_positions(files, 7).distinct().orderBy("file").select("pos").collect() for _ in range(2)]
    assert runs[0] == runs[1]
    assert [r.pos for r in runs[0]] == list(range(7, 20_007))
    assert indexing.with_positions(files.limit(0)).count() == 0


def test_newest_files(spark):
    rows = [("a", b"1", "h1", 5), ("a", b"2", "h2", 6), ("a", b"3", "h3", None), ("b", b"4", "h4", None), ("b", b"5", "h5", None), (None, b"6", "h6", 1), ("a", b"2", "h2", 6)]
    got = indexing.newest_files(spark.createDataFrame(rows, "file string, content binary, content_hash string, mtime int"))
    assert {(r.file, bytes(r.content)) for r in got.collect()} == {("a", b"2"), ("b", b"5")}
    assert got.count() == 2
    assert indexing.newest_files(got.limit(0)).count() == 0


def test_names_within_names(spark):
    symbols = spark.createDataFrame([("1", "my_parse_all", 3), ("2", "my_parse", 2), ("3", "parser", 1), ("4", None, 0), ("5", "\u00e9t\u00e9", 9)], "id string, name string, ord int")
    asked = spark.createDataFrame([("PARSE_",), ("y_p",), ("pars",), ("my_parse",), ("nothing",), ("",), (None,), ("T\u00c9",), ("e",)], "name string")
    got = {r.asked: r.id for r in graph.resolve_names(symbols, asked).collect()}
    assert got == {"PARSE_": "1", "y_p": "2", "pars": "3", "my_parse": "2", "T\u00c9": "5", "e": "3"}
    assert got == {n: graph.resolve_name(symbols, n) for n in got}


def test_edges_with_known_ends(spark):
    symbols = spark.createDataFrame([("1", "a", "f", 1), ("2", "b", "f", 2)], "id string, name string, file string, ord int")
    rows = [("1", "b", "calls", "f", 5, None), ("1", None, "calls", "f", 9, "2"), ("1", None, "calls", "f", 8, "2"), ("1", "b", "uses", "f", 7, "3"), ("3", None, "calls", "f", 6, "2")]
    refs = spark.createDataFrame(rows, "src string, to_name string, kind string, file string, ord int, dst string")
    assert sorted(map(tuple, indexing.resolve(refs, symbols).collect())) == [("1", "2", "calls", 5), ("1", "2", "calls", 9)]
    assert indexing.resolve(refs.limit(0), symbols).count() == 0
