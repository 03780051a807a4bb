"""Extraction per language, on sources written for these tests."""

import pytest

from symloom.extract import model
from symloom.extract.rules import LanguageError, Registry, extract, parse_language
from symloom.extract.tables import PluginRegistry, RegexEdges, extracted, references_of, register_udtf, symbols_of

REGISTRY = Registry.load()

PYTHON = '''import os
from a.b import c

LIMIT: int = 3

# Keeps colours.
class Color(Enum):
    RED = 1

    @property
    def shade(self):
        return blend(self.value)

    class Inner:
        async def run(self, *args, **kw): ...

@decorate(x=1)
def outer(n):
    if (m := n):
        pass
    def nested():
        return os.path.join("def fake(): pass", n)
    return nested()
'''
RUST = '''//! Crate notes.
use std::collections::HashMap;

/// A point.
pub struct Point<T> where T: Copy {
    pub x: T,
    y: HashMap<String, T>,
}
struct Unit;
pub(crate) enum Shape { Round { r: f64 }, Flat(u8), Empty }
pub trait Draw { type Out; fn draw(&self) -> u8 { paint(1) } }
impl Draw for Unit { fn draw(&self) -> u8 { let s = "fn not_me() {"; helper::go(s) } }
impl<T> Point<T> { pub async unsafe fn deep(&self) { println!("{}", 'x'); } }
mod inner { pub fn low() {} }
macro_rules! square { ($x:expr) => { $x * $x }; }
pub const MAX: usize = 10;
static mut COUNT: u32 = 0;
type Alias = Vec<u8>;
pub fn lifetimes<'a>(a: &'a str) -> &'a str { a }
'''
GO = '''package main

import "fmt"
import (
	io "os/io"
	"strings"
)

// Base is the base.
type Base struct {
	ID   int `json:"id"`
	Name string
}

type (
	Reader interface { Read(p []byte) (n int, err error) }
	Fn func(int) error
)

const (
	A = iota
	B
)
var total, other = 1, 2

func Max[T any](a, b T) T { return pick(a, b) }

func (s *Stack) Push(v int) (err error) {
	defer func() { recover() }()
	fmt.Println("func fake() {")
	return nil
}
'''
C = '''#include <stdio.h>
#include "own.h"
#define SIZE 10
#define MAX(a, b) \\
    ((a) > (b) ? (a) : (b))
typedef struct node { int value; struct node *next; unsigned flag : 1; } node_t;
typedef int (*handler)(int);
enum color { RED, GREEN = 2 };
union any { int i; float f; };
static int counter = 0;
/* Adds. */
static inline int add(int a, int b)
{
    return call_me(a) + obj->method(b);
}
char *name_of(struct node *n) { return "int fake(void) {"; }
int declared(int a);
'''
JS = '''import x from "mod";
const fs = require('fs');
// Makes ids.
export function* ids(limit) { yield next(limit); }
export default class Cache extends Map {
    #size = 0;
    static of(a) { return new Cache(a); }
    async load(key) { return this.fetch(`function fake() {${key}}`); }
}
const pipe = (...fns) => fns.map(f => f(1));
const obj = {
    go: function () { return run(); },
    n: 1,
};
async function later() { await import("y"); }
'''
TS = '''import { A } from './a';
export interface Entity<T> { id: string; get(): T }
type DeepPartial<T> = { [K in keyof T]?: DeepPartial<T[K]> };
export const enum Flags { None = 0, All = 1 }
abstract class Store<T> {
    private items: T[] = [];
    readonly size?: number;
    constructor(private x: number) { super(); }
    abstract save(item: T): void;
    public async load<U>(id: string): Promise<U> { return parse<U>(id); }
}
namespace Util { export function isEmail(s: string): boolean { return s.includes("@"); } }
export const merge = (a: number, b: number): number => add(a, b);
export const View = ({ title }: Props) => <h1>{title}</h1>;
'''
WANT = {
    "m.py": (PYTHON, {"Color": "class", "Inner": "class", "shade": "function", "run": "function", "outer": "function", "nested": "function", "LIMIT": "variable", "RED": "variable"}, {"blend", "join", "nested", "decorate"}, {"os", "a.b"}),
    "m.rs": (RUST, {"Point": "struct", "Unit": "struct", "x": "field", "y": "field", "Shape": "enum", "Round": "enum_variant", "Empty": "enum_variant", "Draw": "trait", "draw": "function", "deep": "function", "inner": "module", "low": "function", "square": "macro", "MAX": "constant", "COUNT": "static", "Alias": "type_alias", "lifetimes": "function"}, {"paint", "go", "println"}, {"std::collections::HashMap"}),
    "m.go": (GO, {"Base": "type", "ID": "field", "Name": "field", "Reader": "type", "Fn": "type", "A": "constant", "B": "constant", "total": "variable", "Max": "function", "Push": "function"}, {"pick", "Println", "recover"}, {'"fmt"', '"os/io"', '"strings"'}),
    "m.c": (C, {"SIZE": "macro", "MAX": "macro", "node": "struct", "value": "field", "flag": "field", "node_t": "type_alias", "handler": "type_alias", "color": "enum", "GREEN": "enum_variant", "any": "union", "counter": "definition", "add": "function", "name_of": "function"}, {"call_me", "method"}, {"<stdio.h>", '"own.h"'}),
    "m.js": (JS, {"ids": "function", "Cache": "class", "#size": "field", "of": "function", "load": "function", "pipe": "variable", "go": "definition", "later": "function", "fs": "variable"}, {"next", "fetch", "map", "run", "require"}, {'"mod"', "'fs'"}),
    "m.tsx": (TS, {"Entity": "interface", "DeepPartial": "type_alias", "Flags": "enum", "All": "enum_variant", "Store": "class", "items": "field", "size": "field", "save": "function", "load": "function", "Util": "module", "isEmail": "function", "merge": "variable", "View": "variable"}, {"parse", "includes", "add"}, {"'./a'"}),
}


@pytest.mark.parametrize("file", WANT)
def test_language(file):
    text, symbols, calls, imports = WANT[file]
    lang = REGISTRY.for_file(file)
    got = extract(f"src/{file}", text.encode(), lang)
    kinds = {}
    for s in got.symbols:
        kinds.setdefault(s.name, set()).add(s.kind)
        assert s.name and s.lang == lang.id and s.fqname.startswith(f"src/{file}::") and s.end_byte > s.start_byte and s.end_line >= s.start_line
        assert s.name in text.encode()[s.start_byte : s.end_byte].decode() and text.encode()[: s.start_byte].count(b"\n") == s.start_line
    assert {n for n, k in symbols.items() if k not in kinds.get(n, ())} == set()
    assert not {n for n in kinds if "fake" in n or n in ("not_me", "declared")}
    assert calls - {r.to_name for r in got.references if r.kind == "calls"} == set()
    assert {r.to_name for r in got.references if r.kind == "imports"} == imports


def symbol(file, name, **kw):
    return next(s for s in extract(file, WANT[file][0].encode(), REGISTRY.for_file(file), **kw).symbols if s.name == name and s.kind != "decorated")


def test_names_signatures_docs_and_owners():
    assert symbol("m.py", "shade").fqname == "m.py::Color::shade::shade"
    assert symbol("m.py", "shade", clean_names=True).fqname == "m.py::Color::shade"
    assert symbol("m.rs", "low").fqname == "m.rs::inner::low::low"
    assert symbol("m.rs", "deep").fqname == "m.rs::deep::deep"
    assert symbol("m.go", "Push").fqname == "m.go::Push"
    assert symbol("m.js", "load").fqname == "m.js::Cache::load"
    assert symbol("m.py", "Color").signature == "class Color(Enum):"
    assert symbol("m.c", "add").signature == "static inline int add(int a, int b)"
    assert symbol("m.c", "add").doc == "/* Adds."
    assert symbol("m.rs", "Point").doc == "A point."
    assert symbol("m.py", "Color").doc == "Keeps colours."
    assert symbol("m.go", "Base").doc == "Base is the base."
    assert model.signature("f(a: int) -> b:\n  x") == "f(a: int) -> b:" and model.signature("x: int = 5") == "x:" and model.signature(":a") == ":a"
    assert model.kind_of("export_statement") == "definition" and model.kind_of("trait_item") == "trait"
    outer = extract("m.py", PYTHON.encode(), REGISTRY.for_file("m.py"))
    inner = extract("m.py", PYTHON.encode(), REGISTRY.for_file("m.py"), innermost=True)
    owner = lambda x, name: x.symbols[next(r.owner for r in x.references if r.to_name == name)].name
    assert owner(outer, "blend") == "Color" and owner(inner, "blend") == "shade"


@pytest.mark.parametrize("data", [b"", b"\xff\xfe\x00", b"def broken(:\n  x = (", "def größe(ä):\n    return naïve(ä)\n".encode(), b"class A:\r\n    def m(self):\r\n        pass\r\n", b"{" * 50, b"import only\n", b"x = 1\n" * 30000, "\x0c\ndef f(): pass\x0c\n".encode()])
def test_any_bytes(data):
    for ext in ("py", "rs", "go", "c", "js", "ts"):
        extract(f"a.{ext}", data, REGISTRY.for_file(f"a.{ext}"))
    got = extract("a.py", data, REGISTRY.for_file("a.py"))
    for s in got.symbols:
        assert 0 <= s.start_byte < s.end_byte <= len(data)
    if b"broken" in data:
        assert [s.name for s in got.symbols][:1] == ["broken"]
    if b"only" in data:
        assert not got.references


def test_rule_files():
    for bad in ("id = 'x'", "id='x'\nextensions=['x']\ncalls=['(']", "not toml", "id='x'\nextensions=['x']\nfamily='none'", "id='x'\nextensions=['x']\n[[symbol]]\nnode='a'\nmatch='b'\nwrong=1"):
        with pytest.raises(LanguageError):
            parse_language(bad)
    own = parse_language("id='ini'\nextensions=['ini']\nfamily='hash'\n[[symbol]]\nnode='module'\nmatch='^(?P<def>\\[(?P<name>\\w+)\\])'\nends='line'")
    assert [(s.name, s.kind) for s in extract("a.ini", b"# c\n[one]\nx=1\n[two]\n", own).symbols] == [("one", "module"), ("two", "module")]
    registry = Registry.load()
    registry.register(own)
    assert registry.for_file("dir/a.INI").id == "ini" and registry.for_file(".ini") is None and registry.for_file("none") is None
    assert set(registry.languages) == {"c", "go", "javascript", "python", "rust", "typescript", "ini"}


def test_tables_plugins_and_udtf(spark):
    files = spark.createDataFrame([(f, WANT[f][0].encode(), i) for i, f in enumerate(WANT)] + [("none.py", None, 9), ("x.zzz", b"a", 9), (None, b"a", 9), ("dup.c", b"void f(void) {\n}\nvoid f(void) {\n}\n", 7)], "file string, content binary, pos long")
    done = extracted(files, REGISTRY).cache()
    assert {r.file: r.status for r in done.where("status <> 'ok'").collect()} == {"none.py": "unreadable", "x.zzz": "no_language"}
    symbols = symbols_of(done)
    assert symbols.count() == symbols.select("id").distinct().count()
    assert [r.start_byte for r in symbols.where("file = 'dup.c'").collect()] == [17]
    refs = references_of(done)
    assert refs.join(symbols, refs.src == symbols.id, "left_anti").count() == 0
    register_udtf(spark, REGISTRY)
    files.createOrReplaceTempView("some_files")
    assert spark.sql("SELECT name FROM some_files, LATERAL extract_symbols(file, content) WHERE file = 'm.go' AND kind = 'type'").count() == 3
    plugins = PluginRegistry()
    assert plugins.apply(files, symbols) is None
    plugins.register(RegexEdges("ext", r"class (\w+) extends (\w+)", "inherits"))
    plugins.register(RegexEdges("opt", r"func (\w+)\[(x)?", "opts"))
    assert plugins.names() == ["ext", "opt"]
    assert [(r.to_name, r.kind, r.file) for r in plugins.apply(files, symbols).collect()] == [("Map", "inherits", "m.js")]
    with pytest.raises(ValueError, match="no such group"):
        RegexEdges("bad", "a(b)", "k")


def test_finds_the_indexed_symbols(spark):
    """Against the symbols of the test tables: name and place of what is a
    function, method, class, struct, constant, macro or variable."""
    sf = "/root/testdata/sf0.01"
    files = spark.read.parquet(f"{sf}/source_files.parquet").where("status = 'ok'").dropDuplicates(["file"])
    names = symbols_of(extracted(files, REGISTRY)).select("file", "name").distinct()
    known = spark.read.parquet(f"{sf}/symbols.parquet").selectExpr("regexp_replace(replace(file, '\\\\', '/'), '^\\\\./', '') AS file", "lower(trim(kind)) AS kind", "name")
    plain = files.where("NOT contains(CAST(content AS STRING), '/***/')").where("length(content) < 60 * regexp_count(CAST(content AS STRING), '\\n')").select("file")
    known = known.where("kind IN ('function', 'method', 'class', 'struct', 'macro', 'variable')").join(plain, "file").distinct()
    assert known.count() > 1000
    assert known.join(names, ["file", "name"], "left_anti").count() <= 0.01 * known.count()
