"""Functions and their documentation, on small sources of each language."""

import pytest

from symloom.llm import docpairs as dp

REAL = "Splits the tree at each quota and keeps the larger pieces."


@pytest.mark.parametrize(
    ("doc", "name", "real"),
    [
        (None, "f", False), ("", "f", False), (REAL, "f", True), ("/** " + REAL + " */", "f", True), (f"# {REAL}\n#\n# @param a the start", "f", True),
        ("@param one two three four five six seven", "f", False), (":param x: one two three four five six seven", "f", False),
        ("TODO: move this into the other file before the next release goes out.", "f", False),
        ("TODO: move this into the other\nfile before the next release goes out\nsome day soon.", "f", False),
        ("TODO: rename\n" + REAL, "f", True), ("FIXME(abc): breaks when the map is empty, see the other ticket", "f", False),
        ("Copyright (c) the Abc authors. You may share this file under the terms found next to it.", "f", False),
        ("SPDX-License-Identifier: X\n" + REAL, "f", True), ("clang-format off", "f", False),
        ("eslint-disable-next-line no-unused-vars, no-console, no-alert, no-eval, no-undef", "f", False),
        ("open(state, 33);\nmode = queue + 1;\nreturn 0;", "f", False), ("// if (a > b) {\n//     call(a, b, c, d, e);\n// }", "f", False),
        ("Splits the deep old tree here.", "splitDeepOldTree", False), ("This method will split deep old tree.", "split_deep_old_tree", False),
        ("tuples in, quotas out;\nnothing is kept between two runs.", "f", True), ("-----", "f", False),
        ("Liefert den Knoten zum Namen oder nichts davon.", "f", True), ("呼び出し元の一覧を返します。", "f", True), ("短い", "f", False),
        ("@brief " + REAL, "f", True), (REAL * 3000, "f", True),
    ],
)
def test_real(doc, name, real):
    assert dp.is_real(doc, name) is real


SOURCES = {
    "p/a.py": f'''import x

# {REAL}
@dec.orator(1, ")")
def one(a=")", b=(1, 2)) -> int:
    return 1

def two(self):
    """{REAL}"""
    note = "x"

# {REAL}

def far():
    "short"
    return """{REAL}"""

async def three():
    # a comment first
    r\'\'\'{REAL}\'\'\'

four = lambda x: x
''',
    "p/b.js": f'''const s = "// {REAL}";
function zero() {{}}
/**
 * {REAL}
 */
export const five = async (a, b) => {{ return a; }};
let six = 1; // {REAL}
function seven() {{}}
class A {{
    // {REAL}
    async eight() {{}}
}}
''',
    "p/c.rs": f'''/// {REAL}
#[inline(always)]
pub fn nine<'a>(x: &'a str) {{ let c = '"'; }}
/// {REAL}
pub struct S;
fn ten() {{ /* {REAL} */ }}
''',
    "p/d.go": f"package a\r\n\r\n// {REAL}\r\nfunc (s *S) eleven() {{\r\n}}\r\n\r\n/* broken {{{{\r\nfunc twelve() {{",
    "p/é.c": f"char *u = \"é\";\n/* {REAL} */\nstatic int thirteen(void) {{ return 0; }}\n",
}
DECLARED = {
    "one": ("p/a.py", "def one", "function", True), "two": ("p/a.py", "def two", "Method ", True), "far": ("p/a.py", "def far", "fn", False),
    "three": ("p/a.py", "async def three", "function", True), "four": ("p/a.py", "four =", "variable", False), "zero": ("p/b.js", "function zero", "function", False),
    "five": ("p/b.js", "export const five", "VARIABLE", True), "six": ("p/b.js", "let six", "variable", False), "seven": ("p/b.js", "function seven", "function", False),
    "eight": ("p/b.js", "async eight", "method", True), "nine": ("p/c.rs", "pub fn nine", "function", True), "S": ("p/c.rs", "pub struct", "struct", False),
    "ten": ("p/c.rs", "fn ten", "function", False), "eleven": ("p/d.go", "func (s", "method", True), "twelve": ("p/d.go", "func twelve", "function", False),
    "thirteen": ("p/é.c", "static int", "function", True),
}
SYMBOLS = "id string, kind string, name string, file string, start_byte long, end_byte long, signature string, doc string, indexed_at timestamp, holds int"


def tables(spark):
    rows = []
    for name, (file, text, kind, _) in DECLARED.items():
        at = SOURCES[file].encode().index(text.encode())
        rows.append((name, kind, name, file if name != "one" else ".\\p\\a.py", at, at + 40, None, None, None, 1))
    rows += rows[:4]
    rows.append(("own", "func", "own", "gone.py", 0, 1, None, REAL, None, 1))
    rows.append(("own", "func", "own", None, None, None, None, None, None, 1))
    rows.append(("var", "var", "var", "gone.js", 0, 1, "const v = (a) =>", REAL, None, 1))
    rows.append(("novar", "var", "novar", "gone.js", 0, 1, "let v = 1", REAL, None, 1))
    rows.append((None, "function", None, None, None, None, None, REAL, None, 1))
    files = [(f, t.encode(), 1) for f, t in SOURCES.items()] + [("p/none.py", None, 1), ("p/bad.py", b"\xff\xfe#\n", 1), (None, b"x", 1)]
    files += files[:2]
    return spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame(files, "file string, content binary, doc int")


def test_found_and_pairs(spark):
    symbols, files = tables(spark)
    want = {n for n, d in DECLARED.items() if d[3]} | {"own", "var"}
    got = [r.id for r in dp.documented_functions(symbols, files).collect()]
    assert sorted(got) == sorted(want)
    pairs = {r.id: r for r in dp.function_pairs(symbols, files).collect()}
    assert set(pairs) == want
    assert pairs["two"].code.startswith("def two(self):") and pairs["two"].description == REAL and pairs["two"].signature == "def two(self):"
    assert pairs["own"].code is None and pairs["own"].description == REAL
    assert dp.documented_functions(symbols.limit(0), files).count() == 0
    assert sorted(r.id for r in dp.documented_functions(symbols, files.limit(0)).collect()) == ["own", "var"]


PLACES = {
    "a.py": ("@dec(1)\n@other\nasync def one(a: str = ')',\n              b=(1, 2)) -> dict[str, int]:\n    \"\"\"doc\"\"\"\n    x = \'\'\'\nnot out\'\'\'\n\n    return x\n\ndef two(): return 1\n",
             [("one", "async def one(a: str = ')', b=(1, 2)) -> dict[str, int]:", "return x"), ("two", "def two():", "return 1")]),
    "b.ts": ("export default async function one<T>(a: {b: number},\n  c = '}'): Promise<T> {\n  return f(a);\n}\nexport const two = async (a) => { g(a); };\nclass A {\n  private get three(): {x: number} { return {x: 1}; }\n}\nif (a) { b(); }\nconst four = x =>\n  x + 1;\n",
             [("one", "export default async function one<T>(a: {b: number}, c = '}'): Promise<T>", "}"), ("two", "export const two = async (a) =>", "}"), ("three", "private get three(): {x: number}", "return {x: 1}; }"), ("four", "const four = x =>", "x + 1;")]),
    "c.go": ("func (s *S[T]) one(\n\ta int,\n) (int, error) {\n\treturn 1, nil // }\n}\nvar two = func(a int) { g() }\n", [("one", "func (s *S[T]) one( a int, ) (int, error)", "}"), ("two", "var two = func(a int)", "}")]),
    "d.rs": ("#[inline]\npub(crate) unsafe fn one<'a, F: Fn(u8) -> u8>(x: &'a [u8; 2]) -> Vec<u8>\nwhere F: Copy {\n    '{'; }\nfn two();\n", [("one", "pub(crate) unsafe fn one<'a, F: Fn(u8) -> u8>(x: &'a [u8; 2]) -> Vec<u8> where F: Copy", "'{'; }")]),
    "e.c": ("/* int none(void) { } */\nstatic inline const char *one(int a[3],\n    void (*f)(int)) { return \"}\"; }\nint two(void);\nint x = call(3);\n", [("one", "static inline const char *one(int a[3], void (*f)(int))", "}")]),
}


@pytest.mark.parametrize("file", list(PLACES))
def test_declarations(file):
    source, want = PLACES[file]
    text = source.encode().decode("latin-1")
    found = [d for d, _ in dp.functions_in(source.encode(), dp._language(file))]
    assert [(d.name, dp.signature_of(text, d)) for d in found] == [(n, s) for n, s, _ in want]
    for d, (_, _, end) in zip(found, want, strict=True):
        assert text[d.start : d.end].rstrip().endswith(end)


def test_source_pairs(spark):
    _, files = tables(spark)
    got = {r.name: r for r in dp.source_pairs(files).collect()}
    assert set(got) == {"one", "two", "three", "five", "eight", "nine", "eleven", "thirteen"}
    assert got["nine"].signature == "pub fn nine<'a>(x: &'a str)" and got["nine"].code.endswith("}") and got["nine"].description == REAL
    assert dp.source_pairs(files.limit(0)).count() == 0


def test_pairs_of_any_bytes_and_the_newest_row(spark):
    source = b"# " + REAL.encode() + b"\ndef f(new,\n      other):\n    return '\xff'\n"
    rows = [("f", "f", 65, 200, "def f(zold)", None, 1), ("f", "f", source.index(b"def"), len(source), None, None, 2), ("g", "f", source.index(b"def"), None, None, "z " + REAL, 1), ("g", "f", None, None, "newer", REAL, 3)]
    df = spark.createDataFrame([(i, "function", n, "p/a.py", a, b, s, d, t) for i, n, a, b, s, d, t in rows], "id string, kind string, name string, file string, start_byte long, end_byte long, signature string, doc string, day int")
    symbols = df.selectExpr("*", "timestamp_seconds(day) AS indexed_at")
    files = spark.createDataFrame([("p/a.py", source, 2), ("p/a.py", b"old", 1), ("p/a.py", source, 2)], "file string, content binary, t int").selectExpr("file", "content", "timestamp_seconds(t) AS mtime")
    got = {r.id: r for r in dp.function_pairs(symbols, files).collect()}
    assert got["f"].signature == "def f(new, other):" and got["f"].code.endswith("return '\ufffd'\n") and got["f"].description == REAL
    assert got["g"].signature == "def f(new, other):" and got["g"].code.endswith("return '\ufffd'") and got["g"].description == REAL
