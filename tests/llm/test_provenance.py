"""Files that nobody wrote by hand, on a small repository of each kind."""

from symloom.llm import provenance as pv

CODE = "import { a } from 'b';\n\nexport function loadThing(limit) {\n    return helper(limit);\n}\n"
MINI = "".join(f"function {a}{b}({a},{b}){{return {a}?{b}.x({a}):{i}}}" for i, (a, b) in enumerate(zip("abcdefghij" * 2, "klmnopqrst" * 2)))
DATA = "package x\n\nvar t = [\n" + "".join("  " + ", ".join(f"0x{i:02x}" for i in range(12)) + ",\n" for _ in range(20)) + "]\n"


def f(s):
    return s.encode()


FILES = [
    ("p/src/plain.js", f(CODE), None),
    ("p/src/tool.js", f("// Code generated by abc from x.tpl. DO NOT EDIT.\n" + CODE), "tool"),
    ("p/src/tool2.py", f("#!/usr/bin/env python\n# Copyright (c) the x authors.\n\n# @generated by q 1.2.3\nimport a\n"), "tool"),
    ("p/src/block.rs", f("/* Diese Datei wurde automatisch erzeugt (q 1.0), nicht von Hand ändern. */\r\nfn a() {}\r\n"), "tool"),
    ("p/src/copy.go", f("// Forked from abc at 0123abcd to have it in our tree.\npackage a\nfunc f() {}\n"), "origin"),
    ("p/src/copy2.py", b"# Snapshot of abc taken at 8c8e876c85; do not send changes here but to its authors.\nx = load(1)\n", "origin"),
    ("p/src/copy3.py", b"# abc 1.6.8 -- embedded library, excluded from our style checks\nx = load(1)\n", "origin"),
    ("p/src/copy4.py", b"# Origin: abc 2.9.7, unchanged. Please report problems to the abc project.\nx = load(1)\n", "origin"),
    ("p/src/end.c", b"int f(void) {\n    return 1;\n}\n\n// AUTO-GENERATED FILE -- run `x emit y` again instead of changing it\n\n// na\xefve\n", "tool"),
    ("p/src/inner.c", b"int f(void) {\n    // Code generated by x from y. DO NOT EDIT.\n    return 1;\n}\n", None),
    ("p/src/string.js", f("const HEAD = 'Code generated by abc. DO NOT EDIT.';\n" + CODE), None),
    ("p/src/speaks.js", f("// Decides which vendor folders and minified bundles the scan leaves out.\n" + CODE), None),
    ("p/src/was.js", f("// Used to be auto-generated; maintained by hand since.\n" + CODE), None),
    ("p/src/licence.js", f("// Copyright (c) the abc authors.\n" + CODE), None),
    ("p/src/mini.js", f(MINI), "minified"),
    ("p/src/bundle.js", f("(()=>{var m={\n/***/ 10:(m,e,req)=>{},\n}})()"), "minified"),
    ("p/src/data.go", f(DATA), "data"),
    ("p/src/words.go", f("package x\n\nvar known = []string{" + '"word", ' * 60 + "}\n\nfunc has(w string) bool {\n\treturn find(known, w)\n}\n"), None),
    ("p/src/api.pb.go", f("package a\n\nfunc getA() int {\n\treturn 1\n}\n"), "pattern"),
    ("p/src/api_pb2.py", b"import a\n\n\ndef get_a():\n    return 1\n", "pattern"),
    ("p/src/code_generator.py", b"import a\n\n\ndef get_a():\n    return 1\n", None),
    ("p/src/gen_rules.py", b"import a\n\n\ndef get_a():\n    return 1\n", None),
    ("p/vendor/abc-1.2.3/x/a.js", f(CODE), "pattern"),
    ("q/vendor/abc/x/b.js", f("// Copyright (c) the Abc authors.\n" + CODE), "pattern"),
    ("q/lib/vendor/def/c.js", f(CODE), "pattern"),
    ("q/lib/vendor/def/null.js", None, "pattern"),
    ("q/src/vendors_api/d.js", f(CODE), None),
    ("q/src/empty.js", b"", None),
    ("q/src/broken.js", b"\xff\xfe\x00 {{{ (", None),
    ("q/src/long.c", f("int f(void) {\n    return 1;\n}\n" * 20000), None),
]
CONFIGS = "project string, exclude array<string>"


def run(spark, files, configs=(("p", ["**/vendor/**", "**/src/*", "*.{js", ""]), ("q", None))):
    df = spark.createDataFrame([(a, b, 1) for a, b in files], "file string, content binary, reason int")
    return {r.file: r.reason for r in pv.foreign_files(df, spark.createDataFrame(list(configs), CONFIGS)).collect()}


def test_kinds(spark):
    files = [(a, b) for a, b, _ in FILES]
    assert run(spark, [*files, *files[:5], (None, b"x")]) == {a: r for a, _, r in FILES if r}
    assert run(spark, []) == {}
    assert run(spark, files[:1], []) == {}


def test_attribute_files_and_precedence(spark):
    files = [
        ("r/.gitattributes", f("# marks\n*.js linguist-generated\nlib/** linguist-vendored=true\nlib/own/* -linguist-vendored\n")),
        ("r/sub/.gitattributes", f("a.js linguist-generated=false\nbad[ linguist-generated\n")),
        ("r/a.js", f(CODE)), ("r/sub/a.js", f(CODE)), ("r/sub/b.js", f(CODE)), ("r/lib/x/y.c", b"int a;"), ("r/lib/own/y.c", b"int a;"), ("s/a.js", f(CODE)),
    ]
    assert run(spark, files) == {"r/a.js": "declared", "r/sub/b.js": "declared", "r/lib/x/y.c": "declared"}


def test_attribute_file_at_the_top(spark):
    files = [
        (".gitattributes", f("# marks\n*.js linguist-generated\n/lib/** linguist-vendored\n")), ("r/.gitattributes", f("own.js -linguist-generated\n")),
        ("a.js", f(CODE)), ("r/b.js", f(CODE)), ("r/own.js", f(CODE)), ("lib/x/y.c", b"int a;"), ("r/lib/y.c", b"int a;"),
    ]
    assert run(spark, files) == {"a.js": "declared", "r/b.js": "declared", "lib/x/y.c": "declared"}


def test_attribute_details(spark):
    lines = [
        "[attr]foreign linguist-vendored -text", "lib/* linguist-vendored", "*.gen.c linguist-generated", "*.gen.c -linguist-vendored", '"a b/\\"x.js" linguist-generated',
        "out/ linguist-generated", "ext/** foreign", "ext/own.js -linguist-vendored", "both.js linguist-generated linguist-vendored", "both.js -linguist-generated", "sub/s.js linguist-generated",
    ]
    files = [
        ("r/.gitattributes", f("\n".join(lines))), ("r/sub/.gitattributes", f("t.js foreign\ns.js !linguist-generated\nv.js -foreign\n")), ("r/lib/a.py", b"x"), ("r/lib/deep/y.py", b"x"), ("r/lib/k.gen.c", b"x"), ("r/k.gen.c", b"x"),
        ('r/a b/"x.js', b"x"), ("r/out/z.py", b"x"), ("r/ext/d/e.js", b"x"), ("r/ext/own.js", b"x"), ("r/both.js", b"x"), ("r/sub/t.js", b"x"), ("r/sub/s.js", b"x"), ("r/sub/v.js", b"x"), ("s/t.js", b"x"),
    ]
    assert set(run(spark, files)) == {"r/lib/a.py", "r/k.gen.c", "r/lib/k.gen.c", 'r/a b/"x.js', "r/ext/d/e.js", "r/both.js", "r/sub/t.js"}


def test_mined_wording(spark):
    head = "// This unit comes straight out of the schema press, look there first ({0}).\n"
    known = [(f"p{i % 4}/src/a{i}.pb.go", f(head.format(i) + CODE)) for i in range(12)]
    plain = [(f"p{i % 4}/src/b{i}.js", f(CODE)) for i in range(12)]
    asked = [("q/src/c.js", f(head.format("x") + CODE)), ("q/src/d.js", f("// Written by hand. This unit comes straight out of the schema press.\n" + CODE))]
    got = run(spark, known + plain + asked)
    assert got == {a: "pattern" for a, _ in known} | {"q/src/c.js": "notice"}
    assert run(spark, known[:9] + plain + asked) == {a: "pattern" for a, _ in known[:9]}


def test_newest_content_counts(spark):
    rows = [("p/a.js", f(CODE), 2), ("p/a.js", f("// @generated\n"), 1), ("p/b.js", f("// @generated\n"), 2), ("p/b.js", f(CODE), None)]
    df = spark.createDataFrame(rows, "file string, content binary, m int").selectExpr("file", "content", "timestamp_seconds(m) AS mtime")
    assert [r.file for r in pv.foreign_files(df, spark.createDataFrame([], CONFIGS)).collect()] == ["p/b.js"]


def test_globs():
    def hit(pattern, path, base=""):
        found = pv.glob_regex(pattern, base)
        return bool(found and found.fullmatch(path))

    assert hit("*.min.js", "a/b/x.min.js") and not hit("*.min.js", "a/x.js")
    assert hit("**/gen/**", "a/b/gen/c/d") and hit("gen", "a/gen/b") and not hit("/gen", "a/gen/b")
    assert hit("a/*.c", "r/a/x.c", "r") and not hit("a/*.c", "r/a/b/x.c", "r")
    assert hit("x[0-9].{c,h}", "q/x7.h") and not hit("x?.c", "x/.c")
    assert pv.glob_regex("*.{js") is None and pv.glob_regex("a[") is None and pv.glob_regex(" ") is None
