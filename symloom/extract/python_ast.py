"""Python files through the standard parser; by rules where it refuses them."""

from __future__ import annotations

import ast
import warnings

from symloom.extract.lexing import Source
from symloom.extract.model import Found


def read(data: bytes, lang):
    """Source, symbols in order of their names, call and import sites."""
    from symloom.extract.rules import _scan, _sites

    src = Source(data, lang.family)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return src, _scan(src, lang), _sites(src, lang.calls, False), _sites(src, lang.imports, True)
    starts = [0]
    for line in data.splitlines(keepends=True) if b"\x0c" not in data and b"\x0b" not in data else _lines(data):
        starts.append(starts[-1] + len(line))

    def offset(line: int, column: int) -> int:
        return min(starts[line - 1] + column, len(data))

    def span(node: ast.AST) -> tuple[int, int]:
        return offset(node.lineno, node.col_offset), offset(node.end_lineno, node.end_col_offset)

    found: list[tuple[int, Found]] = []
    calls: list[tuple[int, str]] = []
    imports: list[tuple[int, str]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            a, b = span(node)
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            at = src.text.find(node.name, a)
            if node.decorator_list:
                first = min(span(d)[0] for d in node.decorator_list)
                begin = src.text.rfind("@", 0, first)
                found.append((at, Found(node.name, "decorated_definition", begin, b, False)))
            found.append((at, Found(node.name, kind, a, b)))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            found += [(span(t)[0], Found(t.id, "assignment", *span(node))) for t in targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                calls.append((span(node.func)[0], node.func.id))
            elif isinstance(node.func, ast.Attribute):
                calls.append((span(node.func)[1] - len(node.func.attr.encode()), node.func.attr))
        elif isinstance(node, ast.Import):
            imports += [(span(a)[0], a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.append((span(node)[0], node.module))
    found.sort(key=lambda x: (x[0], x[1].start))
    return src, [f for _, f in found], sorted(calls), sorted(imports)


def _lines(data: bytes) -> list[bytes]:
    """Lines as the parser counts them: only line feeds and carriage returns end one."""
    out, at = [], 0
    text = data.replace(b"\r\n", b"\n\n")  # keeps the length; the pair is mended below
    while at < len(data):
        end = text.find(b"\n", at)
        if end < 0:
            end = len(data) - 1
        if data[end : end + 2] == b"\r\n":
            end += 1
        out.append(data[at : end + 1])
        at = end + 1
    return out
