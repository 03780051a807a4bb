"""Functions paired with the documentation written for them.

Source text is read with an island grammar per language: comments, strings,
annotations, declarations with their parameters and balanced (or indented)
bodies are recognised, everything else is water and skipped. Islands carry
byte offsets and meet the symbols of the index by file and offset, so no file
is parsed as a whole and broken syntax costs only the island it is in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions.keys import clean_kind
from symloom.plans.tables import spread

#: Words of prose that make a documentation real.
MIN_WORDS = 6

# Spellings of the kinds, licence wording, marks of task notes,
# directives to tools, and tags that introduce prose rather than a parameter.
FUNCTION_KINDS = ["function", "func", "fun", "fn", "method", "meth"]
VARIABLE_KINDS = ["variable", "var"]
LICENCE = r"copyright|\(c\)\s+the|licen[sc]ed?\b|\bspdx\b|all rights reserved|under the terms|by the terms|permission is hereby|without warrant|redistribut"
TASKS = r"(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b"
DIRECTIVES = r"(?:pragma\b|clang-format\b|clang-tidy\b|type:\s*ignore|noqa\b|nolint\b|NOLINT\w*|eslint-|tslint:|jshint\b|jslint\b|prettier-ignore|pylint:|mypy:|flake8:|fmt:\s*(?:on|off|skip)|isort:|yapf:|ruff:|pyright:|coverage:|istanbul\b|c8 ignore|@ts-|@flow\b|@jsx\b|go:\w+|\+build\b|rustfmt::|clippy::|cspell:|spell-checker:|#?(?:end)?region\b|-\*-|vi[m]?:|sourceMappingURL|webpack\w+:|biome-ignore|deno-lint|swiftlint:|cppcheck-|coverity\b|IWYU\b|NOSONAR)"
PROSE_TAGS = ["brief", "summary", "description", "desc", "details", "remarks", "note", "deprecated", "overview", "fileoverview"]

_LICENCE, _TASK, _DIRECTIVE = re.compile(LICENCE, re.I), re.compile(TASKS), re.compile(DIRECTIVES, re.I)
_MARKS = re.compile(r"^(?:///?|//!|/\*+!?|\*+/|\*+(?=\s|$)|#+!?(?=\s|$)|#+(?=\w)|--+\s|;+\s|[rRuUbBfF]{0,2}(?:\"\"\"|'''))\s*")
_ENDS = re.compile(r"\s*(?:\*+/|\"\"\"|''')$")
_TAG = re.compile(r"^(?:[@\\](\w+)|:(?:param|parameter|arg|returns?|rtype|type|raises?|throws|yields?)\b[^:]*:|(?:Args|Arguments|Parameters|Params|Returns|Raises|Throws|Yields|Attributes|Examples?)\s*:\s*$)")
_CODE = re.compile(
    r"""^(?:[\w.:>\[\]*&-]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{]?  # a call
      |(?:(?:let|const|var|int|auto|final|static|mut)\s+)?[\w.\[\]]+(?:\s*:\s*\w+)?\s*(?:[-+*/|&^%]|<<|>>)?:?=(?!=)\s*\S.*  # an assignment
      |return\b[^.]*;?|(?:if|for|while|switch|else|elif|try|match|func|fn|def|class)\b.*[{:]|(?:import|from|use|package|\#include)\s+[\w.:<>"'/{}* ,]+;?
      |.*[{}]|[\w.\[\]()+*/<>=!&|, -]*[=()\[\]][\w.\[\]()+*/<>=!&|, -]*;)$""",
    re.X,
)
_PROSE_CALL = re.compile(r"^\w+\s\(")
_WORD = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+|(?![\p{Han}\p{Hiragana}\p{Katakana}])\p{L}[\p{L}\p{M}'’]*(?:-\p{L}+)*")
_IDENT = re.compile(r"`[^`\n]*`|\b\w*(?:_\w+|::\w+)+\b|https?://\S+|\b[\w./]+\(\)")
_CJK = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n")


def clean_lines(doc: str) -> list[str]:
    """The lines without comment marks; whole-text quotes are taken off too."""
    text = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        text = text.strip(text[0])
    out = []
    for line in text.split("\n"):
        line = line.strip()
        while m := _MARKS.match(line):
            line = line[m.end() :].strip()
        out.append(_ENDS.sub("", line).strip())
    return out


def prose(doc: str | None) -> str:
    """What remains of a documentation without marks, tags, task notes,
    directives, licence notices and code that was commented out."""
    if not doc:
        return ""
    kept: list[str] = []
    skipping = ""
    for line in clean_lines(doc):
        if not line:
            skipping = ""
            kept.append("\n")
            continue
        tag = _TAG.match(line)
        if tag and (tag[1] or "").lower() in PROSE_TAGS:
            line, tag, skipping = line[tag.end() :].strip(" :"), None, ""
        if tag:
            skipping = "tag"
            continue
        if m := _TASK.search(line[:12]):
            rest = line[m.end() :].strip(" :-")
            # a short note ends with its line, a longer one may run on
            skipping = "task" if len(rest.split()) > 2 and not rest.endswith((".", "!", "?")) else ""
            continue
        if skipping == "tag":
            continue
        if skipping == "task":
            if not (line[:1].isupper() or re.match(r"\w+ in, \w+ out;", line)):
                if line.endswith((".", "!", "?")):
                    skipping = ""
                continue
            skipping = ""
        if _DIRECTIVE.match(line) or (_CODE.match(line) and not _PROSE_CALL.match(line)):
            continue
        # a notice such as an SPDX line stands alone, with no stop at its end
        kept.append(line + ("\n" if re.match(r"spdx-|copyright\b|\(c\)", line, re.I) and not line.endswith(".") else " "))
    return " ".join(s.strip() for s in _SENTENCE.split("".join(kept)) if s.strip() and not _LICENCE.search(s))


@lru_cache(50_000)
def name_words(name: str) -> frozenset[str]:
    parts = re.findall(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\d+", name)
    return frozenset(p.lower() for p in parts) | {name.lower()}


def count_words(text: str, name: str | None) -> int:
    """Words of prose that do not occur in the name. Scripts without blanks
    count two characters as a word, identifiers and links are no prose."""
    taken = name_words(name or "")
    n = 0
    for word in _WORD.findall(_IDENT.sub(" ", text)):
        if _CJK.match(word):
            n += len(word) // 2
        elif word.lower() not in taken:
            n += 1
    return n


def is_real(doc: str | None, name: str | None) -> bool:
    return bool(doc) and count_words(prose(doc), name) >= MIN_WORDS


class Grammar(NamedTuple):
    """What is an island in a language; the rest is water."""

    comment: str
    string: str
    annotation: str
    modifiers: str
    callable: str  # a variable that holds a function, up to its value
    head: str  # a function behind its modifiers, up to its parameters


_SLASH = r"/\*.*?\*/|//[^\n]*"
_DQ, _SQ, _BQ, _CHAR = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"`(?:[^`\\]|\\.)*`", r"'(?:[^'\\\n]|\\[^\n]{1,8})'"
_AT = r"@[\w.$]+"
_TYPES = r"(?:<[^{};]*?>)?"
_SCRIPT = Grammar(
    _SLASH, f"{_DQ}|{_SQ}|{_BQ}", _AT, r"export|default|declare|abstract|public|private|protected|static|readonly|async",
    r"(?:const|let|var)\s+[\w$]+\s*(?::[^=;\n]*?)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{]+?)?\s*=>|[\w$]+\s*=>)",
    rf"(?:(?:const|let|var)\s+)?(?P<held>[\w$]+)\s*(?::[^=;\n]*?)?=\s*(?:async\s*)?(?:(?:function\s*\*?\s*[\w$]*\s*{_TYPES}\s*)?(?=\()|[\w$]+\s*(?==>))"
    rf"|(?:function\b\s*\*?|get\s+|set\s+|\*)?\s*(?!(?:if|for|while|switch|catch|return|else|do|with|new|await|function)\b)(?P<name>[\w$#]+)\s*{_TYPES}\s*(?=\()",
)
GRAMMARS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": Grammar(_SLASH, f"{_DQ}|`[^`]*`|{_CHAR}", r"(?!)", r"(?!)", r"(?:var|const)?\s*\w+\s*(?:=|:=)\s*func\b",
        r"func\s*(?:\([^()]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?(?=\()|(?:(?:var|const)\s+)?(?P<held>\w+)\s*:?=\s*func\s*(?=\()"),
    "rust": Grammar(_SLASH, f"{_DQ}|{_CHAR}", r"#!?\[", r"pub(?:\([^)]*\))?|async|unsafe|const|extern|default", r"(?:pub\s+)?(?:let|static|const)\s+(?:mut\s+)?\w+\s*(?::[^=;\n]*)?=\s*(?:move\s*)?\|",
        rf"fn\s+(?P<name>\w+)\s*{_TYPES}\s*(?=\()|(?:let|static|const)\s+(?:mut\s+)?(?P<held>\w+)\s*(?::[^=;\n]*)?=\s*(?:move\s*)?\|[^|\n]*\|"),
    "c": Grammar(_SLASH, f"{_DQ}|{_CHAR}", r"__attribute__|\[\[", r"static|inline|extern|const", r"(?!)",
        r"(?:(?!(?:return|else|typedef|if|for|while|switch|do|case|goto)\b)[A-Za-z_]\w*(?:\s+|\s*\*+\s*))+(?P<name>\w+)\s*(?=\()"),
    "python": Grammar(r"\#[^\n]*", r"[rRuUbBfF]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|" + f"{_DQ}|{_SQ})", _AT, r"async", r"\w+\s*(?::[^=\n]*)?=\s*lambda\b",
        r"def\s+(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?(?=\()|(?P<held>\w+)\s*(?::[^=\n]*)?=\s*lambda\b"),
}
EXTENSIONS = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go",
    "rs": "rust", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "py": "python",
}
_OPEN, _CLOSE = "([{", ")]}"


@lru_cache
def _islands_of(lang: str) -> tuple[re.Pattern, ...]:
    g = GRAMMARS[lang]
    return (
        re.compile(f"(?P<comment>{g.comment})|(?P<string>{g.string})", re.S),
        re.compile(g.annotation),
        re.compile(f"(?:{g.modifiers})\\s+"),
        re.compile(rf"(?m)^[ \t]*(?P<decl>(?:export\s+)?(?:default\s+)?{g.callable})"),
        re.compile(rf"{g.string}|{g.comment}|[()\[\]{{}}]", re.S),
        re.compile(g.head),
        re.compile(rf"(?m)^[ \t]*(?P<decl>(?:(?:{g.modifiers})\s+)*(?:{g.head}))"),
        re.compile(rf"{g.string}|{g.comment}|=>|[()\[\]{{}};:\n]", re.S),
    )


def balanced(text: str, at: int, tokens: re.Pattern) -> int:
    """The end of the bracketed part that begins at ``at``; the text's end if
    it is never closed. Brackets in strings and comments do not count."""
    depth = 0
    for m in tokens.finditer(text, at):
        c = m.group()
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(text)


_GAP = re.compile(r"[ \t\r]*\n?[ \t\r]*")
_DEF = re.compile(r"(?m)^[ \t]*(?P<decl>(?:async[ \t]+)?def[ \t]+\w+[ \t]*)(?=[(\[])")
_BODY = re.compile(r"[^:\n]*:(?:[ \t]*(?:\#[^\n]*)?\r?\n)*[ \t]*")


def raw(part: str) -> str:
    return part.encode("latin-1").decode("utf-8", "replace")


def places(text: str, at: int, lang: str) -> tuple[list[int], int]:
    """Where the declaration at an offset may be said to begin: there, or
    behind annotations and modifiers; and where its annotations end."""
    _, annotation, modifiers, _, tokens, *_ = _islands_of(lang)
    out = [at]
    while m := annotation.match(text, at):
        at = m.end()
        if text[at - 1] == "[":
            at = balanced(text, at - 1, tokens)
        elif text[at : at + 1] == "(":
            at = balanced(text, at, tokens)
        at = _GAP.match(text, at).end()
        out.append(at)
    begin = at
    while m := modifiers.match(text, at):
        at = m.end()
        out.append(at)
    return out, begin


class Declaration(NamedTuple):
    """A function: its name, where its signature begins and ends, where it ends."""

    name: str
    start: int
    body: int
    end: int


def _block_end(text: str, line: int, colon: int, lang: str) -> int:
    """The end of a Python block whose header ends with a colon: its line, or
    the lines that are indented more than the header's."""
    masked = _islands_of(lang)[0]
    own = len(text[line:]) - len(text[line:].lstrip(" \t"))
    stop = text.find("\n", colon)
    stop = len(text) if stop < 0 else stop
    rest = text[colon + 1 : stop].strip()
    if rest and not rest.startswith("#"):
        return stop
    end, at, opened = stop, stop + 1, 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        row = text[at:stop]
        if at >= opened and row.strip():
            if len(row) - len(row.lstrip(" \t")) <= own:
                break
            for m in masked.finditer(text, at, len(text)):  # a string may run over several lines
                if m.start() >= stop:
                    break
                opened = max(opened, m.end())
        if row.strip():
            end = stop
        at = stop + 1
    return max(end, min(opened, len(text)))


def declaration(text: str, at: int, lang: str) -> Declaration | None:
    """The function declared at an offset (or behind annotations and modifiers
    there): head, balanced parameters, what is between them and the body, and
    the body: balanced braces, an expression, or an indented block."""
    *_, tokens, head, _, marks = _islands_of(lang)
    where, begin = places(text, at, lang)
    m = next((m for p in reversed(where) if (m := head.match(text, p))), None)
    if m is None:
        return None
    name = m.groupdict().get("name") or m.groupdict().get("held") or ""
    pos = balanced(text, m.end(), tokens) if text[m.end() : m.end() + 1] == "(" else m.end()
    closure = lang == "rust" and m.groupdict().get("held") is not None
    typed = False  # behind the colon of a type, before any of it
    while n := marks.search(text, pos):
        c, pos = n.group(), n.end()
        between = text[pos - len(c) - 40 : n.start()].rstrip()[-1:]
        if lang == "python":
            if c == ":":
                line = text.rfind("\n", 0, m.start()) + 1
                lambda_ = m.groupdict().get("held") is not None
                stop = text.find("\n", pos)
                return Declaration(raw(name), begin, pos, (len(text) if stop < 0 else stop) if lambda_ else _block_end(text, line, n.start(), lang))
            if c in _OPEN:
                pos = balanced(text, n.start(), tokens)
            continue
        if c == ":":
            typed = True
            continue
        if c == "{" and typed and between == ":":  # a type written as a literal
            pos, typed = balanced(text, n.start(), tokens), False
            continue
        if c == "{":
            return Declaration(raw(name), begin, n.start(), balanced(text, n.start(), tokens))
        if c == "=>":
            after = _GAP.match(text, pos).end()
            if text[after : after + 1] == "{":
                return Declaration(raw(name), begin, pos, balanced(text, after, tokens))
            return Declaration(raw(name), begin, pos, _expression_end(text, after, marks, tokens))
        if c == ";":
            return Declaration(raw(name), begin, n.start(), pos)
        if c in ("(", "["):
            pos = balanced(text, n.start(), tokens)
        elif c in (")", "]", "}"):
            return Declaration(raw(name), begin, n.start(), n.start())
        elif c == "\n" and closure:
            return Declaration(raw(name), begin, m.end(), n.start())
    return Declaration(raw(name), begin, len(text), len(text))


def _expression_end(text: str, at: int, marks: re.Pattern, tokens: re.Pattern) -> int:
    while n := marks.search(text, at):
        c, at = n.group(), n.end()
        if c in _OPEN:
            at = balanced(text, n.start(), tokens)
        elif c in (";", "\n") or c in _CLOSE:
            return at if c == ";" else n.start()
    return len(text)


def signature_of(text: str, found: Declaration) -> str:
    return " ".join(raw(text[found.start : found.body]).split())


def functions_in(data: bytes | None, lang: str) -> Iterator[tuple[Declaration, str | None]]:
    """Every function that begins a line, with the documentation written for
    it, in order; what lies within strings and comments is none."""
    if not data:
        return
    text = data.decode("latin-1")
    masked, *_, lines, _ = _islands_of(lang)
    docs = {at: doc for at, doc, holds in islands(data, lang) if not holds}
    hidden = [m.span() for m in masked.finditer(text)]
    k, seen = 0, set()
    for m in lines.finditer(text):
        at = m.start("decl")
        while k < len(hidden) and hidden[k][1] <= at:
            k += 1
        if k < len(hidden) and hidden[k][0] <= at:
            continue
        found = declaration(text, at, lang)
        if found and found.end > found.body and found.start not in seen and (text[found.body : found.body + 1] == "{" or lang == "python" or m.groupdict().get("held")):
            seen.add(found.start)
            yield found, next((docs[p] for p in places(text, at, lang)[0] if p in docs), None)


def islands(data: bytes | None, lang: str) -> Iterator[tuple[int, str | None, bool]]:
    """``(offset, doc, holds)`` of what documents or declares something.

    ``offset`` is the byte where a declaration begins, given once for each
    place at which an index may let it begin (before or after annotations and
    modifiers); ``holds`` marks a variable that holds a function.
    """
    if not data:
        return
    text = data.decode("latin-1")  # one character is one byte
    masked, _, _, callables, tokens, *_ = _islands_of(lang)
    block: list[str] = []
    block_end, strings = -1, []

    def close() -> Iterator[tuple[int, str | None, bool]]:
        if block:
            gap = _GAP.match(text, block_end)
            if gap.end() < len(text) and text[gap.end()] not in "\n":
                doc = raw("\n".join(block))
                for at in places(text, gap.end(), lang)[0]:
                    yield at, doc, False

    for m in masked.finditer(text):
        if m["string"] is not None:
            strings.append(m.span())
            continue
        line = text.rfind("\n", 0, m.start()) + 1
        own_line = not text[line : m.start()].strip()
        gap = text[block_end : m.start()] if block else ""
        if block and own_line and not gap.strip() and gap.count("\n") <= 1:
            block.append(m.group())
        else:
            yield from close()
            block = [m.group()] if own_line else []
        block_end = m.end()
    yield from close()

    if lang == "python":
        doc_at = dict(strings)
        for m in _DEF.finditer(text):
            body = _BODY.match(text, balanced(text, m.end(), tokens))
            if body and body.end() in doc_at:
                for at in places(text, m.start("decl"), lang)[0]:
                    yield at, raw(text[body.end() : doc_at[body.end()]]), False
    for m in callables.finditer(text):
        yield m.start("decl"), None, True


def plain_path(file: Column) -> Column:
    """The plain form of a file's path."""
    return F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def _newest(parts: DataFrame, column: str) -> DataFrame:
    """One row a file: that of the newest content, of equally old ones that of
    the greatest hash; so contents need no shuffle."""
    return parts.groupBy("file").agg(F.max_by(column, F.struct("age", "digest")).alias(column))


def _contents(files: DataFrame) -> DataFrame:
    age = F.col("mtime") if "mtime" in files.columns else F.lit(None)
    rows = files.select("file", F.col("content").cast("binary").alias("content"), age.cast("timestamp_ntz").alias("age"), F.xxhash64("content").alias("digest"))
    return spread(rows.where("file IS NOT NULL AND content IS NOT NULL"), "file")


def _language(file: str) -> str | None:
    return EXTENSIONS.get(file.rpartition(".")[2].lower())


_ISLAND = pa.struct([("at", pa.int64()), ("doc", pa.string()), ("holds", pa.bool_())])


def source_islands(files: DataFrame) -> DataFrame:
    """``file, at, doc, holds``: islands of every file with a known language
    (by extension): those whose text has enough words to be real, and
    variables that hold functions. Of a file's contents the newest counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lang, mine = _language(file), []
                for at, doc, holds in islands(data, lang) if lang else ():
                    text = None if doc is None else prose(doc)
                    if holds or count_words(text, None) >= MIN_WORDS:
                        mine.append({"at": at, "doc": text, "holds": holds})
                rows.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_ISLAND)), batch.column(2), batch.column(3)], names=["file", "islands", "age", "digest"])

    found = _contents(files).mapInArrow(run, "file string, islands array<struct<at:bigint,doc:string,holds:boolean>>, age timestamp_ntz, digest bigint")
    return _newest(found, "islands").select("file", F.explode("islands").alias("i")).select("file", "i.*")


def source_pairs(files: DataFrame) -> DataFrame:
    """``file, name, start, end, signature, code, description`` of every
    function or method in the sources that has real documentation, without
    any index: offsets are bytes, the description is the prose of the
    comment before it or of its docstring. Any bytes are read; null names and
    contents give nothing, of several contents of a file the newest counts."""
    pair = pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("signature", pa.string()), ("code", pa.string()), ("description", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lang, mine = _language(file), []
                text = data.decode("latin-1")
                for d, doc in functions_in(data, lang) if lang else ():
                    said = prose(doc)
                    if count_words(said, d.name) >= MIN_WORDS:
                        mine.append({"name": d.name, "start": d.start, "end": d.end, "signature": signature_of(text, d), "code": raw(text[d.start : d.end]), "description": said})
                rows.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pair)), batch.column(2), batch.column(3)], names=["file", "pairs", "age", "digest"])

    schema = "file string, pairs array<struct<name:string,start:bigint,end:bigint,signature:string,code:string,description:string>>, age timestamp_ntz, digest bigint"
    return _newest(_contents(files).mapInArrow(run, schema), "pairs").select("file", F.explode("pairs").alias("p")).select("file", "p.*")


@F.pandas_udf(T.BooleanType())
def _real(doc: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([is_real(d, n) for d, n in zip(doc, name, strict=True)], dtype="boolean")


@F.pandas_udf(T.BooleanType())
def _enough(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([bool(t) and count_words(t, n) >= MIN_WORDS for t, n in zip(text, name, strict=True)], dtype="boolean")


def _functions(symbols: DataFrame) -> DataFrame:
    kind = clean_kind("kind")
    return symbols.where(kind.isin(FUNCTION_KINDS + VARIABLE_KINDS) & F.col("id").isNotNull()).select(
        "id", "name", plain_path(F.col("file")).alias("file"), F.col("start_byte").alias("at"), "end_byte", "signature", "doc",
        kind.isin(VARIABLE_KINDS).alias("variable"),
    )


_HOLDS = r"=\s*(?:async\b|function\b|func\b|lambda\b|(?:move\s*)?\||.*=>)"


def documented(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``id, variable, own, near, holds`` of every function-like symbol, one
    row an id: whether its own documentation is real, whether the text at its
    place in the source is, and whether it (if a variable) holds a function."""
    rows = _functions(symbols).groupBy("id", "file", "at", "variable", "name").agg(
        F.max(_real("doc", "name")).alias("own"), F.max(F.coalesce(F.col("signature").rlike(_HOLDS), F.lit(False))).alias("sig_holds")
    )
    found = source_islands(files)
    met = rows.join(found, ["file", "at"], "left")
    flags = met.select("id", "variable", "own", "sig_holds", "holds", _enough(F.col("doc"), F.col("name")).alias("near"))
    holds = F.col("sig_holds") | F.coalesce("holds", F.lit(False))
    return flags.groupBy("id", "variable").agg(F.max("own").alias("own"), F.max("near").alias("near"), F.max(holds).alias("holds"))


def documented_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``id`` of every function or method with real documentation.

    Rows of any age or deletion count, kinds compare trimmed, without case and
    with their short forms; a variable counts if it holds a function. Null
    ids, files, spans, docs and contents are taken as absent; copies give one
    row; empty tables give none; further columns are ignored.
    """
    return documented(symbols, files).where((~F.col("variable") | F.col("holds")) & (F.col("own") | F.col("near"))).select("id").distinct()


def function_pairs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``id, signature, code, description`` of every documented function.

    All but the description come from one row of the id: the newest that has
    a place, else the newest. The code is its span in the newest content of
    its file, or, where the span is not whole, that of the function that the
    source declares there. The signature is the row's or else the one in the
    source, which may run over several lines; where nothing is declared, the
    code's first line. The description is the prose of the newest real
    documentation of the id, or else of the source text. Bytes that are not
    UTF-8 are replaced. Without a readable file code is null.
    """
    real = documented_functions(symbols, files)
    rows = symbols.select("id", "name", plain_path(F.col("file")).alias("file"), "start_byte", "end_byte", "signature", "doc", "indexed_at").join(real, "id", "left_semi")
    age = F.struct(F.col("indexed_at").isNotNull(), "indexed_at")
    placed = F.struct((F.col("start_byte").isNotNull() & F.col("file").isNotNull()).alias("placed"), age.alias("age"), F.xxhash64("file", "start_byte", "end_byte", "signature"))
    row = F.struct("name", "file", F.col("start_byte").alias("at"), F.col("end_byte").alias("stop"), "signature")
    newest = rows.groupBy("id").agg(F.max_by(row, placed).alias("r"), F.max_by("doc", F.when(_real("doc", "name"), F.struct(age.alias("age"), "doc"))).alias("doc"))
    asked = newest.select("r.file", F.struct("id", "r.name", "r.at", "r.stop", "r.signature", "doc").alias("f"))
    placed_ = asked.where("file IS NOT NULL AND f.at IS NOT NULL").groupBy("file").agg(F.collect_list("f").alias("functions"))  # those of one file
    best = _contents(files).groupBy("file").agg(F.max_by("content", F.struct("age", "digest")).alias("content"))
    cut = pa.schema([("id", pa.string()), ("signature", pa.string()), ("code", pa.string()), ("near", pa.string())])
    kind = symbols.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data, functions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lang, text = _language(file), data.decode("latin-1")
                docs = {at: doc for at, doc, holds in islands(data, lang) if not holds} if lang else {}
                out = []
                for f in functions:
                    at, stop = f["at"], f["stop"]
                    found = declaration(text, at, lang) if lang and 0 <= at < len(text) else None
                    whole = stop is not None and 0 <= at < stop <= len(text)
                    code = raw(text[at:stop]) if whole else raw(text[at : found.end]) if found else None
                    said = f["signature"] or (signature_of(text, found) if found else (code or "").split("\n", 1)[0].strip()) or None
                    near = prose(docs.get(at)) if at in docs else None
                    out.append((f["id"], said, code, near if near and count_words(near, f["name"]) >= MIN_WORDS else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), cut, strict=True)], schema=cut)

    read = best.join(placed_, "file").mapInArrow(run, f"id {kind}, signature string, code string, near string")
    own = F.pandas_udf(_own_prose, T.StringType())
    out = newest.select("id", F.col("r.signature").alias("given"), own("doc").alias("own")).join(read, "id", "left")
    return out.select("id", F.coalesce("given", "signature").alias("signature"), "code", F.coalesce("own", "near").alias("description"))


def _own_prose(doc: pd.Series) -> pd.Series:
    return pd.Series([prose(d) or None for d in doc], dtype="object")
