"""Languages as data: rule files and the extractor that follows them.

A rule file names a language, its extensions and comment family, and lists
patterns for symbols, calls and imports. A new language needs no code.
"""

from __future__ import annotations

import re
import tomllib
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from symloom.extract.lexing import FAMILIES, Source
from symloom.extract.model import Extraction, Found, Reference, Symbol, doc_text, kind_of, owners, qualified_names, signature

PACKAGED = Path(__file__).parent / "languages"


class LanguageError(ValueError):
    """A rule file that cannot be used."""


@dataclass(frozen=True)
class Rule:
    node: str
    match: str
    ends: str = "body"
    inner: str | None = None  # pattern of each item in the match's last bracket
    item_span: bool = True  # an item's span is its own, else the whole match's
    separators: str = ",;\n"
    named: bool = True
    value_bracket: str = "{"


@dataclass(frozen=True)
class Language:
    id: str
    name: str
    extensions: tuple[str, ...]
    family: str
    markers: tuple[str, ...] = ()
    frontend: str = "rules"
    rules: tuple[Rule, ...] = ()
    calls: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()


def parse_language(text: str, where: str = "rules") -> Language:
    try:
        raw = tomllib.loads(text)
        rules = tuple(Rule(**r) for r in raw.get("symbol", []))
        lang = Language(
            raw["id"], raw.get("name", raw["id"]), tuple(raw["extensions"]), raw.get("family", "slash"), tuple(raw.get("markers", [])),
            raw.get("frontend", "rules"), rules, tuple(raw.get("calls", [])), tuple(raw.get("imports", [])),
        )
        for p in [*(r.match for r in rules), *(r.inner for r in rules if r.inner), *lang.calls, *lang.imports]:
            re.compile(p)
    except (tomllib.TOMLDecodeError, KeyError, TypeError, re.error) as e:
        raise LanguageError(f"{where}: {e}") from e
    if lang.family not in FAMILIES or lang.frontend not in ("rules", "python"):
        raise LanguageError(f"{where}: unknown family or frontend")
    return lang


@dataclass
class Registry:
    """Languages by id and by extension; the last one registered wins."""

    languages: dict[str, Language] = field(default_factory=dict)
    by_extension: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def register(self, lang: Language) -> None:
        self.languages[lang.id] = lang
        self.by_extension.update({e.lstrip(".").lower(): lang.id for e in lang.extensions})

    def for_file(self, path: str) -> Language | None:
        name = path.rsplit("/", 1)[-1]
        ext = name.rpartition(".")[2].lower() if "." in name[1:] else ""
        return self.languages.get(self.by_extension.get(ext, ""))

    @classmethod
    def load(cls, folder: Path = PACKAGED) -> Registry:
        """Every rule file of a folder; a bad one is skipped with a warning."""
        out = cls()
        for path in sorted(folder.glob("*.toml")):
            try:
                out.register(parse_language(path.read_text(encoding="utf-8"), path.name))
            except LanguageError as e:
                out.warnings.append(str(e))
        return out


@lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.M)


def _scan(src: Source, lang: Language) -> list[Found]:
    out = []
    for order, rule in enumerate(lang.rules):
        for m in _compiled(rule.match).finditer(src.code):
            start = m.start("def") if "def" in m.re.groupindex else m.start() + len(m.group()) - len(m.group().lstrip())
            if rule.inner is None:
                out.append((start, order, Found(src.raw(*m.span("name")), rule.node, start, src.end_of(m.end() - (m.group()[-1:] in "([{"), rule.ends), rule.named)))
                continue
            opens = m.end() - 1
            if opens not in src.pairs and src.code[opens : opens + 1] not in "([{":
                continue
            close = src.close(opens)
            for a, b in src.items(opens + 1, close - 1, rule.separators):
                if hit := _compiled(rule.inner).match(src.code, a, b):
                    span = (a, a + len(src.code[a:b].rstrip())) if rule.item_span else (start, close)
                    out += [(hit.start("name"), order, Found(src.raw(*hit.span("name")), rule.node, *span, rule.named))]
    out.sort(key=lambda x: (x[0], x[1]))
    return [f for _, _, f in out if f.name]


def _sites(src: Source, patterns: tuple[str, ...], raw: bool) -> list[tuple[int, str]]:
    text = src.text if raw else src.code
    hits = [(m.start(g), src.raw(*m.span(g))) for p in patterns for m in _compiled(p).finditer(text) for g in ("name",)]

    def in_comment(at: int) -> bool:
        k = bisect_right(src.comments, (at, len(src.text))) - 1
        return k >= 0 and at < src.comments[k][1]

    return sorted({h for h in hits if h[1] and not (raw and in_comment(h[0]))})


def finish(src: Source, lang: Language, file: str, found: list[Found], calls: list[tuple[int, str]], imports: list[tuple[int, str]], innermost: bool, clean: bool) -> Extraction:
    """Symbols with names, signatures and docs; calls go to the first symbol
    that spans them (or the innermost), imports to the file's first symbol."""
    out = Extraction()
    for f, fqname in zip(found, qualified_names(file, found, clean), strict=True):
        sig = signature(src.raw(f.start, f.end))
        out.symbols.append(Symbol(lang.id, kind_of(f.node), f.name, fqname, file, f.start, f.end, src.line(f.start), src.line(max(f.end - 1, f.start)), sig or None, doc_text(src.comments_before(f.start))))
    for (_, name), owner in zip(calls, owners(found, [at for at, _ in calls], innermost), strict=True):
        if owner is not None:
            out.references.append(Reference(owner, name, "calls"))
    if found:
        out.references += [Reference(0, name, "imports") for _, name in imports]
    return out


def extract(file: str, data: bytes, lang: Language, innermost: bool = False, clean_names: bool = False) -> Extraction:
    """The symbols and references of one file. Any bytes are accepted; broken
    syntax costs what it hides and no more."""
    if lang.frontend == "python":
        from symloom.extract.python_ast import read

        src, found, calls, imports = read(data, lang)
    else:
        src = Source(data, lang.family)
        found = _scan(src, lang)
        calls, imports = _sites(src, lang.calls, False), _sites(src, lang.imports, True)
    return finish(src, lang, file, found, calls, imports, innermost, clean_names)
