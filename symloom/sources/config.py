"""Configuration of a project and the languages in it."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from symloom.extract.rules import PACKAGED, Registry

INDEX_DIR, CONFIG_FILE, LANGUAGES_ENV = ".symloom", ".symloom.toml", "SYMLOOM_LANGUAGES"

# Patterns left out by default; known languages with extensions and marker files.
EXCLUDE = [
    "**/.git/**", "**/node_modules/**", "**/target/**", "**/build/**", "**/__pycache__/**", "**/.venv/**", "**/*.min.js", "**/vendor/**", "**/dist/**",
]
BUILTIN = {
    "c": (["c", "h"], ["Makefile", "CMakeLists.txt", "*.c"]),
    "rust": (["rs"], ["Cargo.toml"]),
    "python": (["py"], ["pyproject.toml", "setup.py", "requirements.txt"]),
    "javascript": (["js", "jsx", "mjs", "cjs"], ["package.json"]),
    "typescript": (["ts", "tsx"], ["tsconfig.json"]),
    "go": (["go"], ["go.mod"]),
    "java": (["java"], ["pom.xml", "build.gradle", "build.gradle.kts"]),
    "ruby": (["rb"], ["Gemfile"]),
    "csharp": (["cs"], ["*.csproj", "*.sln"]),
    "cpp": (["cpp", "cc", "cxx", "hpp", "hxx"], ["CMakeLists.txt"]),
    "sql": (["sql"], []),
    "html": (["html", "htm"], []),
}
SKIPPED_DIRS = {"node_modules", "target"}


@dataclass
class Config:
    """All settings are optional; ``languages`` restricts the walk if set."""

    base: Path = Path(".")
    roots: list[str] = field(default_factory=lambda: ["."])
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    index_dir: str = INDEX_DIR
    languages: list[str] = field(default_factory=list)
    declared: bool = False  # languages were named, not detected

    @classmethod
    def load(cls, base: str | Path = ".") -> Config:
        """From the project's file if there is one, else defaults; languages
        that are not named are detected."""
        out = cls(base=Path(base))
        path = out.base / CONFIG_FILE
        if path.exists():
            raw = tomllib.loads(path.read_text(encoding="utf-8"))
            unknown = set(raw) - {"roots", "exclude", "index_dir", "languages"}
            if unknown:
                raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
            for key, value in raw.items():
                setattr(out, key, value)
        out.declared = bool(out.languages)
        if not out.languages:
            out.languages = detect_languages(out.base)
        return out

    @property
    def index_path(self) -> Path:
        return self.base / self.index_dir

    def extensions(self) -> list[str]:
        return [e for lang in self.languages for e in BUILTIN.get(lang, ([], []))[0]]


def detect_languages(base: Path) -> list[str]:
    """Known languages with a marker in the folder, or with a file of theirs
    in it or one level below (hidden and build folders aside)."""
    if not base.is_dir():
        return []
    top = sorted(base.iterdir())
    names = {p.name for p in top}
    files = [p.name for p in top if p.is_file()]
    for d in top:
        if d.is_dir() and not d.name.startswith(".") and d.name not in SKIPPED_DIRS:
            files += [p.name for p in d.iterdir() if p.is_file()]
    suffixes = {f.rpartition(".")[2] for f in files if "." in f[1:]}

    def marked(marker: str) -> bool:
        return any(n.endswith(marker[1:]) for n in names) if marker.startswith("*") else marker in names

    return [lang for lang, (ext, markers) in BUILTIN.items() if suffixes & set(ext) or any(map(marked, markers))]


def languages_dir(base: Path) -> Path:
    """Where rule files are: the environment's folder, the project's, the
    user's, the one below the base, or the packaged one; the first that exists."""
    home = Path(os.environ.get("XDG_DATA_HOME", Path.home() / ".local/share"))
    places = [os.environ.get(LANGUAGES_ENV), base / INDEX_DIR / "languages", home / "symloom/languages", base / "languages"]
    return next((Path(p) for p in places if p and Path(p).is_dir()), PACKAGED)


def load_registry(base: Path) -> Registry:
    return Registry.load(languages_dir(base))


def glob_to_regex(pattern: str, anchored: bool | None = None) -> re.Pattern | None:
    """An ignore-file or exclude pattern over paths with slashes; a directory
    covers what is below. Null for a pattern that cannot be read."""
    p = pattern.rstrip("/")
    if anchored is None:
        anchored = "/" in p
    out, i = "", 0
    p = p.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "(?:/.*)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + out + "(?:/.*)?")
    except re.error:
        return None
