"""Source files of a project as a table.

Spark's own file source leaves out names that begin with ``_`` or ``.``, so
that ``__init__.py`` would be lost; the walk is done here and the reading is
spread over the executors, which must see the same folder.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from symloom.extract.rules import Registry
from symloom.sources.config import Config, glob_to_regex

FILES = "file string, lang string, content binary, content_hash string, mtime timestamp, n_bytes long, status string"


def _ignores(folder: Path, inside: str) -> list[tuple[re.Pattern, bool]]:
    path = folder / ".gitignore"
    out = []
    if path.is_file():
        for line in path.read_text(encoding="utf-8", errors="replace").splitlines():
            line = line.strip()
            if line and not line.startswith("#"):
                keep = line.startswith("!")
                body = line.lstrip("!")
                rule = glob_to_regex(body, "/" in body.rstrip("/"))
                if rule:
                    out.append((re.compile(re.escape(inside) + f"(?:{rule.pattern})"), keep))
    return out


def walk(config: Config, registry: Registry) -> list[str]:
    """Paths below the roots, relative to the base, with forward slashes and
    in order: not hidden, not ignored by an ignore file (the deeper and later
    line decides), not excluded, and of a known (and configured) language."""
    base = config.base.resolve()
    exclude = [r for r in map(glob_to_regex, config.exclude) if r]
    wanted = set(config.languages) if config.declared else None
    found: set[str] = set()
    for root in config.roots:
        top = (base / root).resolve()
        rules: dict[str, list] = {}
        for here, dirs, files in os.walk(top):
            inside = Path(here).relative_to(base).as_posix() if Path(here).is_relative_to(base) else here
            prefix = "" if inside == "." else inside + "/"
            mine = rules.get(str(Path(here).parent), []) + _ignores(Path(here), prefix)
            rules[here] = mine

            def ignored(path: str, mine=mine) -> bool:
                state = False
                for rule, keep in mine:
                    if rule.fullmatch(path):
                        state = not keep
                return state or any(r.fullmatch(path) for r in exclude)

            dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not ignored(prefix + d))
            for name in files:
                lang = registry.for_file(name)
                if not name.startswith(".") and lang and (wanted is None or lang.id in wanted) and not ignored(prefix + name):
                    found.add(prefix + name)
    return sorted(found)


def stat_files(base: Path, paths: list[str]) -> list[tuple[str, int, int]]:
    """``(file, mtime in microseconds, size)`` of the files that are there."""
    out = []
    for p in paths:
        try:
            s = os.stat(base / p)
        except OSError:
            continue
        out.append((p, int(s.st_mtime * 1e6), s.st_size))
    return out


def read_files(spark: SparkSession, base: Path, paths: list[str], registry: Registry) -> DataFrame:
    """The files' bytes; one that cannot be read has status ``unreadable``."""
    top = str(base.resolve())
    langs = {p: registry.for_file(p).id if registry.for_file(p) else None for p in paths}
    schema = pa.schema([("file", pa.string()), ("lang", pa.string()), ("content", pa.binary()), ("content_hash", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("n_bytes", pa.int64()), ("status", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    path = os.path.join(top, file)
                    data = Path(path).read_bytes()
                    rows.append((file, lang, data, hashlib.sha256(data).hexdigest(), int(os.stat(path).st_mtime * 1e6), len(data), "ok"))
                except OSError:
                    rows.append((file, lang, None, None, None, None, "unreadable"))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    listed = spark.createDataFrame(sorted(langs.items()), "file string, lang string")
    parts = max(1, min(len(paths) // 64 + 1, 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(parts, "file").mapInArrow(run, FILES)


def git(base: Path, *args: str) -> bytes | None:
    try:
        done = subprocess.run(["git", "-C", str(base), *args], capture_output=True, timeout=60, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def git_head(base: Path) -> str | None:
    out = git(base, "rev-parse", "HEAD")
    return out.decode().strip() if out else None


def git_changes(base: Path, since: str) -> dict[str, str] | None:
    """Path to ``A``, ``M`` or ``D`` since a commit, the working tree and
    untracked files included; null where git cannot tell."""
    diff = git(base, "diff", "--name-status", "-z", "--no-renames", "--relative", since)
    new = git(base, "ls-files", "-z", "--others", "--exclude-standard")
    if diff is None or new is None:
        return None
    words = diff.decode("utf-8", "surrogateescape").split("\0")
    out = {path: state[0] if state[0] in "AD" else "M" for state, path in zip(words[::2], words[1::2], strict=False) if state}
    return out | {p: "A" for p in new.decode("utf-8", "surrogateescape").split("\0") if p}
