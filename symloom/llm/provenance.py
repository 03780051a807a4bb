"""Which source files were not written by hand in their own project.

Three kinds of signs are joined. *Declared*: attribute files of a repository
mark paths as generated or vendored; globs are resolved per directory and
attribute, the deeper file and the later line winning. *Evidence*: what a file's content
shows (a notice of a tool or of its origin at the top or the end, minified or bundled code,
nothing but data). *Mined*: path patterns (directory names before a package
directory, double file extensions, ...) and wordings of notices that
declarations and evidence keep hitting in several projects are applied to all
repositories.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex as re
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.plans.scratch import Scratch
from symloom.plans.tables import spread

ATTRIBUTE_FILE = ".gitattributes"

#: A path pattern is mined if at least so many files with a sign show it, in
#: so many projects, and this share of the files that it hits has a sign.
MIN_FILES, MIN_PROJECTS, MIN_SHARE = 3, 2, 0.4
#: The same of a wording, which is so many words in a row of a leading or trailing comment.
NOTICE_FILES, NOTICE_PROJECTS, NOTICE_SHARE, NOTICE_WORDS = 10, 3, 0.8, 4
#: A pattern that some project's configuration excludes needs less support.
EXCLUDED_FILES, EXCLUDED_SHARE = 1, 0.25

# Extensions before the last, and ends of the name before the first dot, by which code generators name their output.
TOOL_EXTENSIONS = ["pb", "g", "tab", "generated", "gen", "autogen", "designer"]
TOOL_ENDINGS = ["_pb2", "_pb2_grpc", "_pb", "_grpc", "_generated", "_autogen", "_autogenerated", "_gen"]

# Wording by which tools and copies announce themselves, and by
# which people say that a file is theirs.
TOOL_NOTICES = [
    r"@generated\b",
    r"<auto-?generated>",
    r"\bauto-?(matically )?[- ]?generated (file|code|by|from|source)\b",
    r"^\W*autogenerated\b",
    r"\bcode generated\b.{0,80}\bdo not edit\b",
    r"\b(file|code|source|module|header|script)\b.{0,30}\b(is|was|has been|were)\b.{0,12}\b(auto-?|automatically |machine[- ])?(generated|produced|emitted)\b",
    r"\b(this (file|code|source|module)) (is|was|has been) (automatically )?(generated|created|written|produced|emitted|made) (automatically |by )",
    r"\b(generated|produced|emitted|created|written) (automatically |auto)?(by|from|with) \S+.{0,60}\b(do not|don't|never|any) .{0,20}(edit|modif|change)",
    r"\bautomatically (created|generated|produced|written|built) (from|by|with)\b",
    r"\bmachine[- ](written|generated|made)\b",
    r"\bdo not (edit|modify|change)( this file)?( by hand)?\b.{0,10}(:|;|,|--|-).{0,40}\b(rebuilt|generated|overwritten|regenerated|created)\b",
    r"^\W*(do not (edit|modify)( by hand)?)\b.{0,20}\b(rebuilt|generated)\b",
    r"\boutput of \S+ v?\d.{0,30}\bedits? (are|is|will be) (overwritten|lost)\b",
    r"\b(edits|changes|modifications) (are|will be|get) (overwritten|lost)\b",
    r"\bbegin of (emitted|generated) code\b",
    r"\bautomatisch (erzeugt|generiert|erstellt)\b",
    r"\bnicht von hand (ändern|bearbeiten)\b",
    r"\bfichier (produit|généré|créé) (automatiquement )?par\b",
    r"\bne pas (modifier|éditer)\b",
    r"\b(generado|gerado|generato) (automáticamente|automaticamente)\b",
    r"\bsource of truth is \S+",
]
ORIGIN_NOTICES = [
    r"\b(bundled|vendored|verbatim|local|embedded|pinned) cop(y|ies) of \S+",
    r"\bcopied (verbatim )?from (the )?\S+.{0,60}\b(\d+\.\d+|upstream|revision|release|sources)",
    r"\bthird[- ]party (code|source|library|file)s?\b\s*:",
    r"\bforked from \S+",
    r"\b(imported|taken|lifted|borrowed|vendored) (verbatim |unchanged |as is )?(from|out of) (the )?\S+.{0,60}\b(\d+\.\d+|upstream|sources|revision|release|repository|project)",
    r"\bkeep in (step|sync) with upstream\b",
    r"\bupstream (revision|release|version|commit)\b",
    r"^\W*(snapshot|mirror|import|extract) of (the )?\S+.{0,40}\b(taken|made|at|from|as of)\b",
    r"^\W*origin(al source)?: \S+ v?\d",
    r"\b(embedded|external|foreign|included|vendored|bundled) (library|package|dependency|module|source|code)\b.{0,60}\b(excluded|exempt|not checked|not linted|style checks|linters?)\b",
    r"^\W*\S+ v?\d+\.\d+(\.\d+)?\b.{0,10}(--|-|:).{0,20}\b(embedded|external|foreign|included|vendored|bundled)\b",
    r"\breport (problems|bugs|issues|errors) to the \S+ (project|authors|maintainers|team)\b",
    r"\bdo not send (changes|patches|fixes) here\b",
]
HAND_NOTICES = [
    r"\b(written|maintained|edited|kept) by hand\b",
    r"\bhand[- ]?(written|maintained|edited)\b",
    r"\bmay be edited freely\b",
    r"\bused to be (auto-?)?generated\b",
    r"\bno longer generated\b",
    r"\bnot generated\b",
]
_TOOL, _ORIGIN, _HAND = (re.compile("|".join(f"(?:{p})" for p in ps), re.I | re.M) for ps in (TOOL_NOTICES, ORIGIN_NOTICES, HAND_NOTICES))
_HOLDER = re.compile(r"copyright\W+(?:\(c\)|©)?\W*(?:\d{4}\W+)?(?:by )?(?:the )?([\w.-]+?)(?: (?:authors|project|contributors|team))?\b[.,]?\s*$", re.I | re.M)
_COMMENT = re.compile(r"\s*(?:(?://[/!]?|\#(?!\s*(?:include|define|ifn?def|if|endif|undef|pragma|error|else|elif)\b)|--|;+)[^\n]*(?:\n|$)|/\*.*?(?:\*/|$)|<!--.*?(?:-->|$)|\(\*.*?\*\))", re.S)
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`', re.S)
_ANY_COMMENT = re.compile(r"/\*.*?(?:\*/|$)|(?<![:\w])//[^\n]*|^\s*\#(?!\s*(?:include|define))[^\n]*", re.S | re.M)
_HEADER_LINE = re.compile(r"^\s*(?:package|import|from|use|using|require|#\s*(?:include|pragma|define|if\w*|endif)|module)\b[^\n]*$", re.M)
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d_.eE]*)\b")
_MODULE_TABLE = re.compile(r"^/\*{3}/ ?[\w\"'./-]+: ?\(|\bwebpack(Jsonp|Bootstrap|_require)|^\s*/\*{3}/", re.M)


def leading_comments(text: str) -> str:
    """The comments before the first line of code, a shebang skipped."""
    at, out = 0, []
    if text.startswith("#!"):
        at = text.find("\n") + 1 or len(text)
    while m := _COMMENT.match(text, at):
        if m.end() == at:
            break
        out.append(m.group())
        at = m.end()
    return "\n".join(out)


_COMMENT_LINE = re.compile(r"\s*(?://|/\*|\*|\#(?!\s*(?:include|define|ifn?def|if|endif|undef|pragma|error|else|elif)\b)|--|<!--|;)")


def trailing_comments(text: str) -> str:
    """The comments after the last line of code."""
    out: list[str] = []
    for line in reversed(text.split("\n")):
        if line.strip():
            if not _COMMENT_LINE.match(line):
                break
            out.append(line)
    return "\n".join(reversed(out))


def is_minified(code: str, strings_out: str) -> bool:
    """Code squeezed for a machine: hardly any blanks, short names, long lines."""
    names = _NAME.findall(strings_out)
    if len(code) < 120 or len(names) < 20:
        return False
    lines = [len(line) for line in code.split("\n") if line.strip()]
    blanks = sum(c.isspace() for c in code) / len(code)
    short = sum(len(n) <= 2 for n in names) / len(names)
    dense = max(lines) >= 120 and len(code) / len(lines) >= 60
    return dense and blanks < 0.12 and short > 0.5


def is_data(code: str, strings_out: str) -> bool:
    """Nothing but literals: without them only a declaration's few words remain."""
    if len(code) < 200:
        return False
    words = _NAME.findall(_NUMBER.sub(" ", strings_out))
    calls = re.search(r"\w\s*\(", strings_out)
    return len(words) <= 12 and not calls and re.search(r"[\[{=]", strings_out) is not None


def evidence(data: bytes | None) -> tuple[str | None, bool, list[str]]:
    """What the content shows (``tool``, ``origin``, ``minified``, ``data`` or
    null), whether it says that it is hand-written, and whose copyright it names."""
    if not data:
        return None, False, []
    text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    lead = leading_comments(text)
    holders = [h.lower() for h in _HOLDER.findall(lead)]
    if _HAND.search(lead):
        return None, True, holders
    notices = f"{lead}\n{trailing_comments(text)}"
    flat = re.sub(r"\s*\n[\s/*#]*", " ", notices)  # a notice may be wrapped
    if _TOOL.search(notices) or _TOOL.search(flat):
        return "tool", False, holders
    if _ORIGIN.search(notices) or _ORIGIN.search(flat):
        return "origin", False, holders
    if _MODULE_TABLE.search(text):
        return "minified", False, holders
    code = _ANY_COMMENT.sub("", _STRING.sub(lambda m: m.group().replace("/", "_").replace("#", "_"), text))
    code = _HEADER_LINE.sub("", code)
    bare = _STRING.sub('""', code)
    if is_data(code.strip(), bare):
        return "data", False, holders
    if is_minified(code.strip(), bare):
        return "minified", False, holders
    return None, False, holders


def path_features(path: str) -> list[tuple[str, bool]]:
    """Patterns of a path and whether one alone may decide.

    ``tool-name`` a generator's extension or ending; ``dir:x`` a directory named x; ``pkg:x`` a directory x followed by a
    package directory (``name`` or ``name-1.2.3``) that holds further ones;
    ``ext:x`` the extension before the last (``a.pb.go``); ``end:x`` a mark
    after a hyphen (``a-min.js``); ``hash`` a digest as extension. Output of
    tools often lies beside hand-written files, so that a directory name alone
    does not decide; all others do.
    """
    parts = path.split("/")
    base, dirs = parts[-1], [d.lower() for d in parts[1:-1]]
    out = [(f"dir:{d}", False) for d in dirs]
    for depth in (1, 2):
        out += [(f"pkg:{'/'.join(dirs[i : i + depth])}", True) for i in range(len(dirs) - depth)]
    stem = base.split(".")
    named = any(mid.lower() in TOOL_EXTENSIONS for mid in stem[1:-1]) or stem[0].lower().endswith(tuple(TOOL_ENDINGS))
    out += [("tool-name", True)] * named
    for mid in stem[1:-1]:
        out.append(("hash", True) if re.fullmatch(r"[0-9a-f]{6,40}", mid) else (f"ext:{mid.lower()}", True))
    if m := re.search(r"[^-]-([a-z]+)$", stem[0].lower()):
        out.append((f"end:{m[1]}", True))
    return list(dict.fromkeys(out))


def behind(path: str, feature: str) -> str | None:
    """The directory behind a ``pkg:`` feature's directories."""
    want = feature[4:].split("/")
    dirs = path.split("/")[1:-1]
    low = [d.lower() for d in dirs]
    return next((dirs[i + len(want)] for i in range(len(dirs) - len(want)) if low[i : i + len(want)] == want), None)


def is_package(directory: str | None, holders: list[str]) -> bool:
    """A directory with a version, or named after the holder of the copyright."""
    name = re.sub(r"-v?\d+(\.\d+)+$", "", directory or "")
    return bool(directory) and (name != directory or name.lower() in holders)


def glob_regex(pattern: str, base: str = "", below: bool = True) -> re.Pattern | None:
    """A glob below directory ``base``; null if malformed.

    A pattern without an inner slash matches at any depth; ``**`` crosses
    directories, ``*`` and ``?`` do not. An exclude glob (``below``) covers
    what is below a directory that it matches and knows braces; an attribute
    glob speaks of files only, so that one that ends in a slash hits nothing.
    """
    p = pattern.strip()
    if not p or p.count("[") != p.count("]") or (below and p.count("{") != p.count("}")) or (not below and p.endswith("/")):
        return None
    anchored = "/" in p.rstrip("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[":
            j = p.index("]", i) if "]" in p[i:] else -1
            if j < 0:
                return None
            out, i = out + fnmatch.translate(p[i : j + 1]).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z"), j + 1
        elif p[i] == "\\" and not below and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        elif p[i] == "{" and below:
            j = p.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in p[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    prefix = re.escape(base + "/") if base else ""
    try:
        return re.compile(prefix + ("" if anchored else "(?:.*/)?") + out + ("(?:/.*)?" if below else ""))
    except re.error:
        return None


_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"(?:\s+|$)(.*)')
MARKS = ("linguist-generated", "linguist-vendored")


def parse_attributes(path: str, data: bytes | None) -> list[tuple[str, str, int, int, str, bool | None]]:
    """``(base, pattern, depth, line, name, state)`` of every attribute in an
    attribute file: set, unset (or false), or null where it is taken back to
    be unspecified. Patterns may be quoted. A line that defines a macro has
    the pattern ``[attr]`` and the macro's name behind it."""
    base = path.rpartition("/")[0]
    out = []
    for n, line in enumerate((data or b"").decode("utf-8", "replace").splitlines()):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if m := _QUOTED.match(line):
            pattern, words = re.sub(r"\\(.)", r"\1", m[1]), m[2].split()
        else:
            pattern, *words = line.split()
        for word in words:
            name, _, value = word.lstrip("-!").partition("=")
            state = None if word.startswith("!") else not word.startswith("-") and value.lower() != "false"
            out.append((base, pattern, base.count("/") + bool(base), n, name, state))
    return out


_SCAN = "file string, project string, sign string, by_hand boolean, features array<struct<name:string,decides:boolean>>, owned array<string>, notices array<bigint>, age timestamp_ntz, digest bigint"


_WORDING = re.compile(r"\p{L}[\p{L}']*")
_SPECIAL = re.compile(r"\S*[\d/_.@]\S*")


def wordings(data: bytes | None) -> list[int]:
    """Hashes of the words in a row of a file's leading and trailing comments,
    without names, numbers and links."""
    text = (data or b"").decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    out = set()
    for part in (leading_comments(text), trailing_comments(text)):
        words = _WORDING.findall(_SPECIAL.sub(" ", part).lower())
        out |= {xxhash.xxh64_intdigest(" ".join(words[i : i + NOTICE_WORDS])) - (1 << 63) for i in range(len(words) - NOTICE_WORDS + 1)}
    return sorted(out)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, data, age, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sign, by_hand, holders = evidence(data)
            features = path_features(path)
            owned = [f for f, _ in features if f.startswith("pkg:") and is_package(behind(path, f), holders)]
            rows.append((path, path.split("/")[0], sign, by_hand, [{"name": f, "decides": d} for f, d in features], owned, wordings(data), age, digest))
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], schema=_ARROW)


_NAMES = ["file", "project", "sign", "by_hand", "features", "owned", "notices", "age", "digest"]
_ARROW = pa.schema(
    [("file", pa.string()), ("project", pa.string()), ("sign", pa.string()), ("by_hand", pa.bool_()),
     ("features", pa.list_(pa.struct([("name", pa.string()), ("decides", pa.bool_())]))), ("owned", pa.list_(pa.string())),
     ("notices", pa.list_(pa.int64())), ("age", pa.timestamp("us")), ("digest", pa.int64())]
)


def scan_files(files: DataFrame) -> DataFrame:
    """Evidence and path features of each file, whole contents read where they
    lie; of several rows of a name the one changed last counts, of equally old
    ones that of the greatest hash. Contents are not shuffled."""
    age = F.col("mtime") if "mtime" in files.columns else F.lit(None)
    rows = files.select("file", F.col("content").cast("binary").alias("content"), age.cast("timestamp_ntz").alias("age"), F.xxhash64("content").alias("digest"))
    scanned = spread(rows.where(F.col("file").isNotNull()), "file").mapInArrow(_scan, _SCAN)
    rest = [c for c in _NAMES if c not in ("file", "age", "digest")]
    return scanned.groupBy("file").agg(F.max_by(F.struct(*rest), F.struct("age", "digest")).alias("r")).select("file", "r.*")


def mined_features(scanned: DataFrame, configs: DataFrame) -> DataFrame:
    """``name`` of the path features that signs keep hitting.

    A ``pkg:`` feature counts as hit where the directory behind it is a
    package. Only features that may decide alone are looked at; one that a
    configuration excludes needs less support.
    """
    hits = scanned.select("project", "sign", "owned", F.explode("features").alias("f")).where("f.decides").select(
        "project", F.col("f.name").alias("name"),
        F.when(F.col("f.name").startswith("pkg:"), F.array_contains("owned", F.col("f.name")))
        .otherwise(F.col("sign").isNotNull() | (F.col("f.name") == "tool-name")).alias("hit"),
    )
    per_project = hits.groupBy("name", "project").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("k"))
    per_name = per_project.groupBy("name").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k") > 0).alias("projects"))
    share = F.col("k") / F.col("n")
    enough = (F.col("k") >= MIN_FILES) & (F.col("projects") >= MIN_PROJECTS) & (share >= MIN_SHARE)
    excluded = F.col("excluded") & (F.col("k") >= EXCLUDED_FILES) & (share >= EXCLUDED_SHARE)
    named = F.col("name") == "tool-name"
    return per_name.where("k > 0").join(_excluded(configs), "name", "left").where(enough | excluded | named).select("name")


def _declared(files: DataFrame) -> DataFrame:
    """``file, marked`` of the files that attribute files speak about: of each
    attribute the deepest file's last matching line decides, and a file is
    marked if one of the two is set, unmarked if one is unset and none set.
    Macros hold below the directory whose attribute file defines them."""
    @F.pandas_udf("array<struct<base:string,pattern:string,depth:int,line:int,name:string,state:boolean>>")
    def parse(path: pd.Series, data: pd.Series) -> pd.Series:
        keys = ("base", "pattern", "depth", "line", "name", "state")
        return pd.Series([[dict(zip(keys, r, strict=True)) for r in parse_attributes(p, d)] for p, d in zip(path, data, strict=True)])

    @F.pandas_udf("boolean")
    def matches(path: pd.Series, base: pd.Series, pattern: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for p, b, g in zip(path, base, pattern, strict=True):
            if (b, g) not in known:
                known[b, g] = glob_regex(g, b, False)
            out.append(bool(known[b, g] and known[b, g].fullmatch(p)))
        return pd.Series(out)

    def above(df: DataFrame, path: str) -> DataFrame:
        """Each row with every directory above its path, from the top ("") on."""
        parts = F.split(path, "/")
        n = F.explode(F.sequence(F.lit(0), F.size(parts) - 1))
        return df.withColumn("_n", n).withColumn("base", F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "/")).drop("_n")

    own = files.where(F.element_at(F.split("file", "/"), -1) == ATTRIBUTE_FILE)
    order = F.struct(F.col("mtime") if "mtime" in files.columns else F.lit(0), F.xxhash64("content"))
    newest = own.groupBy("file").agg(F.max_by(F.struct("content"), order).alias("r")).select("file", F.col("r.content").cast("binary").alias("content"))
    lines = newest.select("file", F.explode(parse("file", "content")).alias("r")).select("file", "r.*")
    plain = lines.where(~F.col("pattern").startswith("[attr]"))
    macros = lines.where(F.col("pattern").startswith("[attr]") & F.col("name").isin(*MARKS)).select("base", F.substring("pattern", 7, 1 << 20).alias("macro"), F.col("name").alias("mark"), F.col("state").alias("given"))
    uses = above(plain.withColumnRenamed("base", "at"), "file").join(macros, "base").where(F.col("name") == F.col("macro"))
    by_macro = uses.where(F.col("state").isNull() | F.col("state")).select(F.col("at").alias("base"), "pattern", "depth", "line", F.col("mark").alias("name"), F.when(F.col("state"), F.col("given")).alias("state"))
    rules = plain.where(F.col("name").isin(*MARKS)).select("base", "pattern", "depth", "line", "name", "state").unionByName(by_macro)
    # each file meets only the rules of the directories above it
    met = above(files.select("file").where("file IS NOT NULL").distinct(), "file").join(rules, "base").where(matches("file", "base", "pattern"))
    final = met.groupBy("file", "name").agg(F.max_by(F.struct("state"), F.struct("depth", "line")).alias("r"))
    return final.groupBy("file").agg(F.max("r.state").alias("marked"))


def mined_notices(scanned: DataFrame, foreign: DataFrame) -> DataFrame:
    """``notice``: the wordings that files known to be foreign keep bearing, in
    several projects, and others hardly do."""
    told = scanned.where(~F.col("by_hand")).select("file", "project", F.explode("notices").alias("notice"))
    hits = told.join(foreign.select("file", F.lit(1).alias("hit")), "file", "left")
    per_project = hits.groupBy("notice", "project").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k"))
    per_notice = per_project.groupBy("notice").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k") > 0).alias("projects"))
    return per_notice.where((F.col("k") >= NOTICE_FILES) & (F.col("projects") >= NOTICE_PROJECTS) & (F.col("k") >= F.col("n") * NOTICE_SHARE)).select("notice")


def foreign_files(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``file, reason`` of every file not written by hand in its own project.

    ``reason``: ``declared`` (an attribute file marks it), ``tool``,
    ``origin``, ``minified``, ``data`` (its content shows it), ``pattern``
    (a mined path pattern) or ``notice`` (a mined wording). A file that says it is written by hand, or whose
    mark an attribute file takes back, is no case. Exclude patterns of
    ``configs`` count as hints only, as they hit hand-written files too: such
    a pattern is taken over if the files it hits anywhere show signs.
    Copies give one row, of different contents of a name the newest counts; null or empty contents are judged by their path;
    a null file name is skipped; empty tables give no rows.
    """
    scratch = Scratch(files.sparkSession, "provenance")
    scanned = scratch.cut(scan_files(files)).df
    names = scanned.select("file", F.explode("features").alias("f")).where("f.decides").select("file", F.col("f.name").alias("name"))
    by_path = names.join(mined_features(scanned, configs), "name").select("file").distinct().withColumn("pattern", F.lit(True))
    joined = scanned.select("file", "sign", "by_hand").join(by_path, "file", "left").join(_declared(files), "file", "left")
    reason: Column = (
        F.when(F.col("marked"), "declared")
        .when(~F.col("marked") | F.col("by_hand"), None)
        .when(F.col("sign").isNotNull(), F.col("sign"))
        .when(F.col("pattern"), "pattern")
    )
    found = scratch.cut(joined.select("file", reason.alias("reason"), (F.col("marked").isNull() & ~F.col("by_hand")).alias("open"))).df
    foreign = found.where("reason IS NOT NULL").select("file", "reason")
    told = scanned.select("file", F.explode("notices").alias("notice")).join(mined_notices(scanned, foreign), "notice").select("file").distinct()
    by_notice = found.where("reason IS NULL AND open").join(told, "file", "left_semi").select("file", F.lit("notice").alias("reason"))
    return foreign.unionByName(by_notice)


def _excluded(configs: DataFrame) -> DataFrame:
    """The path features that exclude globs of some project stand for."""
    glob = configs.select(F.explode("exclude").alias("glob"))
    name = (
        F.when(F.col("glob").rlike(r"^(\*\*/)?[\w.-]+/\*{1,2}$"), F.concat(F.lit("pkg:"), F.lower(F.regexp_extract("glob", r"([\w.-]+)/\*{1,2}$", 1))))
        .when(F.col("glob").rlike(r"^(\*\*/)?\*\.\w+\.\w+$"), F.concat(F.lit("ext:"), F.lower(F.regexp_extract("glob", r"\*\.(\w+)\.\w+$", 1))))
    )
    return glob.select(name.alias("name")).where("name IS NOT NULL").distinct().withColumn("excluded", F.lit(True))
