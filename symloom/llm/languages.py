"""The language of every document and of every segment of a mixed one.

Documents are cut into sentences of prose (code, dumps, identifiers, headings
and quotation marks are not prose). A sparse multinomial logistic regression
on TF-IDF weights of character n-grams is trained with the follow-the-
regularised-leader rule and elastic-net penalties on a bounded sample of
labelled sentences; documents whose label is contradicted by models that have
not seen them are dropped before. A temperature fitted on held-out sentences
turns scores into confidences. Inverse document frequencies are counted over
all documents.
"""

from __future__ import annotations

import re as plain_re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.plans.scratch import Scratch
from symloom.plans.tables import spread

#: The languages that texts may be in.
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "ja")
#: At most so many labelled sentences of each language, and of each document, fit the model.
FIT_SENTENCES, FIT_PER_DOCUMENT = 1_500, 12
#: Buckets of hashed n-grams, and the longest n-gram.
BUCKETS, LONGEST = 1 << 16, 4
#: Learning rate, its offset, lasso and ridge weight, passes.
ALPHA, BETA, LASSO, RIDGE, PASSES = 0.6, 1.0, 0.02, 0.05, 3
#: Examples whose gradients are taken at once, and characters that are scored at once.
TOGETHER, AT_ONCE = 32, 16_384
#: Labelled documents are judged by models of the other parts, so many times.
FOLDS, CLEANINGS = 4, 2
#: Share of held-out labels that calibration takes as unsure.
SMOOTH = 0.01
#: A sentence below this confidence takes the language of its neighbours.
UNSURE = 0.55
#: A segment below this mean confidence is in none of the languages.
DETERMINED, UNDETERMINED = 0.5, "und"

_POINTS = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200)]))


def _class(properties: str) -> str:
    """What a character class of properties holds, as plain ranges: the
    standard library scans those several times faster."""
    points = np.frombuffer("".join(re.findall(f"[{properties}]+", _POINTS, re.V1)).encode("utf-32-le"), np.uint32)
    first = np.nonzero(np.diff(points, prepend=-2) != 1)[0]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip(first, [*first[1:], len(points)], strict=True))


_CJK = _class(r"\p{Han}\p{Hiragana}\p{Katakana}")
_L, _LM = _class(r"\p{L}"), _class(r"\p{L}\p{M}")
_HIDDEN = plain_re.compile("[" + _class(r"\p{Cf}\p{Cc}--[\n\t\r]") + "]+")
_CONTROL = plain_re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_SPACE = plain_re.compile("[" + _class(r"\p{Zs}--[ ]") + "]")
_MARK = plain_re.compile(r"^[ \t]*(?:(?:///?|//!|/\*+!?|\*+/?|>+|--|;+)(?=\s|$)[ \t]*)+")
_HASH = plain_re.compile(r"^[ \t]*#+(?=\s|$)[ \t]*")
_FENCE = plain_re.compile(r"^[ \t]*(?:(?:[-*+•]|\d{1,3}[.)]|[a-z]+(?:\([\w./-]+\))?!?:)[ \t]+)?(`{3,}|~{3,})")
_ITEM = plain_re.compile(r"^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+")
_COMMIT = plain_re.compile(r"^[a-z]+(?:\([\w./-]+\))?!?:\s+(?=\S)")
_BROKEN = re.compile(r"(?<=\p{L})[-‐]\n(?=\p{Ll})")
_WRAPPED = plain_re.compile(rf"(?<=[{_CJK}、。])\n(?=[{_CJK}])")
# what is no prose within a line: quoted code, tags, addresses, paths, identifiers, numbers, brackets
_NO_PROSE_PARTS = r"`[^`\n]*`|<[^<>\n]{1,300}>|&\w{2,8};|https?://\S+|\S+@\S+\.\S+|\b[\w-]*(?:[_\\/.:]+[\w-]+)*_[\w-]*\b|\b%s\w*\b|[\w-]+(?:::|/|\\)[\w./\\-]+|\b\w+\.\w+(?:\.\w+)*\b(?!\.\s)|\b\w*\d\w*\b|\([^()\n]{0,80}\)|（[^（）\n]{0,80}）"
_NO_PROSE, _NO_PROSE_ASCII = re.compile(_NO_PROSE_PARTS % r"\p{L}+\p{Ll}\p{Lu}"), plain_re.compile(_NO_PROSE_PARTS % "[A-Za-z]+[a-z][A-Z]")
#: Without one of these there is nothing to take out.
_SUSPECT, _SUSPECT_ASCII = plain_re.compile(rf"[`<&@_/\\(（\d]|::|\S\.\S|[{_class(chr(92) + 'p{Ll}')}][{_class(chr(92) + 'p{Lu}')}]"), plain_re.compile(r"[`<&@_/\\(\d]|::|\w\.\w|[a-z][A-Z]")
_CALL_END = plain_re.compile(r"\w\(\S*\)\s*[{;:]?$")
_CODE_START = plain_re.compile(r"\s*(?:at\s+\S+\s*\(|@@|\+\+\+|---|diff --git|def |class |import |from \w+ import|func |fn |return\b.{0,40}$|if\s*\(|for\s*\()")
_ASSIGNED = plain_re.compile(r"\s*[\w.]+\s*:?=\s*\S+$")
_SENTENCE = plain_re.compile(r"[.!?…][\"”“»'’)\]]*\s+|[。！？][」』”\"）]*")
_WORD, _WORD_ASCII = plain_re.compile(rf"[{_L}][{_LM}'’-]*"), plain_re.compile(r"[A-Za-z][A-Za-z'-]*")
_FOUR_WORDS = plain_re.compile(rf"(?:[^{_L}]*+[{_L}][{_LM}'’-]*+){{4}}")
_IDEOGRAPH = plain_re.compile(f"[{_CJK}]")


def _tidy(text: str) -> str:
    """One kind of line end and of blank, nothing invisible."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return _CONTROL.sub("", text) if _CONTROL.search(text) else text
    return _SPACE.sub(" ", _HIDDEN.sub("", text))


def without_code(line: str) -> str:
    """The line without code, identifiers, numbers, links and what is in brackets."""
    if line.isascii():
        return _NO_PROSE_ASCII.sub(" ", line) if _SUSPECT_ASCII.search(line) else line
    return _NO_PROSE.sub(" ", line) if _SUSPECT.search(line) else line


def word_list(text: str) -> list[str]:
    return (_WORD_ASCII if text.isascii() else _WORD).findall(text)


def _may_be_code(line: str) -> bool:
    end = line.rstrip()[-1:]
    return (
        end in ("{", "}", ";") or "=>" in line or (")" in line and end in ("{", ":", ")") and _CALL_END.search(line) is not None)
        or _CODE_START.match(line) is not None or ("=" in line and _ASSIGNED.match(line) is not None)
    )


def _blocks(text: str) -> list[list[str]]:
    """The lines of prose, those that belong together in one block."""
    lines = _tidy(text).split("\n")
    lines = [_MARK.sub("", line) if line.lstrip(" \t")[:1] in ("/", "*", ">", "-", ";") else line for line in lines]
    comment = False
    if "#" in text:
        filled = [line for line in lines if line.strip()]
        hashes = sum(_HASH.match(line) is not None for line in filled)
        comment = hashes > 0.6 * len(filled) and hashes > 1
    blocks: list[list[str]] = [[]]
    fence = ""
    for line in lines:
        if comment:
            line = _HASH.sub("", line)
        if ("```" in line or "~~~" in line) and (m := _FENCE.match(line)):
            fence = "" if fence and m[1].startswith(fence) else fence or m[1][:3]
            blocks.append([])
            continue
        if fence:
            continue
        head = line.strip()[:1]
        if not head:
            blocks.append([])
            continue
        if head == "#" and not comment and (m := _HASH.match(line)):
            blocks.append([])
            line = line[m.end() :].strip()
            if len(line) <= 100 and not line.endswith((".", "!", "?", "。")):  # a heading
                continue
            head = line[:1]
        if (head in "-*+•" or head.isdigit()) and (m := _ITEM.match(line)):
            line = line[m.end() :]
            blocks.append([])
        if _may_be_code(line) and (line.isascii() or not _IDEOGRAPH.search(line)) and len(word_list(without_code(line))) < 6:
            blocks.append([])
            continue
        blocks[-1].append(line.strip())
    return blocks


def sentences(text: str | None) -> list[str]:
    """The sentences of prose of a text, in order."""
    out: list[str] = []
    if not text:
        return out
    ideographs = not text.isascii() and _IDEOGRAPH.search(text) is not None
    for block in _blocks(text):
        if block:
            joined = "\n".join(block)
            if "-\n" in joined or "‐\n" in joined:
                joined = _BROKEN.sub("", joined)
            if ":" in joined:
                joined = _COMMIT.sub("", joined)
            if ideographs:
                joined = _WRAPPED.sub("", joined)
            joined = joined.replace("\n", " ")
            start = 0
            for end in [*(m.end() for m in _SENTENCE.finditer(joined)), len(joined)]:
                if end > start:
                    plain = " ".join(without_code(joined[start:end]).split())
                    if is_prose(plain):
                        out.append(plain)
                    start = end
    return out


def is_prose(sentence: str) -> bool:
    if not sentence.isascii() and len(_IDEOGRAPH.findall(sentence)) >= 4:
        return True
    words = word_list(sentence)
    if len(words) < 3 or sum(map(len, words)) < 0.7 * (len(sentence) - sentence.count(" ")):
        return False
    plain = 0
    for w in words:
        plain += w[:1].islower() or len(w) == 1 or w.isupper()
        if plain >= 2:
            return True
    return False


def label_language(label: Column) -> Column:
    """The two-letter code that a label names, else null."""
    return F.lower(F.nullif(F.regexp_extract(label, r"^([A-Za-z]{2})(?:[-_](?:[A-Za-z]{2,8}|[0-9]{3}))*$", 1), F.lit("")))


@lru_cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter or a mark."""
    out = np.zeros(0x110000, bool)
    out[np.frombuffer(re.sub(r"[^\p{L}\p{M}]+", "", _POINTS).encode("utf-32-le"), np.uint32)] = True
    return out


class Grams(NamedTuple):
    """Hashed n-grams of several texts on end, by position."""

    starts: np.ndarray  # of each text, in positions
    buckets: np.ndarray  # (n-gram lengths, positions); BUCKETS where an n-gram would leave its text


def grams(texts: Sequence[str]) -> Grams:
    """N-grams of the texts' letters without case, with one blank between
    words and at either end of a text."""
    end, blank = ord("\n"), ord(" ")
    folded = unicodedata.normalize("NFKC", "\n".join(["", *(t.replace("\n", " ") for t in texts), ""])).casefold()
    chars = np.frombuffer(folded.encode("utf-32-le", "replace"), np.uint32)
    chars = np.where(letters()[chars] | (chars == end), chars, np.uint32(blank))
    chars = chars[~((chars == blank) & np.isin(np.concatenate([[0], chars[:-1]]), (blank, end)))]
    chars = chars[~((chars == blank) & (np.concatenate([chars[1:], [0]]) == end))]
    stops = chars == end
    starts = np.nonzero(stops)[0][:-1]
    n_all = len(chars) - 1
    chars = np.concatenate([np.where(stops, np.uint32(blank), chars), np.zeros(LONGEST, np.uint32)])
    stops = np.concatenate([stops, np.ones(LONGEST, bool)])
    buckets = np.empty((LONGEST, n_all), np.int64)
    h, whole = np.zeros(n_all, np.uint32), np.ones(n_all, bool)
    for n in range(1, LONGEST + 1):
        h = (h + chars[n - 1 : n - 1 + n_all] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n > 2:  # a text may end with the n-gram's last place, not before
            whole &= ~stops[n - 2 : n - 2 + n_all]
        buckets[n - 1] = np.where(whole, h >> np.uint32(16), BUCKETS)
    return Grams(starts, buckets)


class Rows(NamedTuple):
    """Sparse rows: those of row i are from ``bounds[i]`` to ``bounds[i + 1]``."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def take(self, which: np.ndarray) -> Rows:
        sizes = np.diff(self.bounds)[which]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.bounds[which] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return Rows(bounds, self.columns[at], self.values[at])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values[:, None] * weights[self.columns], self.bounds[:-1]) if len(self.columns) else np.zeros((0, weights.shape[1]))


def tf_idf(texts: Sequence[str], idf: np.ndarray) -> Rows:
    """Rows of length one; no text is without n-grams."""
    g = grams(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(g.starts, append=g.buckets.shape[1]))
    ok = g.buckets < BUCKETS
    keys, n = np.unique((owner * BUCKETS + g.buckets)[ok], return_counts=True)
    row, column = keys // BUCKETS, keys % BUCKETS
    values = n * idf[column]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    values = values / np.sqrt(np.maximum(np.add.reduceat(values * values, bounds[:-1]), 1e-9))[row]
    return Rows(bounds, column, values)


class Model(NamedTuple):
    languages: tuple[str, ...]
    idf: np.ndarray  # (buckets,)
    weights: np.ndarray  # (buckets, languages)
    temperature: float

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights times idf of every bucket, and squares of idf, each with a
        row of nothing at the end."""
        table = np.concatenate([self.idf[:, None] * self.weights, np.zeros((1, len(self.languages)))])
        return table.astype(np.float32), np.append(self.idf * self.idf, 0).astype(np.float32)

    def scores(self, texts: Sequence[str], lookup: tuple | None = None) -> np.ndarray:
        table, squares = lookup or self.lookup()
        g = grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        norm = np.zeros(len(texts))
        stops = np.append(g.starts[1:], g.buckets.shape[1])
        first = 0
        while first < len(texts):  # so many at once as the cache holds
            last = max(first + 1, int(np.searchsorted(stops, g.starts[first] + AT_ONCE, "right")))
            part = slice(g.starts[first], stops[last - 1])
            sums, squared = table.take(g.buckets[0, part], 0, mode="clip"), squares.take(g.buckets[0, part], mode="clip")
            for b in g.buckets[1:]:
                sums += table.take(b[part], 0, mode="clip")
                squared += squares.take(b[part], mode="clip")
            starts = g.starts[first:last] - g.starts[first]
            total[first:last], norm[first:last] = np.add.reduceat(sums, starts, axis=0), np.add.reduceat(squared, starts)
            first = last
        return total / np.sqrt(np.maximum(norm, 1e-9))[:, None]

    def confidence(self, texts: Sequence[str], lookup: tuple | None = None) -> np.ndarray:
        """Calibrated probabilities, one row a text."""
        if not texts:
            return np.zeros((0, len(self.languages)))
        return softmax(self.scores(texts, lookup) / self.temperature)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: Rows, labels: np.ndarray, n_classes: int, passes: int = PASSES, seed: int = 5) -> np.ndarray:
    """Weights by follow-the-regularised-leader with per-coordinate rates, the
    gradients of :data:`TOGETHER` examples taken at once."""
    z = np.zeros((BUCKETS, n_classes))
    n = np.zeros((BUCKETS, n_classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zz) * LASSO - zz
        return np.where(np.abs(zz) > LASSO, shrunk / ((BETA + np.sqrt(nn)) / ALPHA + RIDGE), 0.0)

    rng = np.random.default_rng(seed)
    eye = np.eye(n_classes)
    for _ in range(passes):
        order = rng.permutation(len(labels))
        mixed, y = rows.take(order), labels[order]
        for i in range(0, len(order), TOGETHER):
            bounds = mixed.bounds[i : i + TOGETHER + 1]
            columns, v = mixed.columns[bounds[0] : bounds[-1]], mixed.values[bounds[0] : bounds[-1]]
            found, at = np.unique(columns, return_inverse=True)
            zz, nn = z[found], n[found]
            w = weights(zz, nn)
            off = softmax(np.add.reduceat(v[:, None] * w[at], bounds[:-1] - bounds[0])) - eye[y[i : i + TOGETHER]]
            each = v[:, None] * np.repeat(off, np.diff(bounds), axis=0)
            g = np.stack([np.bincount(at, each[:, c], len(found)) for c in range(n_classes)], 1)
            rate = (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA
            z[found] = zz + g - rate * w
            n[found] = nn + g * g
    return weights(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least held-out log loss, the labels being taken as
    right in all but ``SMOOTH`` of the cases, lest a faultless sample makes
    every confidence one."""
    if not len(scores):
        return 1.0
    grid = np.geomspace(0.05, 20, 60)
    rows = np.arange(len(labels))

    def loss_at(t: float) -> float:
        log_p = np.log(np.maximum(softmax(scores / t), 1e-12))
        return -((1 - SMOOTH) * log_p[rows, labels] + SMOOTH * log_p.mean(1)).mean()

    loss = [loss_at(t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: Sequence[int], texts: Sequence[str], labels: Sequence[str], idf: np.ndarray) -> Model | None:
    """A calibrated model from labelled sentences, some labels being wrong.
    ``docs`` says which sentences belong together."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in labels])
    group = np.unique(np.asarray(docs), return_inverse=True)[1]
    part = (group * 2654435761 % 2**32) * FOLDS // 2**32
    rows = tf_idf(texts, idf)
    use = np.ones(len(y), bool)
    for _ in range(CLEANINGS):
        use = _trusted(rows, y, group, part, use, len(languages))
    held = part == 0 if len(set(part)) > 1 else np.zeros(len(y), bool)
    if len(set(y[use & ~held])) < len(languages):
        held = np.zeros(len(y), bool)
    weights = _trained(rows, y, use & ~held, len(languages))
    check = np.nonzero(use & held)[0]
    return Model(languages, idf, weights, fit_temperature(rows.take(check).times(weights), y[check]))


def _trained(rows: Rows, y: np.ndarray, use: np.ndarray, n_languages: int, passes: int = PASSES) -> np.ndarray:
    which = np.nonzero(use)[0]
    return train(rows.take(which), y[which], n_languages, passes)


def _trusted(rows: Rows, y: np.ndarray, group: np.ndarray, part: np.ndarray, use: np.ndarray, n_languages: int) -> np.ndarray:
    """Which sentences bear the label that models of the other parts give
    their whole document and themselves. A model that had seen a wrong label
    would repeat it, so each part is judged by the others."""
    p = np.zeros((len(y), n_languages))
    for k in set(part.tolist()):
        others = use & (part != k)
        mine = np.nonzero(part == k)[0]
        if not others.any():
            return use
        p[mine] = softmax(rows.take(mine).times(_trained(rows, y, others, n_languages, 1)))
    mean = np.zeros((group.max() + 1, n_languages))
    np.add.at(mean, group, p)
    out = (mean.argmax(1)[group] == y) & (p.argmax(1) == y)
    # a language of which nothing would remain keeps its labels
    for lang in set(y.tolist()) - set(y[out].tolist()):
        out |= y == lang
    return out


class Run(NamedTuple):
    """Sentences in a row of one language; ``sure`` of them are beyond doubt."""

    language: int
    first: int
    end: int
    sure: int
    confidence: float


def segments(p: np.ndarray, short: Sequence[bool] = (), unsure: float = UNSURE) -> list[Run]:
    """The runs of sentences of one language. An unsure or ``short`` sentence
    goes with the run before it, else after it, and does not make it longer."""
    if not len(p):
        return []
    best = p.argmax(1)
    sure = p.max(1) >= unsure
    if len(short):
        sure &= ~np.asarray(short, bool)
    if not sure.any():
        sure = np.ones(len(p), bool)
    known = np.nonzero(sure)[0]
    before = np.searchsorted(known, np.arange(len(p)), "right") - 1
    lang = best[known[np.maximum(before, 0)]]
    cuts = [0, *(np.nonzero(np.diff(lang))[0] + 1).tolist(), len(lang)]
    return [Run(int(lang[a]), a, b, int(sure[a:b].sum()), float(p[a:b, lang[a]][sure[a:b]].mean())) for a, b in zip(cuts, cuts[1:], strict=False)]


def is_short(sentence: str) -> bool:
    """Too short to tell a language from borrowed words."""
    return _FOUR_WORDS.match(sentence) is None and (sentence.isascii() or len(_IDEOGRAPH.findall(sentence)) < 6)


def counting_runs(runs: list[Run]) -> list[bool]:
    """Which runs say that the document is in their language: those of at
    least two sentences, or, if there is none, those of the language of most
    sentences."""
    if any(r.sure >= 2 for r in runs):
        return [r.sure >= 2 for r in runs]
    size: dict[int, tuple[int, float]] = {}
    for r in runs:
        n, c = size.get(r.language, (0, 0.0))
        size[r.language] = (n + r.sure, c + r.confidence)
    best = max(size, key=size.__getitem__, default=None)
    return [r.language == best for r in runs]


def _prepared(docs: DataFrame, doc: str, text: str, label: str) -> DataFrame:
    """``doc, named, sentences`` of every document with prose, and in rows of
    their own ``bucket, df``: in how many documents of a task it occurs."""
    kind = docs.schema[doc].dataType.simpleString()
    names = ["doc", "named", "sentences", "bucket", "df"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        ids, named = pa.null(), pa.string()
        for batch in batches:
            ids = batch.column(0).type
            for i in range(0, batch.num_rows, 256):
                cut = [sentences(t) for t in batch.column(2).slice(i, 256).to_pylist()]
                full = [n for n, parts in enumerate(cut) if parts]
                for j in range(0, len(full), 64):
                    some = [" ".join(cut[n]) for n in full[j : j + 64]]
                    g = grams(some)
                    seen = np.zeros(len(some) * (BUCKETS + 1), bool)
                    owner = np.repeat(np.arange(len(some)) * (BUCKETS + 1), np.diff(g.starts, append=g.buckets.shape[1]))
                    for b in g.buckets:
                        seen[owner + b] = True
                    df += seen.reshape(len(some), -1)[:, :-1].sum(0, dtype=np.uint8)
                at = pa.array(full, pa.int64())
                rows = batch.slice(i, 256).take(at)
                none = pa.nulls(len(full), pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([cut[n] for n in full], pa.list_(named)), none, none.cast(pa.int64())], names=names)
        found = np.nonzero(df)[0]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(found), ids), pa.nulls(len(found), named), pa.nulls(len(found), pa.list_(named)), pa.array(found.astype(np.int32)), pa.array(df[found])], names=names)

    rows = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), label_language(F.col(label)).alias("named"), F.col(text).alias("text"))
    return spread(rows, "doc").mapInArrow(run, f"doc {kind}, named string, sentences array<string>, bucket int, df bigint")


def _idf(counts: DataFrame, n: int) -> np.ndarray:
    """Inverse document frequencies from all documents; one row a bucket is collected."""
    found = counts.groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(BUCKETS)
    df[found["bucket"].to_numpy()] = found["df"].to_numpy()
    return (np.log((1 + n) / (1 + df)) + 1.0).astype(np.float32)


def _sample(prepared: DataFrame, languages: Sequence[str], per_language: int) -> tuple[list, list[str], list[str]]:
    one = prepared.where(F.col("named").isin(list(languages))).select("doc", "named", F.posexplode(F.slice("sentences", 1, FIT_PER_DOCUMENT)).alias("n", "sentence"))
    # thinned by a hash first, so that the window sees few rows of a language however many there are
    n = {r.named: r["count"] for r in one.groupBy("named").count().collect()}
    if not n:
        return [], [], []
    share = F.create_map(*[F.lit(x) for lang, c in n.items() for x in (lang, min(1.0, 1.5 * per_language / c))])
    thin = one.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < F.element_at(share, F.col("named")) * 1_000_000)
    order = Window.partitionBy("named").orderBy(F.xxhash64("doc"), "doc", "n")
    rows = thin.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("doc", "named", "sentence").toPandas()
    rows = rows.sort_values(["named", "doc", "sentence"], kind="stable")
    return rows["doc"].tolist(), rows["sentence"].tolist(), rows["named"].tolist()


def identify(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "lang", languages: Sequence[str] = LANGUAGES, per_language: int = FIT_SENTENCES,
    determined: float = DETERMINED,
) -> DataFrame:
    """``doc, named, segments`` of every document with prose.

    ``named`` is the language that its label names (null if none), ``segments``
    an array of ``lang, first, n, confidence, counts``: the runs of sentences
    of one language in order, the position of the first, how many, the mean
    calibrated confidence, and whether the document is in that language.
    Null, blank and code-only texts give no row, null ids are skipped, copies
    a row each; whole texts are read; an empty table gives no rows. A language
    without any labelled document cannot be recognised; a segment whose
    confidence is below ``determined`` is ``und``. Further columns are
    ignored. At most ``per_language`` sentences of each language fit the model.
    """
    scratch = Scratch(docs.sparkSession, "languages")
    written = scratch.cut(_prepared(docs, doc, text, label), n=F.count("sentences"))
    prepared = written.df.where("sentences IS NOT NULL").select("doc", "named", "sentences")
    kind = prepared.schema["doc"].dataType.simpleString()
    out = f"doc {kind}, named string, segments array<struct<lang:string,first:int,n:int,confidence:double,counts:boolean>>"
    model = fit(*_sample(prepared, languages, per_language), _idf(written.df.where("bucket IS NOT NULL"), written.seen["n"] or 0))
    if model is None:
        return docs.sparkSession.createDataFrame([], out)
    shared = docs.sparkSession.sparkContext.broadcast((model._replace(idf=None, weights=None), model.lookup()))
    item = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("n", pa.int32()), ("confidence", pa.float64()), ("counts", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lookup = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(2).to_pylist()
                flat = [s for parts in lists for s in parts]
                p, at, rows = m.confidence(flat, lookup), 0, []
                for parts in lists:
                    runs = segments(p[at : at + len(parts)], [is_short(x) for x in parts])
                    at += len(parts)
                    rows.append(
                        [
                            {"lang": m.languages[r.language] if r.confidence >= determined else UNDETERMINED, "first": r.first, "n": r.end - r.first, "confidence": round(r.confidence, 4), "counts": c}
                            for r, c in zip(runs, counting_runs(runs), strict=True)
                        ]
                    )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.list_(item))], names=["doc", "named", "segments"])

    return prepared.mapInArrow(run, out)


def mislabelled(identified: DataFrame) -> DataFrame:
    """``doc, lang, confidence``: one row per language of every document whose
    label does not name its language, and of every document in several. What
    is undetermined counts only where nothing else is there."""
    every = F.filter("segments", lambda s: s["counts"])
    known = F.filter(every, lambda s: s["lang"] != UNDETERMINED)
    counted = F.when(F.size(known) > 0, known).otherwise(every)
    langs = F.array_distinct(F.transform(counted, lambda s: s["lang"]))
    wrong = (F.size(langs) > 1) | F.col("named").isNull() | (F.col("named") != F.element_at(langs, 1))
    one = identified.where(wrong).select("doc", F.explode(counted).alias("s"))
    return one.groupBy("doc", F.col("s.lang").alias("lang")).agg((F.sum(F.col("s.confidence") * F.col("s.n")) / F.sum("s.n")).alias("confidence"))
