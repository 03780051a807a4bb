"""Evaluation items whose text occurs, whole or in part, in a corpus.

A passage of an item is ``min_words`` words in a row. Only letters and digits
are compared, so a passage is a string without blanks, and a document holds it
if its own letters and digits do. Passages are short and documents long, which
is where a MinHash of whole texts fails; so both are cut by size: passages
fall into size classes, and for a class whose passages have at least ``L``
characters documents are sketched by the MinHash of every stretch of ``L``
characters (its smallest hash of character shingles). Whatever holds a passage
holds every stretch of it and hence all their MinHashes: a document is a
candidate if it contains the sketch of the passage (and its first and last
shingle, which differ where only one word does), and no passage is lost.
Each passage is filed under the rarest of its sketch values. A filter of
bounded size tells the scan of the corpus which values are filed, so that
only documents that hold one, with their texts, ever leave it. Candidates are
verified by exact containment of the word shingle.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.plans.scratch import Scratch
from symloom.plans.tables import spread

MIN_WORDS = 13
#: Shortest passage of each size class, in characters; a passage has at least
#: as many characters as words, which is the first class.
SIZE_CLASSES = (13, 20, 28, 40)
#: Bits of the filters of sketch values: so many a value, and the least and most.
FILTER_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 12, 1 << 27
#: Where the bits of a value are taken from that say where it is in a filter.
SHIFTS = (0, 27)
#: Passages whose sketches together have at most so many values (8 bytes each)
#: are broadcast to the candidates; more are joined by a shuffle.
BROADCAST_VALUES = 1_000_000
#: Characters that are sketched at once.
CHUNK = 400_000

_TAG = re.compile(r"</?(?:p|br|b|i|em|strong|code|a|li|ul|ol|div|span|pre|h[1-6]|td|tr|th|table|tbody|thead|blockquote|q|u|s|sub|sup|tt|kbd|hr|mark|small)\b[^<>]{0,300}>", re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,31}\d{0,2}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_HIDDEN = re.compile(r"[\p{Cf}\p{Mn}\p{Me}]+")
_BROKEN = re.compile(r"(?<=\p{L})[-‐‑]\s*\n[^\p{L}\p{N}\n]*(?=\p{L})")
_WORD = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{N}]+")


def fold(text: str) -> str:
    """The text without case, markup and entities."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    return unicodedata.normalize("NFKC", text).casefold()


def words(text: str | None) -> list[str]:
    """The words that are compared: letters and digits without case. Markup,
    entities and invisible characters are dropped, broken words rejoined;
    where a script has no blanks every character is a word."""
    if not text:
        return []
    return _WORD.findall(_BROKEN.sub("", _HIDDEN.sub("", fold(text)).replace("\r\n", "\n")))


@lru_cache
def compared() -> np.ndarray:
    """For every code point whether it is part of words."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x34000)]))
    out = np.zeros(0x110000, bool)
    out[np.frombuffer("".join(_WORD.findall(every)).encode("utf-32-le"), np.uint32)] = True
    return out


def streams(texts: Sequence[str | None], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits of several texts on end, and where each ends:
    what :func:`words` gives, joined, for each of them."""
    plain = [fold(t) if t else "" for t in texts]
    chars = np.frombuffer("".join(plain).encode("utf-32-le", "replace"), np.uint32)
    kept = keep[chars]
    return chars[kept], np.concatenate([[0], np.cumsum(kept)])[np.cumsum([len(p) for p in plain])]


def shingle_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` characters, by doubling."""
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        done, power, have, have_power, size, got = None, None, chars.astype(np.uint64) + np.uint64(1), base, 1, 0
        while size <= k:
            if k & size:
                if done is None:
                    done, power, got = have, have_power, size
                else:
                    n = len(chars) - got - size + 1
                    done = done[:n] * have_power + have[got : got + n]
                    power, got = power * have_power, got + size
            n = len(have) - size
            if n <= 0 and size * 2 <= k:
                return np.empty(0, np.uint64)
            have, have_power, size = have[: max(n, 0)] * have_power + have[size:], have_power * have_power, size * 2
        h = done
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` neighbours, by doubling."""
    size, out = 1, values
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sketches(chars: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHashes of all stretches of ``least`` characters of several texts on
    end, with the number of the text; equal neighbours are given once."""
    if len(chars) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = (least + 1) // 2
    minima = window_minima(shingle_hashes(chars, k), least - k + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(minima)]
    new = np.arange(len(minima)) + least <= ends[text]
    new[1:] &= (minima[1:] != minima[:-1]) | (text[1:] != text[:-1]) | ~new[:-1]
    with np.errstate(over="ignore"):
        return text[new], (minima[new] + np.uint64(least)).view(np.int64)


def sketch(stream: str, least: int) -> np.ndarray:
    """MinHashes of all stretches of ``least`` characters of one text."""
    chars = np.frombuffer(stream.encode("utf-32-le", "replace"), np.uint32)
    return sketches(chars, np.array([len(chars)]), least)[1]


def shingles(chars: np.ndarray, least: int) -> np.ndarray:
    """Every value that a sketch of one text may have: those of all shingles."""
    with np.errstate(over="ignore"):
        return (shingle_hashes(chars, (least + 1) // 2) + np.uint64(least)).view(np.int64)


def size_classes(min_words: int) -> list[int]:
    return sorted({min_words, *(c for c in SIZE_CLASSES if c > min_words)})


def size_class(length: int, min_words: int = MIN_WORDS) -> int:
    return max(c for c in size_classes(min_words) if c <= length)


def passage_values(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """``(first word, size class, sketch values, first and last shingle)`` of
    every passage of a text."""
    w = words(text)
    for at in range(len(w) - min_words + 1):
        passage = "".join(w[at : at + min_words])
        least = size_class(len(passage), min_words)
        every = shingles(np.frombuffer(passage.encode("utf-32-le", "replace"), np.uint32), least)
        yield at, least, np.unique(sketch(passage, least)).tolist(), [int(every[0]), int(every[-1])]


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a filter may hold: all that it does, and few others."""
    out = np.ones(len(values), bool)
    for shift in SHIFTS:
        slot = (values.view(np.uint64) >> np.uint64(shift)) & np.uint64(len(bits) * 64 - 1)
        out &= (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return out


def make_filter(values: DataFrame, n: int) -> np.ndarray:
    """Two bits for each ``value``, by its lower bits, as the highest of a
    minimum are mostly zeros; at most 16 MB whatever ``n`` is. The executors
    put the words of the filter together."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * n - 1).bit_length())).bit_length() - 1
    slots = F.explode(F.array(*[F.shiftrightunsigned("value", s).bitwiseAND(F.lit((1 << width) - 1)) for s in SHIFTS]))
    word = values.select(slots.alias("slot")).distinct().groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    found = word.toArrow()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def held(doc_words: list[str], item_words: list[str], min_words: int = MIN_WORDS) -> bool:
    """Whether the document holds ``min_words`` words in a row of the item.
    A passage begins and ends where words do, but a word that is broken in
    the document may take two of its words."""
    stream = "".join(doc_words)
    edges: set[int] | None = None
    for at in range(len(item_words) - min_words + 1):
        passage = "".join(item_words[at : at + min_words])
        pos = stream.find(passage)
        while pos >= 0:
            if edges is None:
                edges = {0, *np.cumsum([len(x) for x in doc_words]).tolist()}
            if pos in edges and pos + len(passage) in edges:
                return True
            pos = stream.find(passage, pos + 1)
    return False


def _item_index(items: DataFrame, item: str, text: str, min_words: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``value, size, sketch, item``: every passage under the rarest of its
    values, and how many values there are."""
    schema = f"item {items.schema[item].dataType.simpleString()}, size int, heads array<bigint>, sketch array<bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, size, v, sorted({*v, *ends})) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, size, v, ends in passage_values(t, min_words)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], many), pa.array(cols[3], many)], names=["item", "size", "heads", "sketch"]
            )

    known = items.select(item, text).where(F.col(item).isNotNull() & F.col(text).isNotNull())
    passages = scratch.cut(known.mapInArrow(run, schema)).df
    values = passages.select("item", "size", "sketch", F.explode("heads").alias("value"))
    rarity = passages.select(F.explode("heads").alias("value"), "item").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_items"))
    rarest = F.min(F.struct("n_items", "value")).alias("best")
    filed = values.join(rarity, "value").groupBy("item", "size", "sketch").agg(rarest).select(F.col("best.value").alias("value"), "size", "sketch", "item")
    table = scratch.cut(filed, n=F.sum(F.size("sketch")))
    return table.df, table.seen["n"] or 0


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", min_words: int = MIN_WORDS, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Every pair of a document and an item of which it holds a passage.

    Columns ``doc`` and ``item`` (under their own names), one row a pair.
    Null, empty and blank texts hold nothing, items of fewer than
    ``min_words`` words have no passage, null ids are skipped. Whole texts of
    any length are read. Repeated rows give one pair; copies of a text under
    several ids give a pair each; empty tables give none; further columns are
    ignored. Neither texts nor sketch values are collected: the driver sees
    two filters of bounded size, and the plan is the same for any number of
    items. The corpus is read once and not shuffled; only candidates are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leakage")
    filed, n_values = _item_index(items, item, text, min_words, scratch)
    doc_type, item_type = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    sizes = sorted(r[0] for r in filed.select("size").distinct().collect())  # at most five
    if not sizes:
        return spark.createDataFrame([], f"`{doc}` {doc_type}, `{item}` {item_type}")
    heads = make_filter(filed.select("value"), n_values)
    wanted = spark.sparkContext.broadcast((heads, make_filter(filed.select(F.explode("sketch").alias("value")), n_values), compared()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, known, keep = wanted.value
        for batch in batches:
            lengths = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), np.int64)
            for part in _chunks(lengths):
                rows = batch.slice(part.start, part.stop - part.start)
                chars, ends = streams(rows.column(1).to_pylist(), keep)
                found = [sketches(chars, ends, size) for size in sizes]
                at, values = (np.concatenate(x) for x in zip(*found, strict=True))
                hit = in_filter(heads, values)
                at, values = at[hit], values[hit]
                picked = np.unique(at)
                if len(picked):
                    texts = [chars[ends[n - 1] if n else 0 : ends[n]] for n in picked]
                    every = [np.unique(np.concatenate([shingles(t, size) for size in sizes if len(t) >= size])) for t in texts]
                    many = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c).take(pa.array(picked)) for c in (0, 1)), pa.array([np.unique(values[at == n]) for n in picked], many), pa.array([v[in_filter(known, v)] for v in every], many)],
                        names=["doc", "text", "heads", "sketch"],
                    )

    whole = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.length(text).cast("long").alias("n")).where("doc IS NOT NULL AND text IS NOT NULL")
    hits = scratch.cut(spread(whole, "doc").mapInArrow(run, f"doc {doc_type}, text string, heads array<bigint>, sketch array<bigint>")).df
    index = F.broadcast(filed) if n_values <= broadcast_values else filed
    met = hits.select("doc", F.col("sketch").alias("have"), F.explode("heads").alias("value")).join(index, "value")
    # the document's sketch contains that of the whole passage
    pairs = met.where(F.size(F.array_except("sketch", "have")) == 0).select("doc", "item").distinct()
    texts = hits.select("doc", "text", F.xxhash64("text").alias("digest"), F.length("text").alias("n")).dropDuplicates(["doc", "digest", "n"]).select("doc", "text")
    item_texts = items.select(F.col(item).alias("item"), F.col(text).alias("item_text")).where("item IS NOT NULL AND item_text IS NOT NULL").distinct()
    open_pairs = pairs.join(item_texts, "item").join(texts, "doc").select("doc", "item", "text", "item_text")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        last: tuple[str | None, list[str]] = (None, [])
        for batch in batches:
            keep = []
            for t, i in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if t != last[0]:
                    last = (t, words(t))
                if i not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen[i] = words(i)
                keep.append(held(last[1], seen[i], min_words))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=[doc, item])

    return open_pairs.mapInArrow(verify, f"`{doc}` {doc_type}, `{item}` {item_type}").distinct()


def _chunks(lengths: np.ndarray) -> Iterator[slice]:
    """Rows in a row of about :data:`CHUNK` characters together, at least one."""
    start = 0
    while start < len(lengths):
        total = np.cumsum(lengths[start:])
        stop = start + max(1, int(np.searchsorted(total, CHUNK, "right")))
        yield slice(start, stop)
        start = stop
