"""Full-text search: postings, a query language, BM25.

A text field is cut into words (:func:`symloom.functions.scalars.tokens`), a
raw field is one term as it stands. Null texts have no words; they still are
documents of length 0.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.scalars import tokens

K1, B = 1.2, 0.75
SYMBOL_TEXT, SYMBOL_RAW = ("name", "fqname", "file_text", "signature"), ("file", "kind", "lang", "id")


class TextIndex(NamedTuple):
    """``postings``: field, term, id, tf, positions; ``lengths``: field, id,
    dl; ``stats``: field, n_docs, avg_dl (one row a field)."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame


def build_index(docs: DataFrame, text_fields: Sequence[str], raw_fields: Sequence[str] = (), id_col: str = "id") -> TextIndex:
    """Index whole texts. Ids must be unique; rows with a null id are left out."""
    words = [F.struct(F.lit(f).alias("field"), F.coalesce(tokens(f), F.array().cast("array<string>")).alias("words")) for f in text_fields]
    raw = [F.struct(F.lit(f).alias("field"), F.array_compact(F.array(F.col(f).cast("string"))).alias("words")) for f in raw_fields]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(*words, *raw)).alias("f")).select("id", "f.field", "f.words")
    lengths = rows.select("field", "id", F.size("words").alias("dl"))
    each = rows.select("id", "field", F.posexplode("words").alias("pos", "term"))
    postings = each.groupBy("field", "term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    stats = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    return TextIndex(postings, lengths, stats)


def index_symbols(symbols: DataFrame) -> TextIndex:
    """The eight fields of a symbol; its path is both a term and a text."""
    return build_index(symbols.withColumn("file_text", F.col("file")), SYMBOL_TEXT, SYMBOL_RAW)


def remove_documents(index: TextIndex, ids: DataFrame) -> TextIndex:
    """The index without the given ids (column ``id``)."""
    lengths = index.lengths.join(ids.select("id").distinct(), "id", "left_anti")
    stats = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    return TextIndex(index.postings.join(ids.select("id").distinct(), "id", "left_anti"), lengths, stats)


def add_documents(index: TextIndex, new: TextIndex) -> TextIndex:
    """The index with the documents of another, none of which it has yet."""
    lengths = index.lengths.unionByName(new.lengths)
    stats = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    return TextIndex(index.postings.unionByName(new.postings), lengths, stats)


class QueryError(ValueError):
    """The text is not a query."""


@dataclass
class Clause:
    """A leaf: words in a row of one of the fields, or a range of raw terms."""

    fields: tuple[str, ...]
    words: tuple[str, ...] = ()
    low: str | None = None
    high: str | None = None
    boost: float = 1.0


@dataclass
class Group:
    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    must_not: list = field(default_factory=list)
    boost: float = 1.0


_LEX = re.compile(r'\s*(?:(?P<op>[()+\-])|(?P<range>(?:(?P<rf>\w+):)?\[(?P<low>\S+) TO (?P<high>\S+)\])|(?P<term>(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()"^]+)))|(?P<open>\w+):(?=\())(?:\^(?P<boost>\d+(?:\.\d+)?))?')
_WORD = re.compile(r"[^\W_]+")


def parse_query(text: str, default_fields: Sequence[str], raw_fields: Sequence[str] = (), text_fields: Sequence[str] | None = None) -> Group:
    """``a b`` (either), ``+a -b``, ``a AND b``, ``NOT a``, ``(..)``, ``"a b"``,
    ``field:a``, ``field:[a TO b]``, ``a^2``. A word that falls into several
    is a phrase. Anything else raises :class:`QueryError`."""
    known = {*default_fields, *raw_fields, *(text_fields or ())}
    at, items = 0, []
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"not a query from character {at} on: {text[at:]!r}")
        items.append(m)
        at = m.end()
    pos = 0

    def leaf(m: re.Match) -> Clause | Group:
        name = m["rf"] if m["range"] else m["field"]
        if name is not None and name not in known:
            raise QueryError(f"unknown field {name!r}")
        fields = (name,) if name else tuple(default_fields)
        boost = float(m["boost"] or 1)
        if m["range"]:
            low, high = (None if x == "*" else x for x in (m["low"], m["high"]))
            return Clause(fields, low=low, high=high, boost=boost)
        raw = m["phrase"] if m["phrase"] is not None else m["word"]
        if name in raw_fields:
            return Clause(fields, (raw,), boost=boost)
        words = tuple(w for w in _WORD.findall(raw.lower()) if len(w.encode()) <= 40)
        return Clause(fields, words, boost=boost)

    def group() -> Group:
        nonlocal pos
        parts: list[tuple[str, object]] = []  # sign, node
        joins: list[str] = []
        sign, join = "", ""
        while pos < len(items):
            m = items[pos]
            word = m["word"] if m["term"] and not m["field"] and m["phrase"] is None else None
            if m["op"] == ")":
                break
            pos += 1
            if m["op"] in ("+", "-"):
                sign = m["op"]
                continue
            if word in ("AND", "OR"):
                if not parts:
                    raise QueryError(f"{word} without a left side")
                join = word
                continue
            if word == "NOT":
                sign = "-"
                continue
            if m["op"] == "(":
                node: object = group()
                if pos >= len(items) or items[pos]["op"] != ")":
                    raise QueryError("a bracket is not closed")
                node.boost = float(items[pos]["boost"] or 1)
                pos += 1
            elif m["open"]:
                raise QueryError("a field before a bracket")
            else:
                node = leaf(m)
            if parts:
                joins.append(join)
            parts.append((sign, node))
            sign, join = "", ""
        if sign or join:
            raise QueryError("an operator without a right side")
        out = Group()
        for i, (s, node) in enumerate(parts):
            tied = "AND" in ((joins[i - 1] if i else ""), (joins[i] if i < len(joins) else ""))
            (out.must_not if s == "-" else out.must if s == "+" or tied else out.should).append(node)
        return out

    tree = group()
    if pos < len(items):
        raise QueryError("a bracket was never opened")
    return tree


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _earlier(positions: Column, n: int) -> Column:
    return F.transform(positions, lambda p: p - n)


def _leaf_scores(index: TextIndex, leaves: list[Clause]) -> DataFrame | None:
    """``id, leaf, score``: the BM25 of every leaf, summed over its fields."""
    parts = []
    for n, leaf in enumerate(leaves):
        p = index.postings.where(F.col("field").isin(list(leaf.fields)))
        if leaf.low is not None or leaf.high is not None or not leaf.words:
            if not leaf.words and leaf.low is None and leaf.high is None:
                continue
            hit = p
            if leaf.low is not None:
                hit = hit.where(F.col("term") >= leaf.low)
            if leaf.high is not None:
                hit = hit.where(F.col("term") <= leaf.high)
            parts.append(hit.select("id").distinct().select("id", F.lit(n).alias("leaf"), F.lit(float(leaf.boost)).alias("score")))
            continue
        words = list(dict.fromkeys(leaf.words))
        hit = p.where(F.col("term").isin(words))
        df = hit.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).join(index.stats, "field")
        weight = df.groupBy("field").agg(
            F.sum(idf(F.col("n_docs"), F.col("df")) * F.element_at(F.create_map(*[F.lit(x) for w in words for x in (w, float(leaf.words.count(w)))]), F.col("term"))).alias("idf"),
            F.first("avg_dl").alias("avg_dl"),
        )  # one row a field
        if len(leaf.words) == 1:
            met = hit.select("field", "id", "tf")
        else:
            at = {w: F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(words)}
            row = hit.groupBy("field", "id").agg(*at.values())
            starts = None
            for i, w in enumerate(leaf.words):
                begin = _earlier(F.col(f"p{words.index(w)}"), i)
                starts = begin if starts is None else F.array_intersect(starts, begin)
            met = row.select("field", "id", F.size(starts).alias("tf")).where("tf > 0")
        scored = met.join(F.broadcast(weight), "field").join(index.lengths, ["field", "id"])
        bm25 = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
        parts.append(scored.groupBy("id").agg(F.sum(bm25 * float(leaf.boost)).alias("score")).select("id", F.lit(n).alias("leaf"), "score"))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(index: TextIndex, query: str | Group, limit: int | None = 20, default_fields: Sequence[str] = SYMBOL_TEXT, raw_fields: Sequence[str] = SYMBOL_RAW) -> DataFrame:
    """``id, score`` of the documents that a query finds, the best ``limit``
    of them (all if null), equal scores by id. A query without a positive part
    finds nothing. Scores are rounded to 9 decimals so that order is stable."""
    tree = query if isinstance(query, Group) else parse_query(query, default_fields, raw_fields)
    leaves: list[Clause] = []

    def plan(node: Clause | Group) -> tuple[Column, Column]:
        """Whether the node matches, and its score where it does."""
        if isinstance(node, Clause):
            leaves.append(node)
            c = F.col(f"s{len(leaves) - 1}")
            return c.isNotNull(), F.coalesce(c, F.lit(0.0))
        must, should, bad = ([plan(x) for x in part] for part in (node.must, node.should, node.must_not))
        if not must and not should:
            return F.lit(False), F.lit(0.0)
        match = F.lit(True)
        for m, _ in must:
            match &= m
        if not must:
            any_of = F.lit(False)
            for m, _ in should:
                any_of |= m
            match &= any_of
        for m, _ in bad:
            match &= ~m
        score = F.lit(0.0)
        for m, s in [*must, *should]:
            score += F.when(m, s).otherwise(0.0)
        return match, score * F.lit(float(node.boost))

    match, score = plan(tree)
    scores = _leaf_scores(index, leaves)
    if scores is None:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    wide = scores.groupBy("id").agg(*[F.sum(F.when(F.col("leaf") == i, F.col("score"))).alias(f"s{i}") for i in range(len(leaves))])
    out = wide.where(match).select("id", F.round(score, 9).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)
