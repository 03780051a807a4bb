"""Scalar functions of the engine: ids, text cleaning, vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions.blake import hashes
from symloom.functions.keys import col

ID_CHARS, HASH_DIM = 32, 32


@F.pandas_udf(T.StringType())
def _hash_id(text: pd.Series) -> pd.Series:
    known = [t for t in text if t is not None]
    rows = iter(hashes([t.encode() for t in known]))
    return pd.Series([None if t is None else next(rows)[:16].tobytes().hex() for t in text], dtype="object")


def symbol_id(lang: str | Column, kind: str | Column, fqname: str | Column, file: str | Column) -> Column:
    """The id of a symbol: 32 hex characters of the hash of its four parts;
    null if a part is null."""
    parts = [col(c) for c in (lang, kind, fqname, file)]
    joined = F.concat(parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2], F.lit(":"), parts[3])
    return _hash_id(joined)


def parse_id(c: str | Column) -> Column:
    """The id in lower case, or null if the text is not 32 hex characters."""
    return F.when(col(c).rlike(f"^[0-9a-fA-F]{{{ID_CHARS}}}$"), F.lower(col(c)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """32 numbers from 0 to 1 out of a text's hash; null for a null text."""
    known = [t for t in text if t is not None]
    rows = iter(hashes([t.encode() for t in known]).astype(np.float32) / np.float32(255))
    return pd.Series([None if t is None else next(rows) for t in text], dtype="object")


def collapse_blanks(c: str | Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), r"\s+", " "))


def extension(path: str | Column) -> Column:
    """What follows the last dot of the file name; empty if there is none or
    the name only begins with one."""
    return F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors: product over the shorter length, whole norms, 0
    where a norm is 0, null where a vector is null."""
    a, b = (F.transform(col(x), lambda e: e.cast("double")) for x in (a, b))
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    both = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when(both > 0, dot / both).otherwise(0.0)


def tokens(c: str | Column) -> Column:
    """Words of a text in order: runs of letters and digits in lower case, none
    longer than 40 bytes; null for a null text."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= 40))
