"""Keys of the graph tables: compact ids, normalised kinds and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\u000b"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_kind(c: str | Column) -> Column:
    """Kinds compare trimmed and in lower case; null stays null."""
    return F.lower(F.btrim(col(c), F.lit(BLANKS)))


def pack_id(c: str | Column) -> Column:
    """An id as bytes, one to one: 32 lower-case hex characters take 17 bytes
    instead of 32 on every shuffle, any other text keeps its UTF-8 form."""
    c = col(c)
    return F.when(c.rlike("^[0-9a-f]{32}$"), F.concat(F.unhex(F.lit("00")), F.unhex(c))).otherwise(
        F.concat(F.unhex(F.lit("01")), F.encode(c, "UTF-8"))
    )


def unpack_id(c: str | Column) -> Column:
    """Inverse of :func:`pack_id`."""
    c = col(c)
    return F.when(F.substring(c, 1, 1) == F.unhex(F.lit("00")), F.lower(F.hex(F.substring(c, 2, 1 << 30)))).otherwise(
        F.decode(F.substring(c, 2, 1 << 30), "UTF-8")
    )


def clean_name(c: str | Column) -> Column:
    """A referred-to name without case and without blanks, quotes and angle
    brackets around it."""
    return F.lower(F.regexp_replace(col(c), "^[\\s'\"`<>]+|[\\s'\"`<>]+$", ""))


# Short forms of kind names.
SHORT_KINDS = {
    "fn": "function", "func": "function", "fun": "function", "def": "function", "meth": "method", "var": "variable", "const": "constant",
    "mod": "module", "cls": "class", "iface": "interface", "call": "calls", "import": "imports",
}


def full_kind(c: str | Column) -> Column:
    """The cleaned kind with short forms spelled out."""
    kind = clean_kind(c)
    pairs = [F.lit(x) for pair in SHORT_KINDS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), kind)


def plain_path(c: str | Column) -> Column:
    """A path with forward slashes and no leading ``./``."""
    return F.regexp_replace(F.replace(col(c), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
