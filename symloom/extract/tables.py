"""Extraction over a table of files, and plug-ins that add references."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.extract.model import Extraction
from symloom.extract.rules import Registry, extract
from symloom.functions.blake import hashes
from symloom.plans.tables import spread

#: Most symbols of one file; a file's position times this plus the symbol's is its order.
PER_FILE = 1 << 20
SYMBOL = (
    "id string, lang string, kind string, name string, name_ci string, fqname string, file string, start_byte long, end_byte long, "
    "start_line int, end_line int, signature string, doc string, ord long"
)
REFERENCE = "src string, to_name string, to_name_ci string, kind string, file string, ord long"
_S = pa.struct([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in SYMBOL.split(", "))])
_R = pa.struct([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (c.split() for c in REFERENCE.split(", "))])


def extracted(files: DataFrame, registry: Registry, innermost: bool = False, clean_names: bool = False) -> DataFrame:
    """``file, lang, status, symbols, refs`` of each file, in one pass.

    ``files`` has ``file``, ``content`` and, if known, ``pos`` (its place among
    all files, for a stable order). A null content gives status
    ``unreadable``, a path of no known language ``no_language``, a failure
    ``error``; none of them has symbols, and none stops the others.
    """
    has_pos = "pos" in files.columns
    schema = pa.schema([("file", pa.string()), ("lang", pa.string()), ("status", pa.string()), ("symbols", pa.list_(_S)), ("refs", pa.list_(_R))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, got = [], []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lang = registry.for_file(file)
                status, result = "no_language" if lang is None else "unreadable" if data is None else "ok", Extraction()
                if status == "ok":
                    try:
                        result = extract(file, data, lang, innermost, clean_names)
                    except Exception:  # noqa: BLE001  one file must not stop the others
                        status = "error"
                rows.append({"file": file, "lang": lang.id if lang else None, "status": status})
                got.append(result)
            # all names of a batch are hashed together
            ids = iter(hashes([f"{s.lang}:{s.kind}:{s.fqname}:{s.file}".encode() for r in got for s in r.symbols]))
            for row, result, pos in zip(rows, got, batch.column(2).to_pylist(), strict=True):
                row["symbols"], row["refs"] = _rows(row["file"], result, [next(ids)[:16].tobytes().hex() for _ in result.symbols], pos)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    asked = files.where("file IS NOT NULL").select("file", F.col("content").cast("binary").alias("content"), (F.col("pos") if has_pos else F.lit(0)).cast("long").alias("pos"))
    return spread(asked, "file").mapInArrow(run, f"file string, lang string, status string, symbols array<struct<{_ddl(SYMBOL)}>>, refs array<struct<{_ddl(REFERENCE)}>>")


def _ddl(columns: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in columns.split(", ")))


def _rows(file: str, got: Extraction, names: list[str], pos: int) -> tuple[list[dict], list[dict]]:
    symbols = [
        {"id": i, "lang": s.lang, "kind": s.kind, "name": s.name, "name_ci": s.name.lower(), "fqname": s.fqname, "file": s.file, "start_byte": s.start_byte, "end_byte": s.end_byte,
         "start_line": s.start_line, "end_line": s.end_line, "signature": s.signature, "doc": s.doc, "ord": pos * PER_FILE + n}
        for n, (i, s) in enumerate(zip(names, got.symbols, strict=True))
    ]
    refs = [{"src": names[r.owner], "to_name": r.to_name, "to_name_ci": r.to_name.lower(), "kind": r.kind, "file": file, "ord": pos * PER_FILE + n} for n, r in enumerate(got.references)]
    return symbols, refs


def symbols_of(done: DataFrame) -> DataFrame:
    """One row per id; of equal ids the last in order stays."""
    rows = done.select(F.explode("symbols").alias("s")).select("s.*")
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("r")).select("id", "r.*")


def references_of(done: DataFrame) -> DataFrame:
    return done.select(F.explode("refs").alias("r")).select("r.*")


def register_udtf(spark: SparkSession, registry: Registry, name: str = "extract_symbols") -> None:
    """``SELECT * FROM files, LATERAL extract_symbols(file, content)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="name string, kind string, fqname string, start_byte long, end_byte long, signature string, doc string")
    class ExtractSymbols:
        def eval(self, file: str, content: bytes):
            lang = registry.for_file(file) if file else None
            if lang and content is not None:
                for s in extract(file, bytes(content), lang).symbols:
                    yield s.name, s.kind, s.fqname, s.start_byte, s.end_byte, s.signature, s.doc

    spark.udtf.register(name, ExtractSymbols)


class EdgePattern(Protocol):
    """A plug-in: files and symbols to references (``src, to_name, kind, file``)."""

    name: str

    def apply(self, files: DataFrame, symbols: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RegexEdges:
    """References by a pattern over the text: one group is the name of a known
    symbol (case counts; of several the last in order), the other what it
    refers to. Contents that are not UTF-8 and empty groups give none."""

    name: str
    pattern: str
    edge_kind: str
    from_group: int = 1
    to_group: int = 2

    def __post_init__(self) -> None:
        if re.compile(self.pattern).groups < max(self.from_group, self.to_group):
            raise ValueError(f"{self.name}: the pattern has no such group")

    def apply(self, files: DataFrame, symbols: DataFrame) -> DataFrame:
        text: Column = F.expr("CASE WHEN is_valid_utf8(CAST(content AS STRING)) THEN CAST(content AS STRING) END")
        texts = files.where("content IS NOT NULL").select("file", F.col("content").cast("binary").alias("content")).select("file", text.alias("text"))
        both = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(self.pattern), g).alias(n) for g, n in ((self.from_group, "a"), (self.to_group, "b"))])
        pairs = texts.select("file", F.explode(both).alias("p")).select("file", F.col("p.a").alias("name"), F.col("p.b").alias("to_name"))
        last = symbols.groupBy("name").agg(F.max_by("id", "ord").alias("src"))
        return pairs.where("name <> '' AND to_name <> ''").join(last, "name").select("src", "to_name", F.lit(self.edge_kind).alias("kind"), "file")


@dataclass
class PluginRegistry:
    plugins: list[EdgePattern] = field(default_factory=list)

    def register(self, plugin: EdgePattern) -> None:
        self.plugins.append(plugin)

    def names(self) -> list[str]:
        return [p.name for p in self.plugins]

    def apply(self, files: DataFrame, symbols: DataFrame) -> DataFrame | None:
        """Only what the plug-ins add, in order of registration. A plug-in may
        give the id of the other end itself, as ``dst``."""
        parts = [p.apply(files, symbols) for p in self.plugins]
        parts = [p if "dst" in p.columns else p.withColumn("dst", F.lit(None).cast("string")) for p in parts]
        return reduce(DataFrame.unionByName, parts) if parts else None
