"""Exact vector search and the vectors table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.embedders import Embedder, HashEmbedder
from symloom.functions.scalars import cosine

#: Queries that are sent to all tasks at once; more are taken block by block.
QUERY_BLOCK = 2_000


def index_names(symbols: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``id, vec``: the embedding of every symbol's name."""
    return symbols.select("id", (embedder or HashEmbedder()).column("name").alias("vec"))


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Old vectors without those of the new ids, and the new ones."""
    return vectors.join(new.select("id").distinct(), "id", "left_anti").unionByName(new.select(*vectors.columns))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``id, score``: the ``k`` vectors of highest cosine with the query,
    equal ones by id. A null vector or id is never found; a vector that holds
    a NaN scores NaN and is left out; other lengths compare over the shorter."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.round(cosine(F.col(vec), F.array(*[F.lit(float(x)) for x in query])), 9).alias("score"))
    return rows.where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), "id").limit(k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vec: str = "vec", block: int = QUERY_BLOCK) -> DataFrame:
    """``query, id, score``: exact ``k`` nearest other rows of every query row
    (same columns as ``vectors``), by cosine, equal ones by id.

    A stated set of queries is compared with all rows, block by block, so that
    never more than ``block`` queries are held at once; each task returns its
    best ``k`` of a query. Rows whose vector is null, has another length than
    the first query, is all zero, or holds a null or NaN are left out on
    either side. No queries, no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    clean = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).distinct()
    asked = clean(queries).withColumn("n", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")))
    asked = asked.withColumn("b", F.floor((F.col("n") - 1) * 64 / F.lit(block)).cast("int"))
    blocks = sorted(r.b for r in asked.select("b").distinct().collect())
    out = spark.createDataFrame([], f"query {kind}, id {kind}, score double")
    rows = clean(vectors)
    for b in blocks:
        held = asked.where(F.col("b") == b).select("id", "v").toPandas()
        dim = len(held["v"].iloc[0])
        ok = [len(v) == dim and all(e is not None and np.isfinite(e) for e in v) and any(v) for v in held["v"]]
        held = held[ok]
        if held.empty:
            continue
        q = np.stack([np.asarray(v, np.float64) for v in held["v"]])
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((held["id"].tolist(), q))

        def run(batches: Iterable[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            asked = None
            for batch in batches:
                asked = pa.array(ids, batch.column(0).type) if asked is None else asked
                vecs = batch.column(1)
                # of the right length first, so that the rest is one matrix; null elements become NaN
                of_length = np.diff(vecs.offsets.to_numpy()) == dim
                rows = batch.filter(pa.array(of_length))
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                ok = np.isfinite(x).all(1) & x.any(1)
                x, names = x[ok], rows.column(0).filter(pa.array(ok))
                if not len(x):
                    continue
                score = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
                take = min(k + 1, len(x))
                # every row that ties with the last one taken goes along
                edge = -np.partition(-score, take - 1, axis=1)[:, take - 1 : take]
                a, c = np.nonzero(score >= edge)
                mine, other = asked.take(pa.array(a)), names.take(pa.array(c))
                differ = pc.not_equal(mine, other)
                yield pa.RecordBatch.from_arrays([mine.filter(differ), other.filter(differ), pa.array(score[a, c]).filter(differ)], names=["query", "id", "score"])

        out = out.unionByName(rows.mapInArrow(run, f"query {kind}, id {kind}, score double"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return out.withColumn("r", rank).where(F.col("r") <= k).drop("r")
