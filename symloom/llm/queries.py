"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import docpairs, languages, leakage, neighbours, provenance, tokenize
from symloom.plans.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_reasons(spark, sf).select("file")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.foreign_files(table(spark, sf, "source_files"), table(spark, sf, "configs"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf, "symbols"), table(spark, sf, "source_files"))


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.function_pairs(table(spark, sf, "symbols"), table(spark, sf, "source_files"))


def p3_source_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.source_pairs(table(spark, sf, "source_files"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(table(spark, sf, "vectors"), min_cosine=0.93, reach=0.998)
    return neighbours.similar_pairs(near, 0.93)


def p5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(table(spark, sf, "vectors"))
    return near.select("id", "neighbour", F.round("cosine", 6).alias("cosine"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = languages.mislabelled(languages.identify(table(spark, sf, "documents")))
    return found.select(F.col("doc").alias("doc_id"), "lang")


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = languages.identify(table(spark, sf, "documents")).select(F.col("doc").alias("doc_id"), F.explode("segments").alias("s"))
    return out.select("doc_id", "s.first", "s.n", "s.lang", "s.confidence", "s.counts")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p3_found, p3_pairs, p3_source_pairs, p5_found, p5_nearest, p7_ids, p8_found, p9_found, p9_segments)}
#: Brute force over all pairs of usable vectors.
_VECTORS = """
WITH n AS (SELECT id, vec, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM vectors WHERE id IS NOT NULL),
v AS (SELECT id, vec::DOUBLE[] AS v FROM n WHERE r = 1 AND len(vec) = 32 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND list_aggregate(list_transform(vec, lambda x: abs(x)), 'max') > 0),
c AS (SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM c)
SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM t WHERE r <= 10 AND s >= 0.93
"""
#: Every passage of thirteen words of every item sought in every document's letters and digits.
_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_replace(nfc_normalize(lower(text)), '[^\p{L}\p{N}]+', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(nfc_normalize(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
p AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(list_slice(w, k, k + 12), ''))) AS p FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM d JOIN p ON contains(d.s, p.p)
"""
ORACLE = {"p5_found": _VECTORS, "p8_found": _LEAKS}
