"""Queries of the engine's operators over the code-graph tables, each with the
SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.extract.rules import Registry
from symloom.extract.tables import RegexEdges, extracted, references_of, symbols_of
from symloom.functions.keys import clean_kind, clean_name, full_kind, plain_path
from symloom.functions.scalars import collapse_blanks, extension, hash_embedding, symbol_id, tokens
from symloom.operators import deltas, fulltext, graph, vectors
from symloom.plans.index import newest_files, with_positions
from symloom.plans.tables import table
from symloom.streaming import watch

SNAPSHOT = "2024-04-15 00:00:00"


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "symbols").withColumn("kind", full_kind("kind")).withColumn("file", plain_path("file"))
    return rows


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return graph.current_symbols(_symbols(spark, sf))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "edges").withColumn("kind", clean_kind("kind")).select("src", "dst", "kind", "seq")


def current_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _current(spark, sf).select("id", "name", "kind", "lang", "file")


def get_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return graph.get_symbols(_current(spark, sf), table(spark, sf, "vectors")).select("id", "name", "kind")


def find_substring(spark: SparkSession, sf: str) -> DataFrame:
    return graph.find(_current(spark, sf), "Shift").select("id", "name")


def find_exact_ci(spark: SparkSession, sf: str) -> DataFrame:
    return graph.find(_current(spark, sf), "RUN", exact=True).select("id", "name")


def find_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return graph.find(_current(spark, sf), "e", kind="method", lang="python").select("id", "name")


def callers(spark: SparkSession, sf: str) -> DataFrame:
    now = _current(spark, sf)
    return graph.linked(_edges(spark, sf), now, now)


def callees(spark: SparkSession, sf: str) -> DataFrame:
    now = _current(spark, sf)
    return graph.linked(_edges(spark, sf), now, now, incoming=False)


def callers_newest_kind(spark: SparkSession, sf: str) -> DataFrame:
    now = _current(spark, sf)
    return graph.linked(_edges(spark, sf), now, now, newest_kind=True)


def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    return graph.resolve_names(_current(spark, sf), table(spark, sf, "refs").select(clean_name("to_name").alias("name")))


def insert_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.insert_edges(_edges(spark, sf), _current(spark, sf))


def _removed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    gone = table(spark, sf, "source_files").where("status <> 'ok'")
    return graph.remove_files(_current(spark, sf), _edges(spark, sf), gone)


def remove_files_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _removed(spark, sf)[0].select("id", "file")


def remove_files_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _removed(spark, sf)[1].select("src", "dst", "kind", "seq")


def index_status(spark: SparkSession, sf: str) -> DataFrame:
    return graph.counts(_current(spark, sf), _edges(spark, sf))


def resolve_refs(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "refs").withColumn("to_name", clean_name("to_name")).withColumn("file", plain_path("file"))
    return graph.resolve_references(refs, _current(spark, sf))


def _center(spark: SparkSession, sf: str) -> str:
    return table(spark, sf, "edges").agg(F.min("src")).first()[0]


def neighborhood_d2(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighborhood(_edges(spark, sf), _center(spark, sf), 2).nodes


def neighborhood_capped(spark: SparkSession, sf: str) -> DataFrame:
    return graph.capped_neighborhood(_edges(spark, sf), _center(spark, sf), 3, 50).nodes


def member_owner(spark: SparkSession, sf: str) -> DataFrame:
    now = _current(spark, sf).select("id", "kind", "file", "ord", F.col("start_byte").alias("start"), F.col("end_byte").alias("stop"))
    sites = now.where("kind IN ('method', 'field')").select(F.col("id").alias("site"), "file", F.col("start").alias("at"))
    return deltas.attribute_sites(now.where("kind NOT IN ('method', 'field', 'module')"), sites)


def kind_forms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "symbols").select(F.col("kind").alias("spelled"), full_kind("kind").alias("kind"))
    return rows.groupBy("spelled", "kind").agg(F.count(F.lit(1)).alias("n"))


def symbol_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _current(spark, sf).select("id", symbol_id("lang", "kind", "fqname", "file").alias("computed"))


def collapse_ws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", collapse_blanks("text").alias("text"))


def file_extensions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").select("file").distinct().groupBy(extension("file").alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("doc_id", F.explode(tokens("text")).alias("term"))
    return words.groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count(F.lit(1)).alias("cf"))


def _documents(spark: SparkSession, sf: str) -> fulltext.TextIndex:
    return fulltext.build_index(table(spark, sf, "documents"), ["text"], ["lang", "source"], "doc_id")


def _search(spark: SparkSession, sf: str, query: str, limit: int | None = 20) -> DataFrame:
    out = fulltext.search(_documents(spark, sf), query, limit, ["text"], ["lang", "source"])
    return out.select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.index_symbols(_current(spark, sf)).postings.select("field", "term", "id", "tf", F.element_at("positions", 1).alias("first_at"))


def bm25_all(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "parser schedule search", None)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "parser search")


def bm25_field(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "+lang:en search", None)


def phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, '"of the"', None)


def boolean_search(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "(parser OR ring) AND search -builder", None)


def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    out = fulltext.search(fulltext.index_symbols(_current(spark, sf)), "kind:function parser", None)
    return out.select("id", F.round("score", 4).alias("score"))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    query = _units(spark, sf).orderBy("id").first().vec
    return vectors.top_k(_units(spark, sf), query, 10).select("id", F.round("score", 4).alias("score"))


def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = _units(spark, sf)
    return vectors.search(rows, rows.where("id % 20 = 0"), 10).select("query", "id", F.round("score", 4).alias("score"))


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return _current(spark, sf).select("id", hash_embedding("name").alias("vec"))


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = _symbols(spark, sf)
    at = F.lit(SNAPSHOT).cast("timestamp_ntz")
    state = lambda df: graph.current_symbols(df.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))).select("id", F.concat_ws("|", "file", F.coalesce("signature", F.lit("")), F.coalesce("doc", F.lit(""))).alias("state"))
    return deltas.snapshot_diff(state(rows.where(F.col("indexed_at") < at)), state(rows), "id", "state")


def mtime_filter(spark: SparkSession, sf: str) -> DataFrame:
    moment = "2024-03-15 00:00:00"
    rows = table(spark, sf, "source_files").withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
    return deltas.changed_since(rows, F.lit(moment).cast("timestamp_ntz")).select("file").distinct()


def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = deltas.sessions(table(spark, sf, "events"), "user_id", "ts", "30 minutes")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    files = with_positions(newest_files(table(spark, sf, "source_files")))
    return extracted(files, Registry.load())


def extract_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols_of(_extracted(spark, sf)).drop("name_ci")


def extract_refs(spark: SparkSession, sf: str) -> DataFrame:
    return references_of(_extracted(spark, sf)).drop("to_name_ci")


def extract_status(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"))


def plugin_edges(spark: SparkSession, sf: str) -> DataFrame:
    """References from imports of a file to the module they name, by pattern."""
    files = newest_files(table(spark, sf, "source_files"))
    plugin = RegexEdges("returns", r"(?:func|fn|def|function) (\w+)\([^{:]*?(?:->|:) ?(\w+)", "returns")
    return plugin.apply(files, symbols_of(_extracted(spark, sf)))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    stream = watch.read_stream(spark, path, spark.read.parquet(path).schema)
    out = watch.run_available(watch.session_stream(stream, "user_id", "ts"))
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def supply_callers(spark: SparkSession, sf: str) -> DataFrame:
    """Who is called by whom where orders contain parts: parallel edges, bigger tables."""
    edges = table(spark, sf, "lineitem").select(
        F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("long").alias("seq")
    )
    orders = table(spark, sf, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    parts = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"))
    return graph.linked(edges, orders, parts)


QUERIES = {
    f.__name__: f
    for f in (
        current_symbols, get_symbol, find_substring, find_exact_ci, find_filtered, callers, callees, callers_newest_kind, resolve_names, insert_edges,
        remove_files_symbols, remove_files_edges, index_status, resolve_refs, neighborhood_d2, neighborhood_capped, member_owner, kind_forms,
        symbol_ids, collapse_ws, file_extensions, term_stats, postings, bm25_all, bm25_topk, bm25_field, phrase, boolean_search, symbol_search,
        vector_topk, vector_search, hash_embed, snapshot_diff, mtime_filter, debounce_sessions, supply_callers,
        extract_symbols, extract_refs, extract_status, plugin_edges, stream_sessions,
    )
}

_TRIM = "lower(trim({}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)))"
_PATH = "regexp_replace(replace({}, chr(92), '/'), '^(\\./)+', '')"
_KIND = f"CASE {_TRIM.format('kind')} WHEN 'fn' THEN 'function' WHEN 'func' THEN 'function' WHEN 'fun' THEN 'function' WHEN 'def' THEN 'function' WHEN 'meth' THEN 'method' WHEN 'var' THEN 'variable' WHEN 'const' THEN 'constant' WHEN 'mod' THEN 'module' WHEN 'cls' THEN 'class' WHEN 'iface' THEN 'interface' ELSE {_TRIM.format('kind')} END"
_ALL = f"SELECT * REPLACE ({_KIND} AS kind, {_PATH.format('file')} AS file) FROM symbols"
_CUR = f"cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, ord DESC) AS r FROM ({_ALL}) WHERE id IS NOT NULL) WHERE r = 1 AND deleted_at IS NULL)"
_E = f"e AS (SELECT src, dst, {_TRIM.format('kind')} AS kind, seq FROM edges)"
_NAME = r"regexp_replace(lower({}), '^[\s''\"`<>]+|[\s''\"`<>]+$', '', 'g')"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND strlen(x) <= 40)"
_DOCS = f"""d AS (SELECT doc_id, lang, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
l AS (SELECT doc_id, lang, len(w) AS dl, w FROM d), s AS (SELECT count(*) AS n, avg(dl) AS av FROM l),
t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM l),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))"
_SCORED = f"sc AS (SELECT doc_id, lang, term, {_BM25} AS sc FROM tf JOIN df USING (term) JOIN l USING (doc_id) CROSS JOIN s)"


def _linked_sql(mine: str, other: str, kind: str = "e.kind") -> str:
    return f"WITH {_CUR}, {_E} SELECT e.{mine} AS id, e.{other} AS other, o.name, {kind} AS edge_kind FROM e JOIN cur o ON o.id = e.{other} WHERE e.{mine} IN (SELECT id FROM cur)"


_GONE = "gone AS (SELECT id FROM cur WHERE file IN (SELECT file FROM source_files WHERE status <> 'ok'))"
_STATE = "(SELECT id, concat_ws('|', file, coalesce(signature, ''), coalesce(doc, '')) AS state FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, ord DESC) AS r FROM ({}) WHERE id IS NOT NULL) WHERE r = 1)"

ORACLE = {
    "current_symbols": f"WITH {_CUR} SELECT id, name, kind, lang, file FROM cur",
    "get_symbol": f"WITH {_CUR} SELECT id, name, kind FROM cur WHERE id IN (SELECT id FROM vectors)",
    "find_substring": f"WITH {_CUR} SELECT id, name FROM cur WHERE contains(lower(name), 'shift')",
    "find_exact_ci": f"WITH {_CUR} SELECT id, name FROM cur WHERE lower(name) = 'run'",
    "find_filtered": f"WITH {_CUR} SELECT id, name FROM cur WHERE contains(lower(name), 'e') AND kind = 'method' AND lang = 'python'",
    "callers": _linked_sql("dst", "src"),
    "callees": _linked_sql("src", "dst"),
    "callers_newest_kind": _linked_sql("dst", "src", "first_value(e.kind) OVER (PARTITION BY e.dst, e.src ORDER BY e.seq DESC)"),
    "resolve_names": f"""WITH {_CUR}, a AS (SELECT DISTINCT {_NAME.format('to_name')} AS asked FROM refs),
        x AS (SELECT asked, id, row_number() OVER (PARTITION BY asked ORDER BY name = asked DESC, starts_with(lower(name), lower(asked)) DESC, length(name), ord, id) AS r
              FROM a JOIN cur ON contains(lower(name), lower(asked)) WHERE asked <> '')
        SELECT asked, id FROM x WHERE r = 1""",
    "insert_edges": f"WITH {_CUR}, {_E} SELECT src, dst, kind, seq FROM e WHERE src IN (SELECT id FROM cur) AND dst IN (SELECT id FROM cur)",
    "remove_files_symbols": f"WITH {_CUR}, {_GONE} SELECT id, file FROM cur WHERE id NOT IN (SELECT id FROM gone)",
    "remove_files_edges": f"WITH {_CUR}, {_GONE}, {_E} SELECT src, dst, kind, seq FROM e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.src) AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.dst)",
    "index_status": f"WITH {_CUR}, {_E} SELECT 'symbol' AS what, kind, count(*) AS n FROM cur GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind",
    "resolve_refs": f"""WITH {_CUR}, q AS (SELECT DISTINCT ref_seq, src, kind, {_PATH.format('file')} AS file, {_NAME.format('to_name')} AS nm FROM refs),
        x AS (SELECT q.src, cur.id AS dst, q.kind, q.ref_seq, row_number() OVER (PARTITION BY q.ref_seq ORDER BY CASE WHEN cur.file = q.file THEN 0 ELSE 1 END, cur.ord, cur.id) AS r
              FROM q JOIN cur ON lower(cur.name) = q.nm WHERE q.nm <> '' AND q.src IN (SELECT id FROM cur))
        SELECT src, dst, kind, ref_seq FROM x WHERE r = 1""",
    "neighborhood_d2": f"""WITH RECURSIVE {_E}, u AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
        r AS (SELECT min(src) AS id, 0 AS depth FROM edges UNION SELECT u.b, r.depth + 1 FROM r JOIN u ON u.a = r.id WHERE r.depth < 2)
        SELECT id, min(depth)::INT AS depth FROM r GROUP BY id""",
    "member_owner": f"""WITH {_CUR}, x AS (SELECT m.id AS site, o.id AS owner, row_number() OVER (PARTITION BY m.id ORDER BY o.ord, o.id) AS r
        FROM cur m JOIN cur o ON o.file = m.file AND m.start_byte >= o.start_byte AND m.start_byte < o.end_byte
        WHERE m.kind IN ('method', 'field') AND o.kind NOT IN ('method', 'field', 'module')) SELECT site, owner FROM x WHERE r = 1""",
    "kind_forms": f"SELECT kind AS spelled, {_KIND} AS kind, count(*) AS n FROM symbols GROUP BY ALL",
    "symbol_ids": f"WITH {_CUR} SELECT id, id AS computed FROM cur",
    "collapse_ws": r"SELECT doc_id, trim(regexp_replace(text, '[\s\v]+', ' ', 'g'), ' ') AS text FROM documents",
    "file_extensions": r"SELECT regexp_extract(file, '[^/]\.([^./]+)$', 1) AS ext, count(*) AS n FROM (SELECT DISTINCT file FROM source_files) GROUP BY ext",
    "term_stats": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY term",
    "postings": f"""WITH {_CUR}, f AS (SELECT id, 'name' AS field, {_WORDS.format('name')} AS w FROM cur UNION ALL SELECT id, 'fqname', {_WORDS.format('fqname')} FROM cur
        UNION ALL SELECT id, 'file_text', {_WORDS.format('file')} FROM cur UNION ALL SELECT id, 'signature', {_WORDS.format('signature')} FROM cur
        UNION ALL SELECT id, 'file', [file] FROM cur UNION ALL SELECT id, 'kind', [kind] FROM cur UNION ALL SELECT id, 'lang', [lang] FROM cur UNION ALL SELECT id, 'id', [id] FROM cur)
        SELECT field, term, id, count(*) AS tf, min(p) AS first_at FROM (SELECT field, id, unnest(w) AS term, unnest(range(len(w))) AS p FROM f) WHERE term IS NOT NULL GROUP BY field, term, id""",
    "bm25_all": f"WITH {_DOCS}, {_SCORED} SELECT doc_id, round(sum(sc), 4) AS score FROM sc WHERE term IN ('parser', 'schedule', 'search') GROUP BY doc_id",
    "bm25_topk": f"WITH {_DOCS}, {_SCORED} SELECT doc_id, round(s9, 4) AS score FROM (SELECT doc_id, round(sum(sc), 9) AS s9 FROM sc WHERE term IN ('parser', 'search') GROUP BY doc_id ORDER BY s9 DESC, doc_id LIMIT 20)",
    "bm25_field": f"""WITH {_DOCS}, {_SCORED}, r AS (SELECT count(*) AS nl, avg(CASE WHEN lang IS NULL THEN 0.0 ELSE 1.0 END) AS al, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS dfl FROM l)
        SELECT doc_id, round(ln(1 + (nl - dfl + 0.5) / (dfl + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 / al)) + coalesce((SELECT sum(sc) FROM sc WHERE sc.doc_id = l.doc_id AND term = 'search'), 0), 4) AS score
        FROM l CROSS JOIN r WHERE lang = 'en'""",
    "phrase": f"""WITH {_DOCS}, ph AS (SELECT a.doc_id, count(*) AS tf FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id),
        i AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df CROSS JOIN s WHERE term IN ('of', 'the'))
        SELECT doc_id, round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 4) AS score FROM ph JOIN l USING (doc_id) CROSS JOIN s CROSS JOIN i""",
    "boolean_search": f"""WITH {_DOCS}, {_SCORED} SELECT doc_id, round(sum(CASE WHEN term <> 'builder' THEN sc ELSE 0 END), 4) AS score FROM sc WHERE term IN ('parser', 'ring', 'search', 'builder') GROUP BY doc_id
        HAVING count(CASE WHEN term IN ('parser', 'ring') THEN 1 END) > 0 AND count(CASE WHEN term = 'search' THEN 1 END) > 0 AND count(CASE WHEN term = 'builder' THEN 1 END) = 0""",
    "vector_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT id, round(s, 4) AS score FROM (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS s FROM embeddings CROSS JOIN q ORDER BY s DESC, vec_id LIMIT 10)",
    "vector_search": """SELECT query, id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM
        (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE r <= 10""",
    "snapshot_diff": f"WITH o AS {_STATE.format(_ALL + f' WHERE indexed_at < TIMESTAMP {SNAPSHOT!r}')}, n AS {_STATE.format(_ALL)} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'A' WHEN n.id IS NULL THEN 'D' ELSE 'M' END AS change FROM o FULL OUTER JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.state <> n.state",
    "mtime_filter": "SELECT DISTINCT file FROM source_files WHERE mtime > TIMESTAMP '2024-03-15 00:00:00'",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        h AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM h GROUP BY user_id, s""",
    "supply_callers": "SELECT 'P' || l_partkey AS id, 'O' || l_orderkey AS other, o_orderpriority AS name, l_returnflag AS edge_kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part)",
}
ORACLE["stream_sessions"] = ORACLE["debounce_sessions"]


def _level(d: int, cap: int) -> str:
    """Nodes met at depth ``d``: of those before, taken in order, each is
    expanded unless ``cap`` nodes are known by then."""
    return f"""
    w{d} AS (SELECT f.pos, 0 AS side, -x.seq AS age, x.dst AS near FROM f{d - 1} f JOIN x ON x.src = f.id UNION ALL SELECT f.pos, 1, -x.seq, x.src FROM f{d - 1} f JOIN x ON x.dst = f.id),
    o{d} AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY pos, side, age) AS r FROM w{d} WHERE near NOT IN (SELECT id FROM k{d - 1})),
    g{d} AS (SELECT f.pos, (SELECT count(*) FROM k{d - 1}) + (SELECT count(*) FROM o{d} WHERE r = 1 AND o{d}.pos < f.pos) AS seen FROM f{d - 1} f),
    n{d} AS (SELECT near AS id, row_number() OVER (ORDER BY pos, side, age, near) - 1 AS pos FROM o{d} WHERE r = 1 AND pos IN (SELECT pos FROM g{d} WHERE seen < {cap})),
    f{d} AS (SELECT * FROM n{d} WHERE NOT EXISTS (SELECT 1 FROM g{d} WHERE seen >= {cap}) AND pos < {cap}),
    k{d} AS (SELECT id, depth FROM k{d - 1} UNION ALL SELECT id, {d} FROM n{d})"""


ORACLE["neighborhood_capped"] = (
    f"WITH {_E}, x AS (SELECT * FROM e WHERE src IS NOT NULL AND dst IS NOT NULL), k0 AS (SELECT min(src) AS id, 0 AS depth FROM edges), f0 AS (SELECT id, 0 AS pos FROM k0), "
    + ", ".join(_level(d, 50) for d in (1, 2, 3)) + " SELECT id, depth::INT AS depth FROM k3"
)
ORACLE["symbol_search"] = f"""WITH {_CUR}, f AS (SELECT id, 'name' AS field, {_WORDS.format('name')} AS w FROM cur UNION ALL SELECT id, 'fqname', {_WORDS.format('fqname')} FROM cur
    UNION ALL SELECT id, 'file_text', {_WORDS.format('file')} FROM cur UNION ALL SELECT id, 'signature', coalesce({_WORDS.format('signature')}, []) FROM cur UNION ALL SELECT id, 'kind', list_filter([kind], lambda x: x IS NOT NULL) FROM cur),
    ln AS (SELECT id, field, coalesce(len(w), 0) AS dl, len(list_filter(w, lambda x: x = CASE WHEN field = 'kind' THEN 'function' ELSE 'parser' END)) AS tf FROM f), st AS (SELECT field, count(*) AS n, avg(dl) AS av FROM ln GROUP BY field),
    df AS (SELECT field, count(*) AS df FROM ln WHERE tf > 0 GROUP BY field)
    SELECT id, round(sum({_BM25}), 4) AS score FROM ln JOIN df USING (field) JOIN st USING (field) WHERE tf > 0 GROUP BY id"""
ORACLE["extract_status"] = f"""SELECT lang, CASE WHEN lang IS NULL THEN 'no_language' WHEN gone THEN 'unreadable' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT DISTINCT content IS NULL AS gone, file,
    CASE WHEN x IN ('c', 'h') THEN 'c' WHEN x IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN x IN ('ts', 'tsx') THEN 'typescript' WHEN x = 'py' THEN 'python' WHEN x = 'rs' THEN 'rust' WHEN x = 'go' THEN 'go' END AS lang
    FROM (SELECT file, content, lower(regexp_extract(file, '[^/]\\.([^./]+)$', 1)) AS x FROM source_files WHERE file IS NOT NULL)) GROUP BY ALL"""
