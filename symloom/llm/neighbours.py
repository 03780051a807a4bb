"""The most similar vectors of every vector, by additive quantisation.

Vectors become unit vectors; equal ones are searched once. A bounded sample
fits coarse cells, whose number grows as the power 2/3 of that of the vectors,
and additive codebooks: full-dimensional residual codebooks,
refined jointly, whose codes a beam search picks; the norm of the decoded
vector and its distance from the true one are stored with the code. Every
vector is a query in its nearest cell, and its code, a few bytes, is sent to
the cells where it may be asked for. Neighbouring cells make a bundle, to
which a code is sent once and which is one task's work. In a cell, lookup tables of the query
against all codewords score all codes; whatever the stored distance does not
rule out is reranked exactly. Where no least cosine shortens the search, that
distance is too wide to rule out much, so what the codebooks leave over goes
along in one byte a dimension. How many cells a code is sent to is calibrated
against exact neighbours of a sample of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.plans.scratch import Scratch

#: Rows that fit codebooks, queries that calibrate the index, and most rows
#: that fit cells: the sample grows with the cells, at least so many rows each.
FIT_ROWS, CALIBRATION_QUERIES, MOST_FIT_ROWS, ROWS_A_CELL = 20_000, 800, 1_000_000, 16
#: Cells for a table of n vectors are so many times n to the power of 2/3; up
#: to so many vectors a single one is searched.
CELLS, ONE_CELL = 1.6, 2_000
CODEBOOKS, CODEWORDS, BEAM = 8, 256, 6
#: Most queries and codes that meet in one group.
QUERY_BLOCK, CODE_BLOCK = 4_096, 65_536
#: Share of the sample's neighbours that must lie within reach.
REACH = 0.93


class Index(NamedTuple):
    cells: np.ndarray  # (cells, dim), unit vectors, near ones near each other
    books: np.ndarray  # (codebooks, codewords, dim)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
        order = np.argsort(own, kind="stable")
        ids, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centre[ids] = sums / np.diff([*first, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(k), ids)
        centre[empty] = x[rng.choice(len(x), len(empty))]
    return centre.astype(np.float32)


def beam_step(left: np.ndarray, codes: np.ndarray, book: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """One more codeword: of what is left over (rows, width, dim) by the codes
    (rows, width, stages) the best ``beam`` continuations of each row."""
    n, width, dim = left.shape
    cost = (left * left).sum(2)[:, :, None] - 2 * (left.reshape(-1, dim) @ book.T).reshape(n, width, -1) + (book * book).sum(1)
    flat = cost.reshape(n, -1)
    keep = min(beam, flat.shape[1])
    best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
    old, word = best // len(book), best % len(book)
    left = np.take_along_axis(left, old[:, :, None], 1) - book[word]
    return left, np.concatenate([np.take_along_axis(codes, old[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row and the decoded rows: stage by stage the best few
    partial sums are kept, judged by what they leave over."""
    left, codes = x[:, None, :], np.zeros((len(x), 1, 0), np.uint8)
    for book in books:
        left, codes = beam_step(left, codes, book, beam)
    final = (left * left).sum(2).argmin(1)
    rows = np.arange(len(x))
    return codes[rows, final], x - left[rows, final]


def encode_chunks(x: np.ndarray, books: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    parts = [beam_encode(x[i : i + chunk], books) for i in range(0, len(x), chunk)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def cells_wanted(n_rows: int) -> int:
    return int(CELLS * n_rows ** (2 / 3)) if n_rows > ONE_CELL else 1


def _ordered_cells(sample: np.ndarray, n_cells: int) -> np.ndarray:
    """Cells by k-means in two levels, so that the work is that of the root of
    their number, those of one upper cell behind each other."""
    if n_cells == 1:
        return sample.mean(0, keepdims=True)
    tops = k_means(sample, max(1, int(math.sqrt(n_cells))))
    own = (sample @ tops.T - 0.5 * (tops * tops).sum(1)).argmax(1)
    order, share = np.argsort(tops[:, 0], kind="stable"), n_cells / len(sample)
    out = []
    for t in order.tolist():
        mine = sample[own == t]
        if len(mine):
            out.append(k_means(mine, min(len(mine), max(1, round(len(mine) * share))), 6, seed=t))
    return np.concatenate(out)


def fit(sample: np.ndarray, n_rows: int) -> Index:
    """Coarse cells and codebooks."""
    cells = _ordered_cells(sample, max(1, min(cells_wanted(n_rows), len(sample) // ROWS_A_CELL)))
    cells = cells / np.maximum(np.linalg.norm(cells, axis=1, keepdims=True), 1e-12)
    sample = sample[:FIT_ROWS]
    words, books = min(CODEWORDS, len(sample)), []
    beams = [(sample[i : i + 256, None, :], np.zeros((len(sample[i : i + 256]), 1, 0), np.uint8)) for i in range(0, len(sample), 256)]
    for stage in range(CODEBOOKS):
        rest = np.concatenate([left[np.arange(len(left)), (left * left).sum(2).argmin(1)] for left, _ in beams])
        books.append(k_means(rest, words, 6, seed=stage))
        beams = [beam_step(left, codes, books[-1], BEAM) for left, codes in beams]
    stacked = np.stack(books)
    if len(sample) >= 4 * words:  # refine all codebooks jointly by least squares
        codes, _ = encode_chunks(sample, stacked)
        column = codes.astype(np.int64) + np.arange(CODEBOOKS) * words
        gram = np.zeros((CODEBOOKS * words,) * 2, np.float32)
        target = np.zeros((CODEBOOKS * words, sample.shape[1]), np.float32)
        for a in range(CODEBOOKS):
            np.add.at(target, column[:, a], sample)
            for b in range(CODEBOOKS):
                np.add.at(gram, (column[:, a], column[:, b]), 1)
        solved = np.linalg.solve(gram + np.eye(len(gram), dtype=np.float32), target + stacked.reshape(len(gram), -1))
        stacked = solved.reshape(stacked.shape).astype(np.float32)
    return Index(cells.astype(np.float32), stacked)


def lookup_scores(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of queries and decoded codes from lookup tables."""
    out = np.zeros((len(queries), len(codes)), np.float32)
    for m, book in enumerate(books):
        out += np.take(queries @ book.T, codes[:, m], axis=1)
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book.astype(np.float64)[codes[:, m]] for m, book in enumerate(books))


def byte_rest(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the codes leave over of unit vectors as signed bytes, their scale,
    and the distance that is left after both."""
    rest = x - decode(codes, books)
    scale = (np.maximum(np.abs(rest).max(1), 1e-12) / 127).astype(np.float32)
    whole = np.clip(np.rint(rest / scale[:, None]), -127, 127).astype(np.int8)
    return whole, scale, np.linalg.norm(rest - whole * scale[:, None].astype(np.float64), axis=1).astype(np.float32)


def _normed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, dim: int, id_col: str = "id", vec: str = "vec", seq: str = "seq") -> DataFrame:
    """``id, unit``: of each id the vector of its row with the highest ``seq``,
    as ``dim`` float32 of a unit vector, if it is usable."""
    newest = vectors.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(F.col(seq), F.col(vec).alias("v"))).alias("r"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1)
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            scale = np.abs(x).max(1, initial=0, keepdims=True)
            ok = np.isfinite(x).all(1) & (scale[:, 0] > 0)
            x = x[ok] / scale[ok]
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), raw], names=["id", "unit"])

    v = F.col("r.v")
    whole = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda e: e.isNull())
    kind = vectors.schema[id_col].dataType.simpleString()
    return newest.where(whole).select("id", v.cast("array<float>").alias("v")).mapInArrow(run, f"id {kind}, unit binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)


def _nearest_cells(x: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    near = x @ cells.T
    if n >= len(cells):
        return np.argsort(-near, axis=1, kind="stable")
    top = np.argpartition(-near, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def _reach(units: DataFrame, queries: np.ndarray, index: Index, dim: int, k: int, bar: float | None, reach: float) -> int:
    """Nearest cells to which a code must go so that ``reach`` of the sample's
    exact neighbours meet their query."""
    if len(index.cells) == 1:
        return 1
    asked = units.sparkSession.sparkContext.broadcast((queries, _nearest_cells(queries, index.cells, 1)[:, 0], index.cells))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, cells = asked.value
        known = np.full((len(q), k), -2, np.float32)  # the best of this task so far
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(i, 4096), dim)
                score = q @ x.T
                score[score > 1 - 1e-6] = -2  # the query itself
                n = min(k, len(x))
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                cos = np.take_along_axis(score, best, 1).ravel()
                hit, row = best.ravel(), np.repeat(np.arange(len(q)), n)
                ok = (cos >= (bar if bar is not None else -1)) & (cos > known.min(1)[row])
                both = np.concatenate([known, cos.reshape(len(q), n)], 1)
                known = -np.partition(-both, k - 1, axis=1)[:, :k]
                hit, row, cos = hit[ok], row[ok], cos[ok]
                near = x @ cells.T
                rank = (near[hit] > near[hit, own[row]][:, None]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(cos, pa.float32()), pa.array(rank, pa.int32())], names=["q", "cos", "rank"])

    found = units.select("unit").mapInArrow(run, "q int, cos float, rank int")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "rank"))).where(F.col("n") <= k)
    ranks = top.groupBy("rank").count().toPandas().sort_values("rank")  # at most one row per cell
    if ranks["count"].sum() < 50:  # too few to tell how far is far enough
        return len(index.cells)
    share = ranks["count"].cumsum() / ranks["count"].sum()
    # a little farther than the sample asks for, as it is a sample
    return min(len(index.cells), math.ceil(1.1 * (int(ranks["rank"][share >= reach].iloc[0]) + 1)) + 2)


def nearest(
    vectors: DataFrame, k: int = 10, dim: int = 32, min_cosine: float | None = None, id_col: str = "id", vec: str = "vec", seq: str = "seq",
    fit_rows: int = FIT_ROWS, reach: float = REACH, short_list: int | None = None,
) -> DataFrame:
    """``id, neighbour, cosine``: of every id its ``k`` most similar other ids.

    Of an id the row with the highest ``seq`` counts; it is left out if its
    vector is null, not ``dim`` long, all zero, or holds a null, NaN or
    infinity. Equal cosines (to 9 decimals) go by the id. With ``min_cosine``
    less similar neighbours are left out, which shortens the search. The
    stored distance of a code from its vector bounds the error, and every code
    in reach that may be among the ``k`` best is reranked, without a cap;
    ``short_list``, once that cap, has no effect. Null ids are skipped, repeated
    rows count once, an empty table gives no rows, further columns are
    ignored. Codebooks are fitted on ``fit_rows`` rows at most, cells on some
    more where there are many (:data:`MOST_FIT_ROWS`); all rows are indexed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    units = scratch.cut(usable(vectors, dim, id_col, vec, seq))
    kind = units.df.schema["id"].dataType.simpleString()
    order = Window.partitionBy("unit").orderBy("id")
    # the first ids of each class of equal vectors; the limit acts before the shuffle
    heads = units.df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    classes = scratch.cut(heads.groupBy("unit").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("head")))
    reps = classes.df.select(F.col("rep").alias("id"), "unit")
    n_reps = reps.count()
    empty = spark.createDataFrame([], f"id {kind}, neighbour {kind}, cosine double")
    if not n_reps:
        return empty
    rows = max(fit_rows, min(MOST_FIT_ROWS, ROWS_A_CELL * cells_wanted(n_reps)))
    # thinned by a hash first, so that no task sorts more than a few samples
    drawn = rows + CALIBRATION_QUERIES
    thin = reps.where(F.pmod(F.xxhash64("unit"), F.lit(1_000_000)) < min(1.0, 1.2 * drawn / n_reps) * 1_000_000)
    sample = _matrix(thin.orderBy(F.xxhash64("unit"), "id").limit(drawn).select("unit").toArrow()["unit"], dim).copy()
    if not len(sample):  # a handful of vectors, none of which the hash took
        sample = _matrix(reps.select("unit").limit(drawn).toArrow()["unit"], dim).copy()
    # queries that fitted the cells would lie closer to them than others do
    asked = sample[:CALIBRATION_QUERIES]
    sample = sample[CALIBRATION_QUERIES:] if len(sample) > 4 * CALIBRATION_QUERIES else sample
    index = fit(sample, n_reps)
    cells_of = _reach(reps, asked, index, dim, k, min_cosine, reach)
    shared = spark.sparkContext.broadcast(index)
    wide = max(1, QUERY_BLOCK * len(index.cells) // n_reps)  # cells of a bundle

    def bundled(near: np.ndarray) -> pa.Array:
        """Of each row's cells those of one bundle together."""
        cells = np.sort(near, axis=1)
        new = np.ones(cells.shape, bool)
        new[:, 1:] = cells[:, 1:] // wide != cells[:, :-1] // wide
        first = np.nonzero(new.ravel())[0]
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, cells.size), pa.int32()), pa.array(cells.ravel(), pa.int32()))
        parts = pa.StructArray.from_arrays([pa.array(cells.ravel()[first] // wide, pa.int32()), lists], ["bundle", "cells"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(new.sum(1))), pa.int32()), parts)

    def coded_rows(part: pa.RecordBatch, near: np.ndarray, codes: np.ndarray, norm: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(near[:, 0], pa.int32()), bundled(near), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(off)],
            names=["id", "unit", "cell", "parts", "code", "norm", "off"],
        )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = _matrix(part.column(1), dim)
                near = _nearest_cells(x, idx.cells, cells_of).astype(np.int32)
                codes, decoded = encode_chunks(x, idx.books)
                if min_cosine is None:
                    rest, norm, off = byte_rest(_normed(x), codes, idx.books)
                    codes = np.concatenate([codes, rest.view(np.uint8)], 1)
                    yield coded_rows(part, near, codes, norm, off)
                    continue
                norm = np.maximum(np.linalg.norm(decoded, axis=1), 1e-6).astype(np.float32)
                # cosine with the decoded direction is off by at most the distance to it
                off = np.linalg.norm(x - decoded / norm[:, None], axis=1).astype(np.float32)
                yield coded_rows(part, near, codes, norm, off)

    coded = scratch.cut(reps.mapInArrow(encode, f"id {kind}, unit binary, cell int, parts array<struct<bundle:int,cells:array<int>>>, code binary, norm float, off float"))
    own = coded.df.select(F.expr(f"cell div {wide}").cast("int").alias("bundle"), "id", "unit", "cell")
    sent = coded.df.select(F.explode("parts").alias("p"), "id", "code", "norm", "off").select("p.bundle", "p.cells", "id", "code", "norm", "off")
    sizes = own.groupBy("bundle").agg(F.count(F.lit(1)).alias("nq")).join(sent.groupBy("bundle").agg(F.count(F.lit(1)).alias("nc")), "bundle")
    blocks = sizes.select("bundle", F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("qbs"), F.ceil(F.col("nc") / CODE_BLOCK).cast("int").alias("cbs"))
    blocks = F.broadcast(scratch.cut(blocks).df)  # at most a row a cell
    own = own.join(blocks, "bundle").select(
        "bundle", F.pmod(F.xxhash64("id"), F.col("qbs")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("cbs") - 1)).alias("cb"), "id", "unit", "cell"
    )
    sent = sent.join(blocks, "bundle").select(
        "bundle", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), F.pmod(F.xxhash64("id"), F.col("cbs")).cast("int").alias("cb"), "id", "cells", "code", "norm", "off"
    )

    def meet(queries: pa.Table, codes: pa.Table) -> pa.Table:
        idx = shared.value
        out_q, out_u, out_c = [], [], []
        if queries.num_rows and codes.num_rows:
            q = _matrix(queries["unit"], dim)
            code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(codes.num_rows, -1)
            norm, off = codes["norm"].to_numpy(), codes["off"].to_numpy()
            ids, units_q = queries["id"].to_pylist(), queries["unit"].to_pylist()
            names = codes["id"].combine_chunks() if codes["id"].num_chunks != 1 else codes["id"].chunk(0)
            where = {v: n for n, v in enumerate(names.to_pylist())}
            if min_cosine is None:
                q = _normed(q)
                # scale and distance as wide as their rounding may ask for
                off = off * (1 + 1e-6) + 1e-9
                full = decode(code[:, :CODEBOOKS], idx.books) + code[:, CODEBOOKS:].view(np.int8) * norm[:, None].astype(np.float64)
                square = (full * full).sum(1)
            # the codes of each cell: sorted by cell, then by their place
            spots = codes["cells"].combine_chunks() if codes["cells"].num_chunks != 1 else codes["cells"].chunk(0)
            flat = spots.flatten().to_numpy()
            owner = np.repeat(np.arange(codes.num_rows), np.diff(spots.offsets.to_numpy()))
            order = np.lexsort((owner, flat))
            flat, owner = flat[order], owner[order]
            q_cell = queries["cell"].to_numpy()
            for cell in np.unique(q_cell):
                subset = owner[np.searchsorted(flat, cell) : np.searchsorted(flat, cell, "right")]
                asking = np.nonzero(q_cell == cell)[0]
                if not len(subset):
                    continue
                step = max(1, min(256, 4_000_000 // len(subset)))
                part_off = off[subset]
                for i in range(0, len(asking), step):
                    some = asking[i : i + step]
                    if min_cosine is None:
                        # minus the distance from the query: its error does not outgrow close neighbours as that of the cosine does
                        score = -np.sqrt(np.maximum(1 + square[subset] - 2 * (q[some] @ full[subset].T), 0))
                    else:
                        score = lookup_scores(q[some], code[subset], idx.books) / norm[subset]
                    for r, s in zip(some.tolist(), score, strict=True):
                        me = where.get(ids[r], -1)
                        at = int(np.searchsorted(subset, me))
                        if at < len(subset) and subset[at] == me:
                            s[at] = -3
                        if min_cosine is not None:
                            # the k-th best lower bound is a bar too, as only k are asked for
                            bar = min_cosine if len(s) <= k + 1 else max(min_cosine, np.partition(s - part_off, -k - 1)[-k - 1])
                            best = np.nonzero(s + part_off >= bar - 1e-4)[0]
                        elif len(s) > k + 1:
                            bar = np.minimum(np.partition(s - part_off, -k)[-k], 0)
                            # squares, as the cosines are compared to 9 decimals
                            best = np.nonzero(np.minimum(s + part_off, 0) ** 2 <= bar * bar + 1e-8)[0]
                        else:
                            best = np.arange(len(s))
                        best = best[s[best] > -2.5]
                        if len(best):
                            out_q.append(ids[r])
                            out_u.append(units_q[r])
                            out_c.append(names.take(pa.array(subset[best])))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out_c)]), pa.int32()), pa.concat_arrays(out_c)) if out_c else pa.array([], pa.list_(codes["id"].type))
        return pa.table({"id": pa.array(out_q, queries["id"].type), "unit": pa.array(out_u, pa.binary()), "near": lists})

    short = own.groupBy("bundle", "qb", "cb").cogroup(sent.groupBy("bundle", "qb", "cb")).applyInArrow(meet, f"id {kind}, unit binary, near array<{kind}>")
    pairs = short.select("id", "unit", F.explode("near").alias("rep"))
    both = pairs.join(classes.df.select("rep", F.col("unit").alias("unit2"), "head"), "rep").select("id", "unit", "unit2", "head")

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column(1), dim).astype(np.float64), _matrix(batch.column(2), dim).astype(np.float64)
            cos = np.round((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cos), batch.column(3)], names=["rep", "cosine", "head"])

    scored = both.mapInArrow(exact, f"rep {kind}, cosine double, head array<{kind}>")
    if min_cosine is not None:
        scored = scored.where(F.col("cosine") >= min_cosine)
    mates = classes.df.where(F.size("head") > 1).select("rep", F.lit(1.0).alias("cosine"), "head")
    flat = scored.unionByName(mates).select("rep", "cosine", F.explode("head").alias("neighbour"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour"))
    # one entry more than asked for, as an id may meet itself among its equals
    lists = flat.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbour"))).alias("near"))
    members = units.df.join(classes.df.select("unit", "rep"), "unit").select("id", "rep")
    mine = members.join(lists, "rep").select("id", F.slice(F.filter("near", lambda e: e["neighbour"] != F.col("id")), 1, k).alias("near"))
    return mine.select("id", F.explode("near").alias("e")).select("id", F.col("e.neighbour").alias("neighbour"), (-F.col("e.c")).alias("cosine"))


def similar_pairs(neighbours: DataFrame, min_cosine: float) -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b`` as text, each pair once."""
    a, b = F.col("id").cast("string"), F.col("neighbour").cast("string")
    return neighbours.where(F.col("cosine") >= min_cosine).select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()
