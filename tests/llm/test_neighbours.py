"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from symloom.llm import neighbours as nn

DIM = 32
SCHEMA = "id string, vec array<float>, seq long, unit int, rep string"


def brute(vectors, k, least=-2.0):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    cos = np.round((x @ x.T) / np.outer(n, n), 9)
    out = {}
    for r, i in enumerate(ids):
        order = sorted((-cos[r, c], j) for c, j in enumerate(ids) if j != i and cos[r, c] >= least)
        out[i] = [(j, -c) for c, j in order[:k]]
    return out


def frame(spark, vectors, extra=()):
    rows = [(i, [float(e) for e in v], 5, 1, "x") for i, v in vectors.items()]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append((r.neighbour, r.cosine))
    return {i: sorted(v, key=lambda e: (-e[1], e[0])) for i, v in out.items()}


def clustered(n, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, DIM)).astype(np.float32)
    for i in range(0, n, 5):
        base[i + 1] = base[i] * 3 + rng.normal(size=DIM) * 0.1
    return {f"v{i:05d}": base[i] for i in range(n)}


def test_small_exact_ties_equals_and_unusable(spark):
    v = clustered(60)
    for i in range(25):
        v[f"same{i:02d}"] = v["v00000"]
    bad = [0.0] * DIM
    rows = [("zero", bad, 1), ("short", [1.0] * 16, 1), ("long", [1.0] * 48, 1), ("nan", [float("nan")] * DIM, 1), ("null", None, 9), ("hole", [None] + [1.0] * 31, 1), (None, [1.0] * DIM, 1)]
    rows += [("null", [1.0] * DIM, 3), ("v00003", [1.0] * DIM, 1), ("v00002", [float(e) for e in v["v00002"]], 5), ("inf", [float("inf")] + [1.0] * 31, 1)]
    df = frame(spark, v, [(i, x, s, 1, "x") for i, x, s in rows])
    have, want = got(nn.nearest(df, k=10, short_list=100)), brute(v, 10)
    assert set(have) == set(want)
    for i in want:
        assert [j for j, _ in have[i]] == [j for j, _ in want[i]], i
        assert np.allclose([c for _, c in have[i]], [c for _, c in want[i]], atol=1e-6)
    near = {tuple(sorted((i, j))) for i, e in brute(v, 10, 0.93).items() for j, _ in e}
    pairs = nn.similar_pairs(nn.nearest(df, k=10, min_cosine=0.93), 0.93).collect()
    assert {(r.id_a, r.id_b) for r in pairs} == near and len(pairs) == len(near)


def test_empty_and_single(spark):
    assert nn.nearest(frame(spark, {"a": np.zeros(DIM)})).count() == 0
    assert nn.nearest(frame(spark, {"a": np.ones(DIM)})).count() == 0
    assert nn.nearest(frame(spark, {"a": np.ones(DIM), "b": np.ones(DIM) * 2})).count() == 2


def test_recall_with_cells_blocks_and_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(nn, "QUERY_BLOCK", 64)
    monkeypatch.setattr(nn, "CODE_BLOCK", 512)
    v = clustered(2500)
    v |= {f"hot{i:04d}": v["v00010"] for i in range(1250)}
    have = got(nn.nearest(frame(spark, v)))
    want = brute(v, 10)
    recall = np.mean([len({j for j, _ in have[i]} & {j for j, _ in want[i]}) / 10 for i in want])
    assert all(len(e) == 10 for e in have.values())
    assert recall >= 0.9
    near = {tuple(sorted((i, j))) for i, e in brute(v, 10, 0.93).items() for j, _ in e}
    found = {(r.id_a, r.id_b) for r in nn.similar_pairs(nn.nearest(frame(spark, v), min_cosine=0.93, reach=0.998), 0.93).collect()}
    assert found <= near and len(found) >= 0.99 * len(near)


@pytest.mark.parametrize("spread", [0.1, 1e-3])
def test_dense_cluster_of_near_copies(spark, spread):
    # a single cell, so nothing but the choice of candidates can lose neighbours
    v = clustered(1200)
    rng = np.random.default_rng(6)
    v |= {f"near{i:04d}": v["v00010"] + rng.normal(size=DIM).astype(np.float32) * np.float32(spread) for i in range(600)}
    have, want = got(nn.nearest(frame(spark, v))), brute(v, 10)
    assert [i for i in want if [j for j, _ in have[i]] != [j for j, _ in want[i]]] == []


def test_codes_go_to_all_cells_if_the_sample_has_too_few_neighbours(spark):
    x = np.random.default_rng(7).normal(size=(300, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = spark.createDataFrame([(str(i), bytearray(r.tobytes())) for i, r in enumerate(x)], "id string, unit binary")
    index = nn.Index(x[:40], np.zeros((nn.CODEBOOKS, 1, DIM), np.float32))
    assert nn._reach(units, x[:100], index, DIM, 10, 0.93, 0.998) == 40


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01/vectors.parquet"])
def test_test_vectors(spark, table):
    df = spark.read.parquet(table)
    newest = {}
    for r in df.collect():
        if r.id not in newest or r.seq > newest[r.id][0]:
            newest[r.id] = (r.seq, r.vec)
    v = {i: x for i, (_, x) in newest.items() if x and len(x) == DIM and np.isfinite(np.array(x, float)).all() and any(x)}
    near = {tuple(sorted((i, j))) for i, e in brute(v, 10, 0.93).items() for j, _ in e}
    assert {(r.id_a, r.id_b) for r in nn.similar_pairs(nn.nearest(df, min_cosine=0.93), 0.93).collect()} == near


def test_recall_of_many_cells(spark):
    v = clustered(6000, 9)
    have, want = got(nn.nearest(frame(spark, v))), brute(v, 10)
    assert np.mean([len({j for j, _ in have[i]} & {j for j, _ in want[i]}) / 10 for i in want]) >= 0.9


def test_codes_approximate_and_tables_agree():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = nn.fit(x, len(x))
    codes, decoded = nn.encode_chunks(x, index.books)
    sums = sum(index.books[m][codes[:, m]] for m in range(nn.CODEBOOKS))
    assert np.allclose(sums, decoded, atol=1e-4)
    assert ((x - decoded) ** 2).sum(1).mean() < 0.25
    assert np.allclose(nn.lookup_scores(x[:50], codes, index.books), x[:50] @ decoded.T, atol=1e-4)
    wide, _ = nn.encode_chunks(x, index.books), None
    narrow = np.concatenate([nn.beam_encode(x[i : i + 500], index.books, beam=1)[1] for i in range(0, 3000, 500)])
    assert ((x - decoded) ** 2).sum() < ((x - narrow) ** 2).sum()
