"""The general operators against brute force on small fixtures."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from symloom.functions.keys import clean_name, pack_id, unpack_id
from symloom.operators import forest, heavy_keys, orphans

T0 = dt.datetime(2024, 3, 1)
EDGES = "seq long, src string, dst string, kind string, indexed_at timestamp_ntz"
REFS = "ref_seq long, src string, to_name string, kind string, file string, indexed_at timestamp_ntz"
SYMBOLS = "id string, name string, indexed_at timestamp_ntz, deleted_at timestamp_ntz"


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def test_pack_id_is_one_to_one(spark):
    values = ["0" * 32, "F" * 32, "ab" * 16, "", "x", "é", None, "\x00", "12" * 8]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = df.select("v", pack_id("v").alias("p")).select("v", unpack_id("p").alias("u"), F.hex("p").alias("h")).collect()
    assert all(r.v == r.u for r in out)
    assert len({r.h for r in out}) == len(values)


def test_clean_name(spark):
    df = spark.createDataFrame([("  '<Foo>' ",), ('"a b"',), ("``",), (None,), ("x'y",)], "v string")
    assert [r[0] for r in df.select(clean_name("v")).collect()] == ["foo", "a b", "", None, "x'y"]


def test_pair_stats_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        hot = rng.random() < 0.34
        dst = "a" * 32 if hot else rng.choice(["b", "c", None])
        rows.append((i, rng.choice(["s1", "s2", None, "s3"]), dst, rng.choice(["calls", "uses", None]), day(rng.choice([0, 1, 2, None]))))
    rows += rows[:50]
    got = {(r.dst, r.kind): (r.n_edges, r.n_callers, r.first_seen, r.last_seen) for r in heavy_keys.pair_stats(spark.createDataFrame(rows, EDGES)).collect()}
    want = defaultdict(list)
    for _, src, dst, kind, at in rows:
        if dst is not None and kind is not None:
            want[dst, kind].append((src, at))
    assert got == {
        k: (len(v), len({s for s, _ in v if s is not None}), min((a for _, a in v if a), default=None), max((a for _, a in v if a), default=None))
        for k, v in want.items()
    }


def test_heavy_pairs_threshold_ties_empty_and_extra_columns(spark):
    rows = [(i, "s", "hot", "calls", T0) for i in range(3)] + [(9, "s", None, None, T0)] * 197
    df = spark.createDataFrame(rows, EDGES).withColumn("w", F.lit(7)).withColumn("n_edges", F.lit(1)).withColumn("_to", F.lit(1))
    assert [(r.dst, r.kind) for r in heavy_keys.heavy_pairs(df).collect()] == [("hot", "calls")]
    assert heavy_keys.heavy_pairs(df.limit(0)).count() == 0
    assert heavy_keys.pair_stats(df.limit(0)).count() == 0


def test_weighted_mode_and_percentiles(spark):
    rows = [("k", v) for v in [1, 1, 2, 2, 5, None]] + [("n", None)]
    df = spark.createDataFrame(rows, "key string, v int")
    freq = heavy_keys.value_frequencies(df, ["key"], "v")
    assert [(r["key"], r["mode"], r["mode_w"]) for r in heavy_keys.weighted_mode(freq, ["key"], "v").collect()] == [("k", 1, 2)]
    got = {r["key"]: r["percentiles"] for r in heavy_keys.weighted_percentiles(freq, ["key"], "v", [0.5]).collect()}
    assert got["k"] == [2.0]


def brute_orphans(edges, refs, symbols):
    def strip(v):
        return v.strip(" \t\r\n\f\v'\"`<>").lower()

    by = defaultdict(list)
    for i, n, a, d in symbols:
        if a is None:
            continue
        if i is not None:
            by["id", i].append((a, d))
        if n is not None:
            by["name", strip(n)].append((a, d))
    asked = {("edges", "dst", e[0], ("id", e[2]), e[4]) for e in edges if e[2] and e[2].strip()}
    asked |= {("refs", "src", r[0], ("id", r[1]), r[5]) for r in refs if r[1] and r[1].strip()}
    asked |= {("refs", "to_name", r[0], ("name", strip(r[2])), r[5]) for r in refs if r[2] and r[2].strip()}
    out = set()
    for table, field, seq, key, t in asked:
        spans = [(a, d) for a, d in by[key] if d is None or d > a]
        t = t or dt.datetime(9999, 1, 1)
        if not any(a <= t and (d is None or d > t) for a, d in spans):
            out.add((table, field, seq, "missing" if not spans else "deleted" if any(a <= t for a, _ in spans) else "late"))
    return out


@pytest.mark.parametrize("part_rows", [100_000, 20, 3])
def test_orphans_brute_force(spark, part_rows):
    rng = random.Random(3)
    ids = ["%032x" % i for i in range(12)] + ["odd id"]
    names = ["Run", "<run>", " 'run' ", "stop", None, "", "  ", "other"]
    symbols = [(rng.choice([*ids[:9], None]), rng.choice(["run", "RUN", "Stop", None]), day(rng.choice([0, 1, 2, 3, None])), day(rng.choice([None, 1, 2, 3, 4]))) for _ in range(25)]
    edges = [(i, "s", rng.choice([ids[0], ids[0], *ids, None, " "]), "calls", day(rng.choice([0, 1, 2, 3, 4, None]))) for i in range(300)]
    refs = [(i, rng.choice([*ids, None, ""]), rng.choice(names), "calls", "f", day(rng.choice([0, 1, 2, 3, 4]))) for i in range(300)]
    edges, refs, symbols = edges + edges[:30], refs + refs[:30], symbols + symbols[:5]
    frames = [spark.createDataFrame(r, s) for r, s in ((edges, EDGES), (refs, REFS), (symbols, SYMBOLS), ([], SYMBOLS))]
    frames[0] = frames[0].withColumn("t", F.lit(1)).withColumn("key", F.lit("x")).withColumn("status", F.lit(1))
    got = [(r.ref_table, r.ref_field, r.ref_seq, r.status) for r in orphans.orphans(*frames, part_rows=part_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_orphans(edges, refs, symbols)
    report = orphans.orphan_report(orphans.orphans(*frames)).collect()
    assert sum(r.n for r in report) == len(got)


def test_orphans_without_targets_and_without_references(spark):
    e, r, s = (spark.createDataFrame([], x) for x in (EDGES, REFS, SYMBOLS))
    assert orphans.orphans(e, r, s, s).count() == 0
    one = spark.createDataFrame([(1, "s", "d", "k", T0)], EDGES)
    assert [x.status for x in orphans.orphans(one, r, s, s).collect()] == ["missing"]


def brute_forest(links):
    parent = {}
    for tree, node, up in links:
        if None not in (tree, node, up):
            parent[tree, node] = min(up, parent.get((tree, node), up))
    out = {}
    for tree, node in parent:
        path, at = [node], node
        while (tree, at) in parent:
            at = parent[tree, at]
            if at in path:
                break
            path.append(at)
        if (tree, path[-1]) in parent:
            ring = path[path.index(at):]
            out[tree, node] = (min(ring), None, node in ring, None)
        else:
            out[tree, node] = (path[-1], len(path) - 1, False, path[::-1])
    return out


def shapes():
    rng = random.Random(5)
    yield []
    yield [("a", "n%03d" % i, "n%03d" % (i + 1)) for i in range(90)]
    yield [("a", f"x{i}", "hub") for i in range(60)]
    yield [("a", "p", "p"), ("a", "q", "p"), ("a", "r", "q")]
    ring = [("b", f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("b", "t0", "c3")] + [("b", f"t{i + 1}", f"t{i}") for i in range(40)]
    yield ring + [("b", "u", "c0"), ("a", "c1", "top"), (None, "z", "y"), ("a", None, "y"), ("a", "z", None)]
    for size in (30, 200):
        links = [("a" if rng.random() < 0.5 else "b", f"k{i}", f"k{rng.randrange(size) if rng.random() < 0.1 else max(0, i - rng.randrange(1, 5))}") for i in range(1, size)]
        yield links + links[:9]


@pytest.mark.parametrize("links", list(shapes()))
@pytest.mark.parametrize("peel_share", [0.2, 0.0, 2.0])
def test_hierarchy_brute_force(spark, links, peel_share):
    df = spark.createDataFrame(links, "tree string, node string, parent string").withColumn("root", F.lit(1)).withColumn("up", F.lit(1))
    out = forest.hierarchy(df, peel_share=peel_share, max_rounds=6)
    rows = out.collect()
    got = {(r.tree, r.node): (r.root, r.depth, r.in_circle, r.path) for r in rows}
    assert len(rows) == len(got)
    want = brute_forest(links)
    assert got == want
    pairs = Counter((r.tree, r.ancestor, r.descendant, r.distance) for r in forest.descendants(out).collect())
    assert pairs == Counter((t, a, n, len(v[3]) - 1 - i) for (t, n), v in want.items() if v[3] for i, a in enumerate(v[3][:-1]))


@pytest.mark.parametrize("links", list(shapes()))
def test_sizes_brute_force(spark, links):
    df = spark.createDataFrame(links, "tree string, node string, parent string").withColumn("size", F.lit(1)).withColumn("up", F.lit(1))
    below: dict = {}
    for (tree, node), v in brute_forest(links).items():
        for i, a in enumerate((v[3] or [])[:-1]):
            below.setdefault((tree, a), []).append(len(v[3]) - 1 - i)
    rows = forest.subtree_sizes(forest.sound_links(df)).collect()
    assert {(r.tree, r.ancestor): (r.n_descendants, r.height) for r in rows} == {k: (len(d), max(d)) for k, d in below.items()}
    assert len(rows) == len(below)


def test_sizes_refuse_circles(spark):
    with pytest.raises(ValueError, match="circle"):
        forest.subtree_sizes(spark.createDataFrame([("a", "p", "q"), ("a", "q", "p")], "tree string, node string, parent string"))


def test_further_parents(spark):
    rows = [("a", "n", "q"), ("a", "n", "p"), ("a", "n", "p"), ("a", "n", "r"), ("b", "n", "q"), ("a", None, "x"), ("a", "m", None)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string")
    assert sorted(map(tuple, forest.further_parents(df).collect())) == [("a", "n", "q"), ("a", "n", "r")]
    assert {(r.tree, r.node): r.parent for r in forest.hierarchy(df).collect()} == {("a", "n"): "p", ("b", "n"): "q"}


def test_subtrees_below_a_circle(spark):
    links = [("a", f"c{i}", f"c{(i + 1) % 3}") for i in range(3)] + [("a", "t0", "c1"), ("a", "t1", "t0"), ("a", "u", "t0"), ("a", "p", "p"), ("a", "q", "p"), ("a", "x", "top"), ("b", "c0", "top")]
    df = spark.createDataFrame(links, "tree string, node string, parent string")
    opened = forest.open_circles(df)
    paths = forest.hierarchy(opened)
    pairs = sorted((r.tree, r.ancestor, r.descendant, r.distance) for r in forest.descendants(paths).collect())
    below = [("a", "c1", "t0", 1), ("a", "c1", "t1", 2), ("a", "c1", "u", 2), ("a", "p", "q", 1), ("a", "t0", "t1", 1), ("a", "t0", "u", 1)]
    assert pairs == sorted([*below, ("a", "top", "x", 1), ("b", "top", "c0", 1)])
    sizes = {(r.tree, r.ancestor): (r.n_descendants, r.height) for r in forest.subtree_sizes(opened).collect()}
    assert sizes == {("a", "c1"): (3, 2), ("a", "p"): (1, 1), ("a", "t0"): (2, 1), ("a", "top"): (1, 1), ("b", "top"): (1, 1)}
