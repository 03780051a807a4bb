"""Leaked passages against a plain word-by-word search."""

import random

import numpy as np
import pytest

from symloom.llm import leakage as lk

rng = random.Random(11)
VOCAB = [f"w{i}" for i in range(400)] + ["über", "naïve", "a", "I", "no"]
ITEMS = {i: " ".join(rng.choice(VOCAB) for _ in range(rng.choice([5, 12, 13, 14, 40]))) + "." for i in range(20)}
ITEMS[20] = "a b c d e f g h i j k l m n o p"  # passages of 13 characters
ITEMS[21], ITEMS[22], ITEMS[23] = None, "", "  \n"
ITEMS[24] = ITEMS[4]
BOILER = "now write down in your own words what is left for the third one"
ITEMS[25], ITEMS[26] = f"alpha {BOILER} beta", f"gamma {BOILER} delta"


def passages(text):
    w = text.casefold().replace(".", "").split() if text else []
    return [w[i : i + 13] for i in range(len(w) - 12)]


def brute(docs):
    out = set()
    for d, plain in docs.items():
        w = plain.casefold().replace(".", "").split()
        have = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        out |= {(d, i) for i, t in ITEMS.items() if any(tuple(p) in have for p in passages(t))}
    return out


def noise(n):
    return " ".join("x%d" % rng.randrange(10_000) for _ in range(n))


def make_docs():
    docs = {}
    for d in range(60):
        item = ITEMS[rng.choice([i for i in ITEMS if ITEMS[i] and len(ITEMS[i].split()) >= 12])].strip(".").split()
        n = rng.choice([11, 12, 13, 14, 30])
        at = rng.randrange(max(1, len(item) - n + 1))
        docs[d] = " ".join([noise(rng.randrange(30)), *item[at : at + n], noise(rng.randrange(30))]).strip()
    docs[100] = noise(20_000) + " " + ITEMS[20] + " " + noise(10)
    docs[101] = "zz" + ITEMS[20].replace(" ", " ")[:25]  # twelve words and the end of another
    return docs


def test_brute_force(spark):
    docs = make_docs()
    rows = [(d, t, 0) for d, t in docs.items()]
    rows += [*rows[:9], (None, ITEMS[4], 0), (200, None, 0), (201, "", 0), (202, " \n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, value int")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS.items()] + [(None, ITEMS[4], "x"), (4, ITEMS[4], "x")], "item_id long, text string, doc string")
    want = brute(docs)
    assert len(want) > 20
    for bound in (lk.BROADCAST_VALUES, 0):
        got = [(r.doc_id, r.item_id) for r in lk.leaked_items(df, items, broadcast_values=bound).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want
    assert lk.leaked_items(df.limit(0), items).count() == 0
    assert lk.leaked_items(df, items.limit(0)).count() == 0


ITEM = "Suppose that the über parser keeps 625 central needles in one relay, and that nobody removes the third schedule before noon."


@pytest.mark.parametrize(
    "text",
    [
        ITEM, ITEM.upper(), "// " + ITEM.replace(" ", "\n// "), ITEM.replace("schedule", "sche-\n# dule"), ITEM.replace("schedule", "sche\xaddule"),
        ITEM.replace("schedule", "sche​dule"), ITEM.replace(" ", "\xa0\t"), ITEM.replace("ü", "ü"), "<p>" + ITEM.replace("central", "<em>central</em>") + "</p>",
        ITEM.replace(" ", "&nbsp;"), "> **" + ITEM.replace(" ", "** _"), ITEM.replace(" ", " / "), "x" * 100_000 + " " + ITEM, ITEM.replace("needles", "ｎeedles"),
    ],
)
def test_disguises(text):
    have = lk.words(text)
    assert lk.held(have, lk.words(ITEM))
    stream = "".join(have)
    for _, size, values, ends in lk.passage_values(ITEM):
        assert set(values) <= set(lk.sketch(stream, size).tolist())
        assert {*values, *ends} <= set(lk.shingles(np.array([ord(c) for c in stream], np.uint32), size).tolist())


def test_fewer_words(spark):
    docs = spark.createDataFrame([(1, "a b c one two I go"), (2, "one twoI go"), (3, "two I go on")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two I go"), (8, "I go on now")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in lk.leaked_items(docs, items, min_words=3).collect()} == {(1, 7), (2, 7), (3, 7), (3, 8)}  # inner boundaries are not compared
    assert {(r.doc_id, r.item_id) for r in lk.leaked_items(docs, items, min_words=1).collect()} == {(1, 7), (2, 7), (3, 7), (1, 8), (2, 8), (3, 8)}


def test_copies_of_ids_and_texts(spark):
    rows = [(1, ITEM), (1, "other words"), (1, ITEM), (2, "other words"), (3, ITEM + " and more"), (4, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(5, ITEM), (5, "too short"), (6, ITEM)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in lk.leaked_items(docs, items).collect()} == {(d, i) for d in (1, 3, 4) for i in (5, 6)}


def test_streams_are_joined_words():
    texts = [ITEM, None, "", "a-\nb <b>c</b> &amp; ½ ﬀ", "日本語のテキスト 々〇 ー", "x\u200by\u0301 İı ß ŉ"]
    chars, ends = lk.streams(texts, lk.compared())
    whole = "".join(map(chr, chars))
    starts = [0, *ends[:-1].tolist()]
    assert [whole[a:b] for a, b in zip(starts, ends, strict=True)] == ["".join(lk.words(t)) for t in texts]
    for size in (1, 5, 13):
        at, values = lk.sketches(chars, ends, size)
        for n, t in enumerate(texts):
            assert set(values[at == n].tolist()) == set(lk.sketch("".join(lk.words(t)), size).tolist())


def test_filter_holds_its_values(spark):
    values = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 3000)
    df = spark.createDataFrame([(int(v),) for v in values], "value long")
    bits = lk.make_filter(df, 3000)
    assert lk.in_filter(bits, values).all()
    assert lk.in_filter(bits, np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 3000)).mean() < 0.05


def test_sketch_matches_plain_definition():
    text = "abcdefghijklmnopqrstuvwxyz0123456789abcdefgh"
    chars = np.array([ord(c) for c in text], np.uint32)
    for k in (1, 2, 3, 7, 10, 20, 21):
        h = lk.shingle_hashes(chars, k)
        assert len(h) == len(text) - k + 1
        grams = [text[i : i + k] for i in range(len(h))]
        assert len(set(h.tolist())) == len(set(grams))
        assert lk.shingle_hashes(chars[5:], k).tolist() == h[5:].tolist()
        for w in (1, 2, 3, 5, 8, 11):
            assert lk.window_minima(h, w).tolist() == [min(h[i : i + w].tolist()) for i in range(len(h) - w + 1)]
