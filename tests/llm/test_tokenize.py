"""Token ids against an independent implementation, and round trips."""

import random

import pytest
import tiktoken

from symloom.llm import tokenize as tk

TEXTS = [
    "", None, " ", "\n\n \t ", "hello world", "It's we'll I'VE", "<|endoftext|> <unk> <s>", "naïve Ünïcödé ёлка 日本語テキスト", "a" * 5000, "x = {'a': 1}\r\n\tfoo()",
    "​­ ", "😀👨‍👩‍👧", "1234567890 ١٢٣", "Ġ Ċ ▁ under▁score", "\x00\x01\x7f", "  leading", "trailing  ",
]


@pytest.fixture(scope="module")
def codec():
    return tk.Codec(tk.build_model(tk.read_ranks()))


@pytest.fixture(scope="module")
def other():
    ranks = {t: i for i, t in enumerate(tk.read_ranks())}
    return tiktoken.Encoding("own", pat_str=tk.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(codec, other):
    rng = random.Random(7)
    alphabet = "abcdefgh  \n'.,éßжд日本😀́<>|_ABC0123"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == (other.encode_ordinary(text) if text else []), text
        assert codec.decode(ids) == (text or "")


def test_documents(spark, other):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, "again", "x"), (None, "null key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in tk.encode_documents(df).collect()), key=repr)
    assert got == sorted(((i, other.encode_ordinary(t) if t else []) for i, t, _ in rows), key=repr)
    assert tk.encode_documents(df.limit(0)).count() == 0


def test_test_documents(spark, other):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in tk.encode_documents(df).collect():
        assert r.ids == (other.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])
