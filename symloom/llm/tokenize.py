"""Encoding a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised straight from the vocabulary: every
token becomes a piece under its own id, its bytes mapped one to one to
printable characters, scored by its negative rank so that the merge of lowest
rank comes first; the normaliser is the identity. Texts are cut into
pre-tokens, which are encoded one by one; decoding maps the pieces back.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from symloom.plans.tables import spread

#: Fixed value: the pre-token pattern that belongs to the public vocabulary.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Encoded pre-tokens a worker remembers before it starts anew.
REMEMBERED = 300_000


@lru_cache
def byte_characters() -> tuple[str, ...]:
    """A printable, non-blank character for each byte: itself where it is
    one in Latin-1, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in shown else chr(next(spare)) for b in range(256))


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's tokens by id; the file has a base64 token and its rank a line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def build_model(tokens: list[bytes], unknown: str = "<unk>") -> bytes:
    """The serialised sentencepiece model; the unknown piece, which no
    byte-mapped text can yield, takes the id after the last token."""
    normal, unknown_type, bpe = 1, 2, 2
    chars = byte_characters()
    pieces = [("".join(chars[b] for b in t), -float(rank), normal) for rank, t in enumerate(tokens)]
    pieces.append((unknown, 0.0, unknown_type))
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, score) + _field(3, kind)) for p, score, kind in pieces)
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43)) + _field(45, unknown.encode())
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return body + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoding and decoding of single texts with a serialised model."""

    def __init__(self, model: bytes, pattern: str = PRE_TOKENS) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.to_char = str.maketrans({i: c for i, c in enumerate(byte_characters())})
        self.to_byte = {c: b for b, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text; empty and null texts give an empty list."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        new = list({p for parts in cut for p in parts if p not in self.known})
        if new:
            mapped = [p.encode("utf-8").decode("latin-1").translate(self.to_char) for p in new]
            self.known.update(zip(new, self.model.encode(mapped, num_threads=1), strict=True))
        for parts in cut:
            yield [i for p in parts for i in self.known[p]]

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> str:
        data = bytes(self.to_byte[c] for i in ids for c in self.model.id_to_piece(int(i)))
        return data.decode("utf-8", "replace")


def encode_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PRE_TOKENS
) -> DataFrame:
    """``key`` and ``ids``, the token ids of each text without special tokens.

    Null and empty texts give an empty list, blank ones are encoded as they
    are, strings that look like special tokens are ordinary text. One row per
    input row, repeated rows included; a null key stays. There is a shuffle
    only where the table comes in fewer parts than there are cores. Further
    columns are ignored. The vocabulary's path must be readable by the driver;
    the model (about a megabyte) is broadcast.
    """
    model = df.sparkSession.sparkContext.broadcast(build_model(read_ranks(vocabulary)))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, pattern)
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, len(texts), 256):
                part = list(codec.encode_batch(texts.slice(start, 256).to_pylist()))
                ids = pa.array(part, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 256), ids], names=[key, "ids"])

    return spread(df.select(key, text), key).mapInArrow(run, schema)
