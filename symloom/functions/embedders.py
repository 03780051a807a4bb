"""Turning names into vectors: an interface, the hash embedder, a model if there is one."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions.blake import hashes
from symloom.functions.scalars import HASH_DIM, hash_embedding


class Embedder(Protocol):
    """``column`` embeds a text column inside a plan, ``one`` a single text."""

    name: str
    dim: int

    def column(self, text: str | Column) -> Column: ...

    def one(self, text: str) -> list[float]: ...


class HashEmbedder:
    """32 numbers out of a text's hash: equal texts are equal, others unrelated."""

    name, dim = "hash", HASH_DIM

    def column(self, text: str | Column) -> Column:
        return hash_embedding(text)

    def one(self, text: str) -> list[float]:
        return [float(b) / 255 for b in hashes([text.encode()])[0]]


class ModelEmbedder:
    """A sentence model from a local folder, loaded once per worker. Needs the
    optional package ``sentence_transformers``."""

    def __init__(self, path: str) -> None:
        import sentence_transformers

        self.path, self.name = path, f"model:{path}"
        self._model = sentence_transformers.SentenceTransformer(path)
        self.dim = int(self._model.get_sentence_embedding_dimension())

    def column(self, text: str | Column) -> Column:
        path = self.path

        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import sentence_transformers

            model = sentence_transformers.SentenceTransformer(path)
            for batch in batches:
                yield pd.Series(list(model.encode(batch.fillna("").tolist())), dtype="object")

        embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(embed, T.ArrayType(T.FloatType()))(text)

    def one(self, text: str) -> list[float]:
        return [float(x) for x in self._model.encode([text])[0]]


def create_embedder(model_path: str | None = None) -> Embedder:
    """The model if a path is given and it loads, else the hash embedder with a warning."""
    if model_path:
        try:
            return ModelEmbedder(model_path)
        except Exception as e:  # noqa: BLE001  any failure to load means there is no model
            warnings.warn(f"no model at {model_path} ({e}); names are hashed instead", stacklevel=2)
    return HashEmbedder()
