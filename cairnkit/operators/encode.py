"""Embedding operators: a text column to an array of numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnkit.exceptions import EncodingError
from cairnkit.functions import worker
from cairnkit.functions.text import let

DIM = 384
MODEL = "sentence-transformers/all-MiniLM-L6-v2"
BATCH = 32


def fake(text: Column, dim: int = DIM) -> Column:
    """A unit vector made of the SHA-256 of the text: byte i mod 32 at place i."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        there = texts.is_valid().to_numpy(zero_copy_only=False)
        digests = b"".join([sha256(t).digest() for t in texts.cast(pa.binary()).to_pylist() if t is not None])
        raw = np.frombuffer(digests, np.uint8).reshape(-1, 32).astype(np.float64) / 255
        raw = np.tile(raw, -(-dim // 32))[:, :dim]
        length = np.sqrt(np.cumsum(raw * raw, axis=1)[:, -1:])  # added from left to right
        unit = np.divide(raw, length, out=raw, where=length != 0)
        ends = np.concatenate([[0], np.cumsum(there * dim)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()), mask=pa.array(~there))

    worker.bound()
    return run(text)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """v by its length; a zero vector as it is."""
    return let(v.cast("array<double>"), lambda x: let(norm(x), lambda n: F.when(n == 0, x).otherwise(F.transform(x, lambda y: y / n))))


def align(v: Column, dim: int) -> Column:
    """v cut, or filled with zeros, to dim places; its length isn't made 1 again."""
    v = v.cast("array<double>")
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def from_encoder(encoder: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function of any encoder of lists of texts, run in Arrow batches on the workers."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[float] | None] = [None] * len(texts)
            there = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(there), batch):
                part = there[at : at + batch]
                for i, v in zip(part, encoder([texts.iloc[i] for i in part]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)

    return run


class SentenceEncoder:
    """A sentence-transformers model, loaded once in each worker; the library must be installed there."""

    def __init__(self, model: str = MODEL, dim: int = DIM, batch: int = BATCH):
        self.model, self.dim, self.batch, self._loaded = model, dim, batch, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self._loaded is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise EncodingError("sentence-transformers is not installed") from e
            self._loaded = SentenceTransformer(self.model)
        found = self._loaded.encode(texts, batch_size=self.batch, normalize_embeddings=True)
        return [[*map(float, v[: self.dim]), *[0.0] * (self.dim - len(v))] for v in found]


def build(mode: str = "sbert", model: str = MODEL, dim: int = DIM) -> Callable[[Column], Column]:
    """The column function of a mode: `fake`, or `sbert` under any of its names."""
    name = mode.strip().lower()
    if name == "fake":
        return lambda text: fake(text, dim)
    if name in ("sbert", "real", "sentence_transformers"):
        return from_encoder(SentenceEncoder(model, dim))
    raise EncodingError(f"unknown embedding mode {mode}")


def encode(text: Column, encoder: Callable | None = None, mode: str = "sbert", model: str = MODEL, dim: int = DIM) -> Column:
    """With an encoder of one's own, or else that of the mode."""
    return from_encoder(encoder)(text) if encoder is not None else build(mode, model, dim)(text)
