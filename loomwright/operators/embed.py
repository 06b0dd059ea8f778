"""Texts to vectors through a pluggable encoder, loaded once in each worker."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.vectors import normalise
from loomwright.operators.chunk import SLICE_BYTES, slices

#: Texts that are encoded at a time.
SLICE_ROWS = 1024
Encode = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Encoder:
    """``load`` runs once in each worker and gives the function that encodes a batch of texts."""

    encoder_id: str
    dim: int
    load: Callable[[], Encode]


def sentence_encoder(model: str = "all-MiniLM-L6-v2", dim: int = 384) -> Encoder:
    """A local sentence model on the CPU. Its library is optional; without it the first batch fails with an ImportError."""

    def load() -> Encode:
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model, device="cpu")
        return lambda texts: loaded.encode(texts, normalize_embeddings=True).tolist()

    return Encoder(model, dim, load)


def hashing_encoder(dim: int = 64) -> Encoder:
    """Deterministic word hashing, for tests and offline runs. It carries no meaning: not a substitute for a model."""

    def load() -> Encode:
        def one(text: str) -> list[float]:
            out, hashes = [0.0] * dim, [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in re.findall(r"\w+", text.lower())]
            for h in hashes:
                out[h % dim] += 1.0 if h >> 63 else -1.0
            if not any(out):  # words that cancel one another out are counted without signs: only a text without words has no direction
                for h in hashes:
                    out[h % dim] += 1.0
            norm = math.sqrt(sum(x * x for x in out))
            return [x / norm for x in out] if norm else out

        return lambda texts: [one(t) for t in texts]

    return Encoder(f"hashing-{dim}", dim, load)


def embed(text: Column, encoder: Encoder) -> Column:
    load = encoder.load

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = load()
        for some in slices(batches, SLICE_BYTES, SLICE_ROWS):
            yield pa.array(run([t or "" for t in some.to_pylist()]), pa.list_(pa.float64()))

    return encode(text)


def index_chunks(chunks: DataFrame, encoder: Encoder, collection: str) -> DataFrame:
    """Chunks with normalised vectors and what tells which encoder made them."""
    encoded = chunks.withColumn("_vector", embed(F.col("text"), encoder))  # Python functions can't stand inside lambdas
    return encoded.select(
        *chunks.columns,
        normalise(F.col("_vector")).cast("array<float>").alias("embedding"),
        F.lit(encoder.encoder_id).alias("encoder_id"),
        F.lit(encoder.dim).alias("dim"),
        F.lit(collection).alias("collection"),
    )


class EncoderMismatch(ValueError):
    """An index and a query, or two parts of an index, come from different encoders."""


def check_encoder(index: DataFrame, encoder: Encoder) -> None:
    """Refuse an index that another encoder made, wholly or in part."""
    found = index.select("encoder_id", "dim").distinct().limit(2).collect()
    if any((r["encoder_id"], r["dim"]) != (encoder.encoder_id, encoder.dim) for r in found):
        raise EncoderMismatch(f"index has {[tuple(r) for r in found]}, the query {(encoder.encoder_id, encoder.dim)}")
