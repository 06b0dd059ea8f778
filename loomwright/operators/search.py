"""The nearest vectors to a query, by an exact scan (an extension, not a parity operator)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.vectors import dot, normalise
from loomwright.operators.embed import Encoder, EncoderMismatch, check_encoder
from loomwright.sources.collection import DEFAULT_COLLECTION, manifest, read_collection


def top_k_cosine(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding", encoder: Encoder | None = None) -> DataFrame:
    """The k rows most similar to a query vector, ties by key.

    An index that names its encoder is searched only with vectors of the same one, which the caller must name.
    """
    if "encoder_id" in vectors.columns:
        if encoder is None:
            raise EncoderMismatch("the index names its encoder: name the query's")
        check_encoder(vectors, encoder)
    array = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, dot(normalise(F.col(column)), normalise(array)).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def search_collection(spark: SparkSession, path: str, text: str, encoder: Encoder, k: int, collection: str = DEFAULT_COLLECTION) -> DataFrame:
    """The k chunks of a collection most similar to a text. That the encoder is the collection's is told by its manifest, before any scan."""
    told = manifest(spark, path, collection)
    if told is None:
        raise FileNotFoundError(f"no such collection: {path} {collection}")
    told.check(encoder)
    rows = read_collection(spark, path, collection, told.version).drop("encoder_id")
    return top_k_cosine(rows, encoder.load()([text])[0], k, "chunk_id")


def search(index: DataFrame, text: str, encoder: Encoder, k: int) -> DataFrame:
    """The k chunks of an index most similar to a text: ``chunk_id``, ``similarity``."""
    check_encoder(index, encoder)
    return top_k_cosine(index, encoder.load()([text])[0], k, "chunk_id", encoder=encoder)
