"""A directory or table of documents to an indexed collection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.config import Settings, configure_logging
from loomwright.operators.chunk import chunk_documents
from loomwright.operators.embed import Encoder, index_chunks
from loomwright.sources import collection as store
from loomwright.sources.collection import DEFAULT_COLLECTION
from loomwright.storage import scratch


@dataclass(frozen=True)
class Built:
    """Documents given, and chunks that the collection has; chunks that were encoded for it, and documents that left."""

    documents: int
    chunks: int
    encoded: int = field(default=0, compare=False)
    left: int = field(default=0, compare=False)


def count_by_extension(documents: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1))
    return documents.groupBy(extension.alias("extension")).agg(F.count("*").alias("documents"))


def build_knowledge_base(documents: DataFrame, path: str, encoder: Encoder, collection: str = DEFAULT_COLLECTION, size: int | None = None, overlap: int | None = None) -> Built:
    """Make a collection hold the chunks of these documents and no others. Only documents that it hasn't are cut and encoded.

    Size and overlap are those of the settings, unless given; with others than before everything is cut anew. Without
    documents nothing is touched. A collection of another encoder is refused (``EncoderMismatch``).
    """
    settings = Settings.load()
    size, overlap = settings.chunk_size if size is None else size, settings.chunk_overlap if overlap is None else overlap
    log, spark = configure_logging(settings), documents.sparkSession
    if documents.isEmpty():
        log.error("no documents to index; the collection stays as it is")
        return Built(0, 0)
    change = store.compare(spark, documents, path, collection, encoder, size, overlap, scratch(spark, "build"))
    chunks = chunk_documents(change.fresh, size, overlap, keep=("_doc",)).withColumnRenamed("_doc", "doc")
    told, encoded, left = store.commit(spark, change, index_chunks(chunks, encoder, collection), path, collection, encoder, size, overlap)
    built = Built(change.loaded, told.chunks, encoded, left)
    log.info("%s has %d chunks of %d documents, %d of them encoded anew", collection, built.chunks, built.documents, built.encoded)
    return built
