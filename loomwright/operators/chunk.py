"""Documents to chunks, from the DataFrame API and as table functions. Size and overlap are the settings', unless given."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

from loomwright.config import Settings
from loomwright.functions.chunking import split_text

#: Bytes of texts that are held as Python strings, with their chunks, at a time.
SLICE_BYTES = 2 << 20


def _sizes(size: int | None, overlap: int | None) -> tuple[int, int]:
    settings = Settings.load()
    return settings.chunk_size if size is None else size, settings.chunk_overlap if overlap is None else overlap


def slices(batches: Iterator[pa.Array], n_bytes: int, n_rows: int = 10_000) -> Iterator[pa.Array]:
    """Parts of the arrays, of at most so many rows and, unless it is one row, bytes. A batch of Spark's has up to 64 MB."""
    for texts in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + n_bytes, "right"))
            end = max(at + 1, min(end, at + n_rows))
            yield texts.slice(at, end - at)
            at = end


def chunks_of(text: Column, size: int | None = None, overlap: int | None = None) -> Column:
    """The chunks of a text as an array of strings."""
    size, overlap = _sizes(size, overlap)

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in slices(batches, SLICE_BYTES):
            yield pa.array([split_text(t, size, overlap) for t in some.to_pylist()], pa.list_(pa.string()))

    return split(text)


def chunk_documents(documents: DataFrame, size: int | None = None, overlap: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk of ``source, page, text, metadata``: same metadata, index, stable id and token estimate.

    The id hashes source, page, index and text, so a second run makes the same rows. Further columns go along if they
    are to be kept.
    """
    split = documents.select("source", "page", "metadata", *keep, F.posexplode(chunks_of(F.col("text"), size, overlap)).alias("chunk_index", "text"))
    page = F.coalesce(F.col("page").cast("string"), F.lit(""))
    chunk_id = F.sha2(F.concat_ws("\u0001", "source", page, F.col("chunk_index").cast("string"), "text"), 256)
    return split.select(
        chunk_id.alias("chunk_id"),
        "source",
        "page",
        "chunk_index",
        "text",
        "metadata",
        F.ceil(F.length("text") / 4).cast("int").alias("est_tokens"),
        *keep,
    )


def _free(names: list[str], wanted: str) -> str:
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def table_functions(size: int | None = None, overlap: int | None = None) -> dict[str, UserDefinedTableFunction]:
    """``chunk_text`` and ``chunk_documents`` for SQL. Size and overlap, where a call gives none, are those of now, not of a worker."""
    usual = _sizes(size, overlap)
    chosen = lambda size, overlap: (usual[0] if size is None else size, usual[1] if overlap is None else overlap)

    class ChunkText:
        """``chunk_text(text[, size, overlap])``: rows of ``chunk_index``, ``chunk``."""

        def eval(self, text: str, size: int | None = None, overlap: int | None = None) -> Iterator[tuple[int, str]]:
            yield from enumerate(split_text(text, *chosen(size, overlap)))

    class ChunkDocuments:
        """``chunk_documents(TABLE(t)[, size, overlap, text_column])``: the table's other columns, ``chunk_index`` and ``chunk``.

        A row for each chunk. The schema follows the table's; where it has columns of these two names, the new ones get
        an underscore at their end.
        """

        @staticmethod
        def analyze(table: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, text_column: AnalyzeArgument | None = None) -> AnalyzeResult:
            text = "text" if text_column is None else text_column.value
            if not table.isTable or text not in table.dataType.names:
                raise ValueError(f"chunk_documents needs a table with a column {text}")
            if not isinstance(table.dataType[text].dataType, T.StringType):
                raise ValueError(f"{text} isn't a string")
            rest = [f for f in table.dataType.fields if f.name != text]
            names = [f.name for f in rest]
            return AnalyzeResult(T.StructType([*rest, T.StructField(_free(names, "chunk_index"), T.IntegerType()), T.StructField(_free(names, "chunk"), T.StringType())]))

        def eval(self, row: Row, size: int | None = None, overlap: int | None = None, text_column: str = "text") -> Iterator[tuple]:
            at = row.__fields__.index(text_column)
            rest = (*row[:at], *row[at + 1 :])
            for k, chunk in enumerate(split_text(row[at], *chosen(size, overlap))):
                yield (*rest, k, chunk)

    return {"chunk_text": F.udtf(ChunkText, returnType="chunk_index int, chunk string"), "chunk_documents": F.udtf(ChunkDocuments)}
