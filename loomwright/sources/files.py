"""Directories of submissions and of documents, and tables that hold either.

Files are listed once, level by level, and read in the executors (``listing``, ``reading``). No name goes through the driver,
and names are plain text throughout, never URI-encoded. Files of no bytes, and those whose names begin with ``_`` or ``.``,
which Spark's own file readers leave out, are files like others.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright import schemas
from loomwright.config import Settings
from loomwright.sources.listing import DocumentsNotFound, file_name, list_tree, open_store, require_directory
from loomwright.sources.reading import DDL, as_batch, contents

__all__ = ["LOADERS", "DocumentsNotFound", "documents_from_table", "file_name", "list_files", "pdf_loader", "read_documents", "read_files", "read_listed", "read_submissions", "register_loader", "require_directory", "write_files"]

#: Files that a task writes or reads, and bytes that it reads, on the average at most.
TASK_FILES, TASK_BYTES = 10_000, 64 << 20
#: From listed files of one extension to documents.
Loader = Callable[[DataFrame], DataFrame]


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``n_bytes``, ``modified`` of every file under a directory, at any depth, whose name fits the pattern."""
    found = list_tree(spark, path)
    return found if pattern == "*" else found.where(file_name(F.col("path")).rlike(fnmatch.translate(pattern).removesuffix(r"\Z") + r"\z"))


def _dealt(rows: DataFrame, key: str, n_bytes: str | None = None) -> DataFrame:
    """Rows that stand for a file each over as many tasks as they need: however many there are, a task's share isn't larger."""
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(n_bytes), F.lit(0)) if n_bytes else F.lit(0)).first()
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, -(-count // TASK_FILES), -(-size // TASK_BYTES)), key)


def read_listed(listed: DataFrame, limit: int | None = None) -> DataFrame:
    """Listed files with ``content`` and ``read_error``: one of them is null. Above ``limit`` bytes nothing is read, and both are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from map(as_batch, contents(rows, limit))

    return _dealt(listed.select("path", "n_bytes", "modified"), "path", "n_bytes").mapInArrow(read, DDL)


def read_files(spark: SparkSession, path: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    return read_listed(list_files(spark, path, pattern), limit)


def write_files(rows: DataFrame, path: str) -> None:
    """Each row's ``content`` as a file ``name`` (with folders, if it has them) under a directory that all executors see.

    A task that runs again writes the same files again. Rows of equal name leave one file; a null name or content makes none.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(path)
        store.create_dir(base, recursive=True)
        made = {base}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is not None and data is not None:
                    at = posixpath.join(base, name)
                    if (folder := posixpath.dirname(at)) not in made:
                        store.create_dir(folder, recursive=True)
                        if len(made) < TASK_FILES:
                            made.add(folder)
                    with store.open_output_stream(at) as out:
                        out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    _dealt(rows.select(F.col("name").cast("string"), F.col("content").cast("binary")), "name").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_submissions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Uploads from a directory: ``path``, ``content``, ``n_bytes``, ``filename``.

    Files above the limit (the settings' ``max_upload_bytes``, unless given) are listed but never read: their content
    is null, and ``n_bytes`` tells why. A file that can't be read has a ``read_error`` instead.
    """
    limit = Settings.load().max_upload_bytes if limit is None else limit
    return read_files(spark, path, limit=limit).drop("modified").withColumn("filename", file_name(F.col("path")))


def _content() -> Column:
    """The bytes of a document's file. A document that can't be read fails the job: an index without it would pass for whole."""
    return F.coalesce("content", F.raise_error(F.concat_ws(": ", "path", F.coalesce("read_error", F.lit("not read")))).cast("binary"))


def _text_loader(listed: DataFrame) -> DataFrame:
    """A document for each file; line ends of any kind become single line feeds."""
    return read_listed(listed).select(
        F.col("path").alias("source"),
        F.lit(None).cast("int").alias("page"),
        F.regexp_replace(F.make_valid_utf8(_content().cast("string")), r"\r\n?", "\n").alias("text"),
        F.create_map(F.lit("source"), "path").alias("metadata"),
    )


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page, by an optional library."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [page.get_text() for page in pdf]


def pdf_loader(pages: Callable[[bytes], list[str]] = pdf_pages) -> Loader:
    """A document for each page, with the page's number from 0."""

    def load(listed: DataFrame) -> DataFrame:
        def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for files in batches:
                rows = [(p, k, text) for p, c in zip(files["path"], files["content"], strict=True) for k, text in enumerate(pages(bytes(c)))]
                yield pd.DataFrame(rows, columns=["source", "page", "text"]).astype({"page": "int32"})

        found = read_listed(listed).select("path", _content().alias("content")).mapInPandas(explode, "source string, page int, text string")
        return found.withColumn("metadata", F.create_map(F.lit("source"), "source", F.lit("page"), F.col("page").cast("string")))

    return load


LOADERS: dict[str, Loader] = {".md": _text_loader, ".txt": _text_loader, ".pdf": pdf_loader()}


def register_loader(extension: str, loader: Loader) -> None:
    LOADERS[extension] = loader


def read_documents(spark: SparkSession, path: str, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """The documents under a directory, all registered extensions together (duplicates kept, no order). Other files are passed over.

    The tree is listed once for all extensions.
    """
    listed = list_files(spark, path)
    parts = [load(listed.where(F.endswith("path", F.lit(ext)))) for ext, load in (LOADERS if loaders is None else loaders).items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.DOCUMENT)


def documents_from_table(df: DataFrame, source: str = "doc_id", text: str = "text") -> DataFrame:
    """A table's rows as documents."""
    key = F.col(source).cast("string")
    return df.select(key.alias("source"), F.lit(None).cast("int").alias("page"), F.col(text).alias("text"), F.create_map(F.lit("source"), key).alias("metadata"))
