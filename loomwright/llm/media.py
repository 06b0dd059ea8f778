"""Media columns in archive directories, through a Spark data source of their own (operator 5).

Format ``media_archive``. Writing: each task streams its rows' payloads, as lossless 8-bit grey images of width 64,
into ZIP archives of about ``roll_mb`` and reports their names; only archives of tasks that succeeded enter the
manifest, which the driver writes last. A task that ran twice or died leaves a file that no manifest names.

Reading: the plan splits each archive of the manifest into byte ranges of ``range_mb``. A task takes the members
whose headers begin in its range, fetches each by its own offset, and retries that member alone, from a newly opened
archive, when a read fails, is short, or its checksum is wrong. Members leave in Arrow batches of at most ``batch_mb``.
The directory is opened through the file system that its URI names, on driver and executors alike.

Cases: a null payload is stored as an empty one; a null key stays null; repeated rows are members of their own;
an empty table leaves an empty manifest and reads as no rows; further columns are ignored. A member that stays damaged
is a row without media whose ``error`` says why, and null features; an archive whose own directory can't be read is
one such row, without a key. All other members are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomwright.llm.common import scratch

FORMAT = "media_archive"
MANIFEST = "manifest.json"
WIDTH = 64
MB = 1 << 20
ATTEMPTS = 4
WAIT = 0.2  # seconds before the second attempt
_LOCAL_HEADER = struct.Struct("<IHHHHHIIIHH")

T = TypeVar("T")
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


# --- the stored form -------------------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode_png(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grey image, a row for each ``WIDTH`` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered, level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an image as ``encode_png`` writes it (no filter), checked against its checksums."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)[::-1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows aren't expected")
    return rows[:, 1:]


def describe(media: bytes) -> tuple:
    """The columns of ``FEATURES`` after ``n_bytes``, from a stored image."""
    samples = decode_png(media)
    payload = samples.tobytes()
    counts = np.bincount(samples.ravel(), minlength=256) / samples.size
    entropy = -float((counts[counts > 0] * np.log2(counts[counts > 0])).sum())
    bands = np.array_split(samples.mean(1), 8) if len(samples) >= 8 else [samples.mean(1)] * 8
    means = np.array([b.mean() for b in bands])
    look = "".join("1" if m > means.mean() else "0" for m in means)
    feature = f"{samples.shape[0]}x{samples.shape[1]};mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};bands={look}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


# --- the archives ----------------------------------------------------------------------------------------------------


def filesystem(uri: str):  # noqa: ANN201
    """The file system of a URI, and the path in it. A plain path is a local (or mounted) one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


@dataclass
class Archives(WriterCommitMessage):
    names: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    name: str
    start: int
    stop: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.roll = int(options.get("roll_mb", 128)) * MB

    def write(self, batches: Iterator[pa.RecordBatch]) -> Archives:
        from pyspark import TaskContext

        files, path = filesystem(self.path)
        part = TaskContext.get().partitionId()
        done: list[tuple[str, int]] = []
        name, sink, archive, count = "", None, None, 0

        def close() -> None:
            archive.close()
            sink.close()
            done.append((name, files.get_file_info(f"{path}/{name}").size))

        for batch in batches:
            for key, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if archive is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.zip"
                    sink = files.open_output_stream(f"{path}/{name}")
                    archive, count = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), 0
                # The name holds the member's number, its key, and how long the payload is without padding.
                archive.writestr(zipfile.ZipInfo(f"{count}_{'' if key is None else key}_{n_bytes}.png"), media.as_py())
                count += 1
                if archive.start_dir >= self.roll:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Archives(done)

    def commit(self, messages: list[Archives | None]) -> None:
        files, path = filesystem(self.path)
        files.create_dir(path, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with files.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Archives | None]) -> None:
        files, path = filesystem(self.path)
        for m in messages:
            for name, _ in m.names if m is not None else ():
                files.delete_file(f"{path}/{name}")


#: What a store or an archive may fail with.
FAULTS = (OSError, EOFError, ValueError, NotImplementedError, struct.error, zipfile.BadZipFile, zlib.error)


def retried(read: Callable[[], T], attempts: int = ATTEMPTS, wait: float = WAIT, again: Callable[[], None] = lambda: None) -> T:
    """``read`` again, after growing waits and a call of ``again``, when the store fails or the bytes are short or damaged."""
    for k in range(attempts):
        try:
            return read()
        except FAULTS:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
            again()
    raise AssertionError


class Archive:
    """An archive that is opened when first needed, and again after ``close``."""

    def __init__(self, files, path: str) -> None:  # noqa: ANN001
        self.files, self.path, self.opened = files, path, None

    @property
    def file(self):  # noqa: ANN202
        if self.opened is None:
            self.opened = self.files.open_input_file(self.path)
        return self.opened

    def close(self) -> None:
        opened, self.opened = self.opened, None
        if opened is not None:
            with suppress(*FAULTS):
                opened.close()

    def members(self) -> list[zipfile.ZipInfo]:
        def read() -> list[zipfile.ZipInfo]:
            with zipfile.ZipFile(self.file) as archive:
                return archive.infolist()

        return retried(read, again=self.close)


def member(archive: Archive, info: zipfile.ZipInfo) -> bytes:
    """The bytes of a stored member, from its offset alone."""

    def read() -> bytes:
        file = archive.file
        file.seek(info.header_offset)
        head = file.read(_LOCAL_HEADER.size)
        fields = _LOCAL_HEADER.unpack(head)
        file.seek(info.header_offset + len(head) + fields[9] + fields[10])
        data = file.read(info.file_size)
        if fields[0] != 0x04034B50 or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise ValueError(f"member {info.filename} at {info.header_offset} is short or damaged")
        return data

    return retried(read, again=archive.close)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.range = int(options.get("range_mb", 16)) * MB
        self.batch = int(options.get("batch_mb", 4)) * MB

    def partitions(self) -> list[Range]:
        files, path = filesystem(self.path)

        def manifest() -> bytes:
            with files.open_input_stream(f"{path}/{MANIFEST}") as f:
                return f.read()

        names = json.loads(retried(manifest))
        ranges = [Range(name, at, min(size, at + self.range)) for name, size in names for at in range(0, size, self.range)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, path = filesystem(self.path)
        archive = Archive(files, f"{path}/{partition.name}")
        rows: list[tuple] = []
        size = 0
        try:
            try:
                mine = [i for i in archive.members() if partition.start <= i.header_offset < partition.stop]
            except FAULTS as e:
                mine = []
                if partition.start == 0:  # said once for the archive
                    rows.append((None, None, partition.name, None, f"{partition.name}: {type(e).__name__}: {e}"))
            for info in mine:
                _, key, n_bytes = info.filename.removesuffix(".png").split("_")
                media, error = None, None
                try:
                    media = member(archive, info)
                except FAULTS as e:
                    error = f"{partition.name}: {type(e).__name__}: {e}"
                rows.append((int(key) if key else None, int(n_bytes), f"{partition.name}:{info.header_offset}", media, error))
                size += len(media or b"")
                if size >= self.batch:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)
        finally:
            archive.close()

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("key", pa.int64()), ("n_bytes", pa.int64()), ("origin", pa.string()), ("media", pa.binary()), ("error", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key long, n_bytes long, origin string, media binary, error string"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options)


# --- the operator ----------------------------------------------------------------------------------------------------


def write_archives(payloads: DataFrame, path: str) -> None:
    """Store ``key`` and ``payload`` of each row as an image in archives under ``path``, a URI that all executors see."""

    @F.pandas_udf("n_bytes long, media binary")
    def media(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for data in batches:
            own = [b if b is not None else b"" for b in data]
            yield pd.DataFrame({"n_bytes": [len(b) for b in own], "media": [encode_png(padded(bytes(b))) for b in own]})

    files, local = filesystem(path)
    files.create_dir(local, recursive=True)
    payloads.sparkSession.dataSource.register(MediaArchive)
    rows = payloads.select("key", media("payload").alias("m")).select("key", "m.*")
    rows.write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format(FORMAT).load(path)


def media_features(archives: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``FEATURES``, all from the stored bytes, and ``error``."""

    @F.pandas_udf(FEATURES.replace("n_bytes long, ", "", 1))
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")][1:]
        for media in batches:
            rows = [describe(bytes(b)) if b is not None else (None,) * len(names) for b in media]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return archives.select(F.col("key").alias("doc_id"), "n_bytes", look("media").alias("f"), "error").select("doc_id", "n_bytes", "f.*", "error")


def store_and_describe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each document's text as an image in archives, read back and described."""
    spark = docs.sparkSession
    path = path or scratch(spark, "media")
    write_archives(docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("payload")), path)
    return media_features(read_archives(spark, path))
