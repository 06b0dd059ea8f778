"""Listing of directory trees in the executors, level by level, whatever their shape.

A level is a table of folders, dealt over tasks; what they hold, files and further folders, is written to the shared folder,
and the folders found are the next level. So a tree of any depth, and a level of any width, needs no task that sees more than
its share, and no name passes the driver. A folder of more than ``PAGE`` entries is only counted at first: names that a hash
picks from all of them tell where to cut it into ranges of names, which are folders' rows like others in the next level, each
listed by a task of its own. Batches have at most ``PAGE`` names everywhere; sizes are asked for in the range's task.

Folders on the local file system are read entry by entry. Arrow's other stores give a folder's entries as one list, so there
the listing of one folder is held by its task, though not sent on at once. Symbolic links to folders aren't entered.
"""

from __future__ import annotations

import heapq
import os
import posixpath
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.storage import hadoop, scratch, written

#: Names in a batch at most, ranges of a crowded folder at most, and names that tell where it is cut.
PAGE, RANGES, PICKED = 10_000, 64, 4096
#: Tasks at most that are added to a level for its ranges.
RANGE_TASKS = 1024
_FOUND = "kind string, path string, low string, high string, n_bytes long, modified timestamp"
_ARROW = pa.schema([("kind", pa.string()), ("path", pa.string()), ("low", pa.string()), ("high", pa.string()), ("n_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


class DocumentsNotFound(FileNotFoundError):
    pass


def require_directory(spark: SparkSession, path: str) -> str:
    """The directory's full URI."""
    store, at = hadoop(spark, path)
    if not store.exists(at):
        raise DocumentsNotFound(f"Documents directory not found: {path}")
    return store.makeQualified(at).toString().rstrip("/")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the plain path in it. Local ones are taken as they are, whatever signs they hold."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    scheme, _, rest = uri.partition("://")
    host, _, path = rest.partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, posixpath.join(base, path)


@dataclass(frozen=True)
class Entry:
    name: str
    is_folder: bool
    n_bytes: int | None = None
    modified: datetime | None = None


@dataclass(frozen=True)
class Range:
    """A folder, or of its names those from ``low`` on and below ``high``."""

    folder: str
    low: str | None = None
    high: str | None = None

    @property
    def is_part(self) -> bool:
        return self.low is not None or self.high is not None

    def holds(self, name: str) -> bool:
        return (self.low is None or name >= self.low) and (self.high is None or name < self.high)


def _shown(name: str) -> str:
    """A name as text; bytes that are no UTF-8 are replaced (such a file is listed, and can't be read)."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def names(folder: str) -> Iterator[str]:
    """A folder's names, without their sizes; none if it has gone meanwhile."""
    store, base = open_store(folder)
    if isinstance(store, fs.LocalFileSystem):
        try:
            with os.scandir(base) as entries:
                yield from (_shown(e.name) for e in entries)
        except FileNotFoundError:
            return
    else:
        yield from (posixpath.basename(f.path) for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)))


def entries(part: Range) -> Iterator[Entry]:
    """What a range of a folder holds."""
    store, base = open_store(part.folder)
    if not isinstance(store, fs.LocalFileSystem):
        for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = posixpath.basename(f.path)
            if part.holds(name):
                yield Entry(name, f.type == fs.FileType.Directory, f.size, f.mtime)
        return
    try:
        with os.scandir(base) as found:
            for e in found:
                if not part.holds(_shown(e.name)):
                    continue
                if e.is_dir(follow_symlinks=False):
                    yield Entry(_shown(e.name), True)
                elif not e.is_dir():
                    try:
                        told = e.stat()
                    except FileNotFoundError:  # gone meanwhile, or a link to nothing
                        continue
                    yield Entry(_shown(e.name), False, told.st_size, datetime.fromtimestamp(told.st_mtime, UTC))
    except FileNotFoundError:
        return


def cut(folder: str, page: int | None = None) -> list[Range]:
    """A folder as it is to be listed: as a whole, or in ranges of names if it has more than ``page``."""
    page = PAGE if page is None else page
    count, picked = 0, []
    for name in names(folder):
        count += 1
        key = -zlib.crc32(name.encode())
        if len(picked) < PICKED:
            heapq.heappush(picked, (key, name))
        elif key > picked[0][0]:
            heapq.heapreplace(picked, (key, name))
    if count <= page:
        return [Range(folder)]
    ordered = sorted(name for _, name in picked)
    n = min(RANGES, -(-count // page), len(ordered))
    edges = sorted({ordered[len(ordered) * k // n] for k in range(1, n)})
    return [Range(folder, a, b) for a, b in zip([None, *edges], [*edges, None], strict=True)]


def _rows(part: Range) -> Iterator[tuple]:
    """What comes of one row of a level."""
    if not part.is_part and len(ranges := cut(part.folder)) > 1:
        yield from (("range", r.folder, r.low, r.high, None, None) for r in ranges)
        return
    for e in entries(part):
        yield ("folder" if e.is_folder else "file", f"{part.folder}/{e.name}", None, None, e.n_bytes, e.modified)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int | None = None) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, PAGE if size is None else size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _look(level: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in level:
        for path, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield from batches_of(_rows(Range(path, low, high)), _ARROW)


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``n_bytes``, ``modified`` of every file below a directory. Runs a job for each level of folders."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = scratch(spark, "listing")
    level, depth = spark.createDataFrame([(require_directory(spark, path), None, None)], "path string, low string, high string"), 0
    while True:
        found = written(level.mapInArrow(_look, _FOUND), f"{at}/level={depth}")
        level = found.where("kind <> 'file'").select("path", "low", "high")
        folders, ranges = level.agg(F.count("*"), F.count_if(F.coalesce("low", "high").isNotNull())).first()
        if not folders:
            break
        # A task for each range, as each goes through all names of its folder.
        level, depth = level.repartition(tasks + min(ranges, RANGE_TASKS), "path", "low"), depth + 1
    every = spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(at)
    return every.where("kind = 'file'").select("path", "n_bytes", "modified")


def file_name(path):
    """The last part of a plain path."""
    return F.element_at(F.split(path, "/"), -1)
