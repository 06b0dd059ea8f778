"""Files as a data source of Spark: ``spark.read.format("loomwright_files")``, from SQL, and ``readStream`` over a log of what was found.

Batch. The planner walks down from the root until it has ``units`` folders or ranges of names, or the tree ends; a task lists
and reads each of them, page by page. With the option ``listing`` (a table written by ``list_tree``) the partitions are its
parts instead, which suits trees that are too large to be walked by one process. Filters on name, extension, path and size
come before the reading: a file that they leave out is never opened.

Stream. ``discover`` lists the tree as Spark jobs and adds the files that the log doesn't have as its next version, published
in one step; what was seen is joined in Spark, so neither listing nor memory grows in one process. Offsets are versions of
the log, partitions its parts of at most ``PAGE`` files. A stream that restarts from its checkpoint goes on after the last
version that it finished, and reads the same files again for one that it didn't. Files should be moved into the folder whole.
"""

from __future__ import annotations

import posixpath
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.streaming import StreamingQuery

from loomwright.sources.listing import PAGE, Range, cut, entries, list_tree, open_store
from loomwright.sources.reading import Listed, as_batch, contents
from loomwright.storage import children, delete, publish

NAME = "loomwright_files"
_SCHEMA = pa.schema([("path", pa.string()), ("filename", pa.string()), ("extension", pa.string()), ("n_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("read_error", pa.string())])
_DDL = "path string, filename string, extension string, n_bytes long, modified timestamp, content binary, read_error string"


def extension(name: str) -> str:
    """The last dot and what follows, in lower case; empty without a dot."""
    return posixpath.splitext("_" + name)[1].lower()


@dataclass
class Unit(ds.InputPartition):
    """A folder or a range of its names, with all below it if ``deep``."""

    part: Range
    deep: bool


@dataclass
class Part(ds.InputPartition):
    """A file of a listing."""

    uri: str


def plan_units(root: str, units: int) -> list[Unit]:
    """Folders and ranges that together hold every file below the root once."""
    done: list[Unit] = []
    open_: list[str] = [root]
    while open_ and len(done) + len(open_) < units:
        folder = open_.pop(0)
        ranges = cut(folder)
        if len(ranges) > 1:  # their folders are left to the tasks
            done += [Unit(r, True) for r in ranges]
            continue
        done.append(Unit(ranges[0], False))
        open_ += [f"{folder}/{e.name}" for e in entries(ranges[0]) if e.is_folder]
    return done + [Unit(Range(f), True) for f in open_]


def walk(unit: Unit) -> Iterator[Listed]:
    """The files of a unit. Only folders that are still to be entered are kept."""
    open_ = [unit.part]
    while open_:
        part = open_.pop()
        for e in entries(part):
            if not e.is_folder:
                yield f"{part.folder}/{e.name}", e.n_bytes, e.modified
            elif unit.deep:
                open_.append(Range(f"{part.folder}/{e.name}"))


def part_files(uri: str) -> list[str]:
    """The files of a written table. Their number follows the tasks that wrote it, not the rows."""
    store, base = open_store(uri)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted(uri.rstrip("/") + f.path[len(base.rstrip("/")) :] for f in found if f.path.endswith(".parquet"))


def listed(uri: str) -> Iterator[Listed]:
    store, at = open_store(uri)
    with store.open_input_file(at) as file:
        for batch in pq.ParquetFile(file).iter_batches(PAGE):
            kind = batch.column("kind").to_pylist() if "kind" in batch.schema.names else ["file"] * batch.num_rows
            for k, *row in zip(kind, *(batch.column(c).to_pylist() for c in ("path", "n_bytes", "modified")), strict=True):
                if k == "file":
                    yield tuple(row)


_TESTS = {
    ds.EqualTo: lambda x, v: x == v,
    ds.In: lambda x, v: x in v,
    ds.GreaterThan: lambda x, v: x > v,
    ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.StringStartsWith: lambda x, v: x.startswith(v),
    ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.StringContains: lambda x, v: v in x,
    ds.IsNotNull: lambda x, v: True,
}
_KNOWN = ("path", "filename", "extension", "n_bytes")


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.content = options.get("content", "true").lower() == "true"
        self.limit = int(options["limit"]) if "limit" in options else None
        self.tests: list[tuple[type, str, object]] = []

    def batches(self, rows: Iterator[Listed]) -> Iterator[pa.RecordBatch]:
        for some in contents((r for r in rows if self._wanted(r)), self.limit, self.content):
            full = [(path, name := posixpath.basename(path), extension(name), *rest) for path, *rest in some]
            yield as_batch(full, _SCHEMA)

    def _wanted(self, row: Listed) -> bool:
        path, n_bytes, _ = row
        name = posixpath.basename(path)
        has = {"path": path, "filename": name, "extension": extension(name), "n_bytes": n_bytes}
        return all(_TESTS[kind](has[column], value) for kind, column, value in self.tests)


class FileReader(_Options, ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.root, self.listing, self.units = options.get("path"), options.get("listing"), int(options.get("units", 256))
        if not (self.root or self.listing):
            raise ValueError(f"{NAME} needs a path or a listing")

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _KNOWN:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        if self.listing:
            return [Part(p) for p in part_files(self.listing)]
        store, base = open_store(self.root)
        if store.get_file_info(base).type != fs.FileType.Directory:
            raise FileNotFoundError(f"Documents directory not found: {self.root}")
        return plan_units(self.root.rstrip("/"), self.units)

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.batches(walk(partition) if isinstance(partition, Unit) else listed(partition.uri))


class FileStream(_Options, ds.DataSourceStreamReader):
    """Files of the versions of a log."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        if "log" not in options:
            raise ValueError(f"a stream of {NAME} needs a log")
        self.log = options["log"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        store, base = open_store(self.log)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return {"version": max((int(n) for f in found if (n := posixpath.basename(f.path)).isdigit()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        return [Part(p) for v in range(start["version"] + 1, end["version"] + 1) for p in part_files(f"{self.log}/{v:012d}")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.batches(listed(partition.uri))


class FileSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))

    def streamReader(self, schema) -> FileStream:
        return FileStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileSource)


def discover(spark: SparkSession, path: str, log: str) -> int:
    """Add the files below a directory that the log doesn't have as its next version, if there are any; gives the last version."""
    log = log.rstrip("/")
    while True:
        last = max((int(v) for v in children(spark, log) if v.isdigit()), default=0)
        found = list_tree(spark, path)
        if last:
            known = spark.read.schema(found.schema).parquet(*[f"{log}/{v:012d}" for v in range(1, last + 1)])
            found = found.join(known.select("path"), "path", "left_anti")
        passing = f"{log}/passing-{uuid.uuid4().hex}"
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found.repartition(tasks, "path").write.option("maxRecordsPerFile", PAGE).parquet(passing)
        if spark.read.schema(found.schema).parquet(passing).isEmpty():
            delete(spark, passing)
            return last
        if publish(spark, passing, f"{log}/{last + 1:012d}"):
            return last + 1
        delete(spark, passing)  # another process was first: what it added isn't to be added twice


def stream(spark: SparkSession, log: str, limit: int | None = None) -> DataFrame:
    """The files of a log as a stream."""
    register(spark)
    reader = spark.readStream.format(NAME).option("log", log)
    return (reader if limit is None else reader.option("limit", limit)).load()


def keep_discovering(query: StreamingQuery, path: str, log: str, every: float = 10.0) -> threading.Thread:
    """Look for new files as long as the query runs."""
    spark = SparkSession.active()

    def run() -> None:
        while query.isActive:
            discover(spark, path, log)
            time.sleep(every)

    thread = threading.Thread(target=run, daemon=True, name="loomwright-discover")
    thread.start()
    return thread

