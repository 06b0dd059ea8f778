"""Contents of listed files, read in the executors in batches of bounded size; a file that can't be read is a row that says why."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import batched

import pyarrow as pa

from loomwright.sources.listing import open_store

#: Bytes after which a batch is passed on, and rows.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 10_000
Listed = tuple[str, int, datetime | None]


def read_bytes(uri: str) -> bytes:
    store, at = open_store(uri)
    with store.open_input_stream(at) as file:
        return file.read()


def contents(listed: Iterable[Listed], limit: int | None = None, content: bool = True) -> Iterator[list[tuple]]:
    """Lists of rows (path, bytes, size, modified, content, error). Above ``limit`` bytes nothing is read."""
    for some in batched(listed, BATCH_ROWS):
        rows, held = [], 0
        for path, n_bytes, modified in some:
            data = error = None
            if content and (limit is None or n_bytes <= limit):
                try:
                    data = read_bytes(path)
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((path, n_bytes, modified, data, error))
            held += len(data or b"")
            if held >= BATCH_BYTES:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


SCHEMA = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("read_error", pa.string())])
DDL = "path string, n_bytes long, modified timestamp, content binary, read_error string"


def as_batch(rows: list[tuple], schema: pa.Schema = SCHEMA) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
