"""Many queries against many vectors: exactly, in blocks; and through an inverted file that looks at the nearest cells only.

Exact search. Vectors are packed into blocks of ``BLOCK`` rows, queries likewise. Every block of vectors meets every block of
queries, as products of matrices of ``STRIP`` queries in a task, which keeps the best ``k`` of each query over all the blocks that
it gets and reports no others; a merge by query follows. No pair is ever a row.

Inverted file. Cells are fitted on a bounded sample of vectors (``SAMPLE`` rows by hash) by spherical k-means. Every vector is
then filed under its nearest cell as a residual of one byte for each component, in blocks that a cell has as many of as it
needs, beside the vectors themselves; the table is partitioned by groups of cells, so a search reads the groups that it probes.
A query meets the blocks of its nearest cells, keeps ``rerank * k`` of them by their codes, and these are ranked by their
vectors, exactly.

Vectors are compared by cosine; ties by key. A vector of length 0, or of another width, or with a null or a component that
isn't finite, is found by nothing and finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.storage import scratch, written

BLOCK = 2048
#: Queries that are compared with a block at a time.
STRIP = 128
SAMPLE, GROUPS = 20_000, 64
#: Bytes of packed queries that may be broadcast, after they were measured.
BROADCAST_BYTES = 64 << 20


def _sound(rows: DataFrame, key: str, column: str, width: int) -> DataFrame:
    fine = (F.size(column) == width) & F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))) & F.exists(column, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))


def width_of(rows: DataFrame, column: str) -> int:
    found = rows.where(F.size(column) > 0).select(F.size(column)).first()
    return found[0] if found else 0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    m = np.array(column.flatten(), np.float64).reshape(-1, width)
    return m / np.sqrt((m * m).sum(1))[:, None]


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """``ids`` and ``m`` (unit vectors, one after another) of at most ``BLOCK`` rows of a task each."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            while rest.num_rows >= BLOCK:
                yield block(rest.slice(0, BLOCK))
                rest = rest.slice(BLOCK)
        if rest is not None and rest.num_rows:
            yield block(rest)

    def block(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids = table.column(0).chunk(0)
        m = _matrix(table.column(1).chunk(0), width)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([m.tobytes()], pa.binary())], ["ids", "m"])

    return rows.mapInArrow(pack, f"ids array<{kind}>, m binary")


class _Best:
    """The ``k`` best of each query in a task: similarities descending, ties by key.

    Queries are taken ``STRIP`` at a time, and of what a strip meets only what may be among the best is kept. So what a task
    holds besides its blocks is a few matrices of ``STRIP`` rows, however large the tables are.
    """

    def __init__(self, queries: pa.Array, k: int) -> None:
        self.queries, self.k = queries, k
        #: By the strip's first query: queries, keys and similarities, in order.
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def meet(self, keys: np.ndarray, scores: Callable[[slice], np.ndarray]) -> None:
        """``scores`` gives the similarities of some queries and all ``keys``; those that aren't finite don't count."""
        for first in range(0, len(self.queries), STRIP):
            self._add(first, keys, scores(slice(first, first + STRIP)))

    def _add(self, first: int, keys: np.ndarray, scores: np.ndarray) -> None:
        may = np.isfinite(scores)
        if scores.shape[1] > self.k:  # everything that may be among the best, ties at the end included
            may &= scores >= np.fmax(-np.inf, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])[:, None]
        if first in self.held:
            own, _, held = self.held[first]
            full = np.flatnonzero(np.bincount(own - first, minlength=len(scores)) == self.k)
            may[full] &= scores[full] >= held[np.searchsorted(own, full + first, "right") - 1][:, None]
        row, column = np.nonzero(may)
        found = row + first, keys[column], scores[row, column]
        if first in self.held:
            found = tuple(np.concatenate(x) for x in zip(self.held[first], found, strict=True))
        order = np.lexsort((found[1], -found[2], found[0]))
        query, key, score = (x[order] for x in found)
        best = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.held[first] = query[best], key[best], score[best]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for query, key, score in self.held.values():
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(query)), pa.array(key), pa.array(score)], ["query", "id", "similarity"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query``, ``rank``, ``id``, ``similarity``: the k vectors most similar to each query, exactly."""
    spark, width = vectors.sparkSession, width_of(vectors, column)
    kind = vectors.schema[key].dataType.simpleString()
    asked = written(_packed(_sound(queries, key, column, width), width).withColumn("block", F.monotonically_increasing_id()), scratch(spark, "query-blocks"))
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("m"))).first()
    if not n:
        return spark.createDataFrame([], f"query {kind}, rank int, id {kind}, similarity double")
    places = asked.select("block").withColumn("place", F.row_number().over(Window.orderBy("block")) - 1)  # a number for each block of queries
    blocks = asked.join(F.broadcast(places), "block").select("place", F.col("ids").alias("asked"), F.col("m").alias("q"))
    every = _packed(_sound(vectors, key, column, width), width).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = every.join(F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks, "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for place, ids, m, asked_, q in zip(*batch.columns, strict=True):
                if place.as_py() not in best:
                    if len(best) >= 64:  # bounded: what is held goes to the merge
                        for b in best.values():
                            yield from b.rows()
                        best = {}
                    best[place.as_py()] = _Best(asked_.values, k)
                a, b = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width) for x in (q, m))
                best[place.as_py()].meet(ids.values.to_numpy(zero_copy_only=False), lambda strip, a=a, b=b: a[strip] @ b.T)
        for b in best.values():
            yield from b.rows()

    found = met.select("place", "ids", "m", "asked", "q").mapInArrow(compare, f"query {kind}, id {kind}, similarity double")
    return _merged(found, k).select("query", "rank", "id", "similarity")


# --- the inverted file ---


def fit_cells(vectors: DataFrame, cells: int, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centres of cells, from the ``sample`` vectors of least hash."""
    width = width_of(vectors, column)
    rows = _sound(vectors, key, column, width).withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(17))).orderBy("h", "id").limit(sample).select("v")
    m = np.array([r["v"] for r in rows.collect()], np.float64).reshape(-1, max(1, width))
    if not len(m):
        return np.zeros((1, max(1, width)))
    m /= np.sqrt((m * m).sum(1))[:, None]
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)].copy()
    for _ in range(rounds):
        own = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        length = np.sqrt((sums * sums).sum(1))
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """A written inverted file: blocks of a cell's vectors, as codes and as they are."""

    path: str
    centres: np.ndarray
    key_type: str
    #: What one step of a code is worth.
    step: float

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def group_of(cell, cells: int):
    """Folder of a cell."""
    return cell % min(GROUPS, cells)


def build_index(vectors: DataFrame, path: str, cells: int = 64, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE) -> VectorIndex:
    """File every vector. Cells are fitted on a sample; rows of a cell may come from any number of tasks, each in blocks of its own."""
    spark, width = vectors.sparkSession, width_of(vectors, column)
    centres = fit_cells(vectors, cells, key, column, sample)
    kind, step, n = vectors.schema[key].dataType.simpleString(), 2 / 127, len(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_matrix(batch.column(1), width) @ centres.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None
        for batch in batches:  # sorted by cell
            own = batch.column(2).to_numpy()
            at = 0
            while at < batch.num_rows:
                end = at + int(np.searchsorted(own[at:], own[at], "right"))
                if own[at] != cell or sum(b.num_rows for b in held) + end - at > BLOCK:
                    yield from blocks(held)
                    held, cell = [], own[at]
                held.append(batch.slice(at, end - at))
                at = end
        yield from blocks(held)

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        for at in range(0, table.num_rows, BLOCK):
            part = table.slice(at, BLOCK).combine_chunks()
            ids, cell = part.column(0).chunk(0), int(part.column(2)[0].as_py())
            m = _matrix(part.column(1).chunk(0), width)
            codes = np.clip(np.rint((m - centres[cell]) / step), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group_of(cell, n)], pa.int32()), pa.array([cell], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([codes.tobytes()], pa.binary()), pa.array([m.astype(np.float32).tobytes()], pa.binary())],
                ["cell_group", "cell", "ids", "codes", "m"],
            )

    placed = _sound(vectors, key, column, width).mapInArrow(place, f"id {kind}, v array<double>, cell int")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A cell goes to as many tasks as it has lots of rows, drawn by key; so a crowded cell fills none.
    lots = placed.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(max(1, tasks // 4))))
    filed = lots.repartition(tasks, "cell", "lot").sortWithinPartitions("cell").select("id", "v", "cell").mapInArrow(file, f"cell_group int, cell int, ids array<{kind}>, codes binary, m binary")
    filed.write.partitionBy("cell_group").option("compression", "zstd").parquet(path)
    return VectorIndex(path, centres, kind, step)


def search_index(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, key: str = "vec_id", column: str = "embedding", rerank: int = 4) -> DataFrame:
    """``query``, ``rank``, ``id``, ``similarity`` of the k best in the ``probes`` cells nearest to each query."""
    centres, step, width = index.centres, index.step, index.centres.shape[1]
    n, kind, probes = len(centres), index.key_type, min(probes, len(centres))
    own = queries.schema[key].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.argsort(-(_matrix(batch.column(1), width) @ centres.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.ravel().astype(np.int32))], ["id", "v", "cell"])

    probed = _sound(queries, key, column, width).mapInArrow(probe, f"id {own}, v array<double>, cell int")
    # At most BLOCK queries of a cell in one row.
    lot = F.floor((F.row_number().over(Window.partitionBy("cell", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")) - 1) / (BLOCK // 64))
    asked = probed.withColumn("lot", lot).withColumn("salt", F.when(F.col("lot") > 0, F.pmod(F.xxhash64("id"), F.lit(64))).otherwise(0))
    asked = asked.groupBy("cell", "lot", "salt").agg(F.collect_list(F.struct("id", "v")).alias("asked")).select("cell", F.col("asked.id").alias("asked"), F.flatten("asked.v").alias("q"))
    asked = written(asked, scratch(spark, "probes"))
    wanted = sorted({group_of(r["cell"], n) for r in asked.select("cell").distinct().collect()})  # no more than there are cells
    table = index.table(spark).where(F.col("cell_group").isin(wanted)).drop("cell_group")
    met = table.join(asked, "cell").select("cell", "ids", "codes", "m", "asked", "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, codes, m, asked_, q in zip(*batch.columns, strict=True):
                a = np.array(q.values, np.float64).reshape(-1, width)
                a /= np.sqrt((a * a).sum(1))[:, None]
                code = np.frombuffer(codes.as_buffer(), np.int8).reshape(-1, width).astype(np.float32)
                true = np.frombuffer(m.as_buffer(), np.float32).reshape(-1, width)

                def scores(strip: slice, a=a, code=code, true=true) -> np.ndarray:
                    rough = step * (a[strip].astype(np.float32) @ code.T)  # the cell's own share is the same for all
                    some = min(rerank * k, rough.shape[1])
                    short = np.argpartition(-rough, some - 1, axis=1)[:, :some]
                    exact = np.full(rough.shape, -np.inf)
                    np.put_along_axis(exact, short, np.einsum("qd,qsd->qs", a[strip], true[short].astype(np.float64)), 1)
                    return exact

                best = _Best(asked_.values, k)
                best.meet(ids.values.to_numpy(zero_copy_only=False), scores)
                yield from best.rows()

    found = met.mapInArrow(compare, f"query {own}, id {kind}, similarity double")
    return _merged(found, k).select("query", "rank", "id", "similarity")
