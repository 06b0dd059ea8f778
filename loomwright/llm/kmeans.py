"""Centroid clustering by kd-tree filtering, in whole numbers (operator 13).

Vectors become integers, so every sum is exact and no result depends on the order of rows. They are written once as trees:
each task cuts its rows into chunks of at most ``CHUNK`` and halves a chunk again and again at the median of its widest
component. A node has its count, its sums and its box. A round then goes down the trees level by level, with the centroids
that may be nearest to something in a node: the one nearest to the box's middle rules out every other that is farther from
the whole box, strictly, so ties are never touched. A node with one centroid left is assigned whole, by its count and sums;
the rows of a leaf with several are compared with these, exactly. Tasks report sums for each centroid, never rows.

Distances are computed as doubles where every product and sum is a whole number below 2 ** 53, else as 64-bit integers.

Cases: vectors that are null, of another width, or with a component that is null or not finite are left out, and so are those
with one beyond ``LARGEST``, whose squared distances 64 bits wouldn't hold; null ids are clustered, and come last as starting
centroids; equal vectors are rows like others; with fewer than ``k`` vectors each is a starting centroid; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import materialise, passing_tables

WIDTH, SCALE, K, ROUNDS = 64, 256, 40, 5
#: Rows of a tree, and about the rows of a leaf.
CHUNK, LEAF = 4096, 16
#: Components beyond it are left out: 64 products of eight times its square are below 2 ** 63.
LARGEST = 1 << 25


def whole_vectors(rows: DataFrame, column: str = "embedding", key: str = "vec_id", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``v`` (array of long): the vectors that can be clustered, as integers."""
    scaled = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale))
    limit = LARGEST / scale
    sound = (F.size(column) == width) & F.forall(column, lambda x: F.coalesce(x.cast("double").between(-limit, limit), F.lit(False)))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col(key).alias("vec_id"), scaled.alias("v"))


def starting(vectors: DataFrame, k: int = K, seed: int = 2, width: int = WIDTH) -> np.ndarray:
    """The ``k`` vectors of least hash, in ascending order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), width)


@dataclass
class Tree:
    """Rows in the order of the leaves; level ``d`` has 2 ** d nodes, which split the rows evenly: node ``i`` begins at ``bounds[d][i]``."""

    ids: pa.Array
    rows: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @classmethod
    def build(cls, ids: pa.Array, rows: np.ndarray, leaf: int = LEAF) -> Tree:
        order, n, depth = np.arange(len(rows)), len(rows), 0
        while n >> depth > leaf:
            depth += 1
        bounds = [np.array([n * i >> d for i in range((1 << d) + 1)]) for d in range(depth + 1)]
        for d in range(depth):
            for i in range(1 << d):
                x, y, cut = bounds[d][i], bounds[d][i + 1], bounds[d + 1][2 * i + 1]
                own = rows[order[x:y]]
                widest = int(np.argmax(own.max(0) - own.min(0)))
                order[x:y] = order[x:y][np.argpartition(own[:, widest], cut - x)]
        rows = rows[order]
        at = [b[:-1] for b in bounds]
        return cls(ids.take(pa.array(order)), rows, bounds, [np.minimum.reduceat(rows, a) for a in at], [np.maximum.reduceat(rows, a) for a in at], [np.add.reduceat(rows, a) for a in at])


def _kind(tree: Tree, centroids: np.ndarray) -> type:
    """Doubles if all products are exact there: squares of up to 2 ** 44 and 64 of them, with room for sums of three."""
    most = max(int(np.abs(tree.low[0]).max()), int(np.abs(tree.high[0]).max()), int(np.abs(centroids).max()))
    return np.float64 if most <= 1 << 21 else np.int64


def _filtered(alive: np.ndarray, low: np.ndarray, high: np.ndarray, c: np.ndarray, norms: np.ndarray) -> None:
    """Strike out, for each node, centroids that another is nearer than in every point of the node's box."""
    # Twice the middle stays whole: 4 d(z, middle) without what all z have in common.
    to_middle = np.where(alive, 4 * norms - 4 * (low + high) @ c.T, np.inf if c.dtype == np.float64 else np.iinfo(np.int64).max)
    best = to_middle.argmin(1)
    for z in np.unique(best):
        nodes = np.flatnonzero(best == z)
        u = c - c[z]
        # d(other, v) - d(z, v) is least at the corner v farthest in the direction from z to the other.
        reach = np.where(u > 0, u, 0) @ high[nodes].T + np.where(u < 0, u, 0) @ low[nodes].T
        least = (norms - norms[z])[:, None] - 2 * reach
        alive[nodes] &= (least <= 0).T


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the least number of equal ones), their counts and sums, and the distances computed for leaves."""
    kind = _kind(tree, centroids)
    c = centroids.astype(kind)
    norms = (c * c).sum(1)
    k, compared = len(c), 0
    cluster = np.zeros(len(tree.rows), np.int32)
    counts, sums = np.zeros(k, np.int64), np.zeros_like(centroids)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    for d in range(len(tree.bounds)):
        _filtered(alive, tree.low[d][nodes].astype(kind), tree.high[d][nodes].astype(kind), c, norms)
        one = alive.sum(1) == 1
        for node, z in zip(nodes[one], alive[one].argmax(1), strict=True):
            x, y = tree.bounds[d][node], tree.bounds[d][node + 1]
            cluster[x:y] = z
            counts[z] += y - x
            sums[z] += tree.sums[d][node]
        nodes, alive = nodes[~one], alive[~one]
        if d + 1 < len(tree.bounds):
            nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(alive, 2, axis=0)
    if len(nodes):
        size = tree.bounds[-1][nodes + 1] - tree.bounds[-1][nodes]
        at = np.repeat(tree.bounds[-1][nodes] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        distance = norms - 2 * (tree.rows[at].astype(kind) @ c.T)
        allowed = np.repeat(alive, size, axis=0)
        compared = int(allowed.sum())
        nearest = np.where(allowed, distance, np.inf if kind is np.float64 else np.iinfo(np.int64).max).argmin(1)
        cluster[at] = nearest
        counts += np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, tree.rows[at])
    return cluster, counts, sums, compared


_TREE = "ids array<{}>, rows binary, leaf int"


def _planted(vectors: DataFrame, width: int) -> DataFrame:
    """The vectors as rows of one tree each: its ids and its rows, in the order of its leaves."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def trees(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            while table.num_rows >= CHUNK or last and table.num_rows:
                part, table = table.slice(0, CHUNK).combine_chunks(), table.slice(CHUNK)
                rows = np.array(part.column(1).chunk(0).flatten(), np.int64).reshape(-1, width)
                tree = Tree.build(part.column(0).chunk(0), rows)
                ids = pa.ListArray.from_arrays(pa.array([0, len(tree.ids)], pa.int32()), tree.ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array([tree.rows.astype(np.int32).tobytes()], pa.binary()), pa.array([LEAF], pa.int32())], ["ids", "rows", "leaf"])
            held, n = table.to_batches(), table.num_rows

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from trees(False)
        if held:
            yield from trees(True)

    return vectors.select("vec_id", "v").mapInArrow(plant, _TREE.format(kind))


def _tree(ids: pa.Array, rows: bytes, width: int, leaf: int) -> Tree:
    """A stored tree: its rows have their order already, so only counts, sums and boxes are made again."""
    rows = np.frombuffer(rows, np.int32).astype(np.int64).reshape(-1, width)
    n, depth = len(rows), 0
    while n >> depth > leaf:
        depth += 1
    bounds = [np.array([n * i >> d for i in range((1 << d) + 1)]) for d in range(depth + 1)]
    at = bounds[-1][:-1]
    low, high, sums = [np.minimum.reduceat(rows, at)], [np.maximum.reduceat(rows, at)], [np.add.reduceat(rows, at)]
    for _ in range(depth):  # a node is its two halves together
        low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
        high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        sums.insert(0, sums[0][::2] + sums[0][1::2])
    return Tree(ids, rows, bounds, low, high, sums)


def _sums(trees: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """Number, count and sums of every centroid that has rows: so many rows of them reach the driver as there are centroids."""
    width = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            for ids, rows, leaf in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                _, n, s, _ = assign(_tree(ids.values, rows.as_py(), width, leaf.as_py()), centroids)
                counts += n
                sums += s
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["z", "n", "s"])

    parts = trees.mapInArrow(add, "z int, n long, s array<long>").select("z", "n", F.posexplode("s").alias("dim", "s"))
    total = parts.groupBy("z", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = total.groupBy("z").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("s")).collect()
    return [(r["z"], r["n"], [int(x["s"]) for x in r["s"]]) for r in found]


def _assigned(trees: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    width = centroids.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows, leaf in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                tree = _tree(ids.values, rows.as_py(), width, leaf.as_py())
                cluster, _, _, compared = assign(tree, centroids)
                apart = tree.rows - centroids[cluster]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster), pa.array((apart * apart).sum(1)), pa.array(np.full(len(cluster), compared))], ["vec_id", "cluster", "distance", "compared"])

    return trees.mapInArrow(nearest, f"vec_id {key}, cluster int, distance long, compared long").drop("compared")


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, column: str = "embedding", key: str = "vec_id", width: int = WIDTH, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each vector."""
    spark = rows.sparkSession
    with passing_tables(spark) as lasting:
        vectors = whole_vectors(rows, column, key, width, scale)
        kind = vectors.schema["vec_id"].dataType.simpleString()
        centroids = starting(vectors, k, seed, width)
        if not len(centroids):
            return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        trees = materialise(_planted(vectors, width), "kd-trees")
        for _ in range(rounds):
            centroids = centroids.copy()
            for z, n, s in _sums(trees, centroids):
                centroids[z] = [x // n for x in s]
        found = lasting(_assigned(trees, centroids, kind), "clusters")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    every = sum(inertia.values())
    named = [(z, inertia[z], every, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for z, c in enumerate(centroids) if z in inertia]
    shown = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(shown), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle() -> str:
    """The rounds one after another as DuckDB SQL, every vector against every centroid (for small tables)."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    nearest = lambda r: f"""near{r} AS MATERIALIZED (
  SELECT row, vec_id, v, z, CAST(distance AS BIGINT) AS distance FROM (
    SELECT row, vec_id, v, z, {square} AS distance FROM vectors, c{r}) QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, z) = 1
)"""  # noqa: E731
    moved = lambda r: f"""c{r + 1} AS MATERIALIZED (
  SELECT z, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT z, list(CAST(floor_div AS BIGINT) ORDER BY i) AS m FROM (
      SELECT z, i, (sum(v[i]) - (((sum(v[i]) % count(*)) + count(*)) % count(*))) // count(*) AS floor_div FROM near{r}, range(1, 65) AS d(i) GROUP BY z, i) GROUP BY z) USING (z)
)"""  # noqa: E731
    steps = ",\n".join(f"{nearest(r)},\n{moved(r)}" for r in range(ROUNDS))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS z, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM vectors ORDER BY h NULLS LAST, v LIMIT {K})
), {steps}, {nearest(ROUNDS)}
SELECT vec_id, CAST(z AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY z) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{ROUNDS} JOIN c{ROUNDS} USING (z)"""


ORACLE = _oracle()
