"""Near duplicates by a chosen-path similarity join on word shingles (operator 3).

A text is the set of its stretches of five words, hashed to 64 bits; two texts are linked when the Jaccard
similarity of their sets is at least 0.8. Steps, none of which needs the rows of a key in one task:

1. One pass over the texts gives each its set's fingerprint and a signature of ``WIDTH`` min-hash values: sampled
   tokens, which two sets share with the probability of their similarity. Equal sets become one *set* from here on.
2. Chosen paths: in each of ``RUNS`` independent trees a set goes to ``FANOUT`` children of its node, one for each
   position that a hash of the node picks and the token that it has there. Nodes with more than ``LIMIT`` sets are
   split again, all others are leaves.
3. A node that mostly stays together when split is dense: its sets share a passage, or are copies of one text, and the
   tokens that all of them have tell nothing apart. There the paths go on over the rare tokens. A bounded sample of
   the node tells which tokens are common (in ``CORE`` of it or more). Two sets of similarity s share one of their
   rarest (1 - s) * n + 1 tokens; each of those that isn't common is a leaf. Sets that share none but common tokens
   differ in all their others, so one of them has at most (1 - s) / (1 + s) of its tokens outside the core: such near
   sets are compared with one another, and with those somewhat farther off, in blocks; two far sets never. The same holds
   of a leaf: a set is far there if more than that share of its tokens is rarer than the leaf's, as then only a smaller
   set can be similar, which isn't far. A leaf that is still crowded, for its token is that of a section which many texts
   share, is a dense node again, with a sample and an order of its own, ``LAYERS`` times at most. What is left after
   ``DEPTH`` levels is treated alike, so nothing is dropped, and this step loses no pair.
4. Each pair of sets is looked at in one leaf only, the least of those in which both are compared. Sizes and signatures
   screen the pairs of a leaf; sets with a partner left get their shingles there, by another pass over the texts that
   need it, and their similarity is computed from them.
5. A block reports a number of links for each set, and edges to a root of its own linked sets. Labels spread along
   the edges until each class has one.

Runs. With two positions for each node, a pair of similarity s stays together below a node with probability
1 - (1 - s) ** 2, and in a tree of any depth with at least 1 - q, for the least root q of q = (1 - s + s * q) ** 2:
15/16 at 0.8. Runs are added until 1 - q ** runs reaches ``RECALL``.

Cases: a null text counts as empty; a text without words is linked to nothing, not even to another such text; one of
fewer than five words has the one shingle of all its words; null ids stay null and such rows take part; equal rows
are rows of one class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Bloom, fresh, materialise, passing_tables
from loomwright.llm.words import mix, stretches, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
WIDTH = 64  # min-hash values of a signature
FANOUT = 2
LIMIT = 128
#: Sets in a block of a dense node.
BLOCK = 256
DEPTH = 12
#: A split keeps this share of a node together: the node is dense. From 1 / sqrt(FANOUT) on splits don't save pairs.
DENSE = 0.7
#: Sets of a dense node that are looked at for its common tokens (about), and the share of them that has a common one.
SAMPLE, CORE = 256, 0.5
#: A leaf of a dense node with more sets is taken for a dense node itself, so many times at most. Below, comparing costs less.
CROWDED, LAYERS = 1 << 13, 2
#: A pair is screened out when fewer of its signatures' values agree; at 0.8 that is 4 standard deviations off.
SCREEN = 0.6

def runs(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Trees needed for the recall of pairs at the threshold."""
    lost = 0.0
    for _ in range(10_000):
        lost = (1 - similarity + similarity * lost) ** FANOUT
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(lost, 1e-12))))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the stretches of ``size`` words (runs of anything but ASCII white space)."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]
    return np.unique(stretches(words, size)) if len(words) else np.zeros(0, np.uint64)


#: Tokens that are hashed at a time.
_STRIPE = 2048
_SEEDS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(tokens: np.ndarray) -> np.ndarray:
    """For each position the least of the tokens' hashes, as 32 bits: the upper half of products with odd numbers."""
    out = np.full(WIDTH, np.iinfo(np.uint64).max)
    for at in range(0, len(tokens), _STRIPE):
        np.minimum(out, np.multiply.outer(_SEEDS, tokens[at : at + _STRIPE]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def fingerprint(tokens: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _described(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``th`` (hash of the text), ``fp``, ``n`` (tokens), ``sig`` of each document; fp and sig null without words."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, sigs = [], [], []
            for text in batch.column(2):
                tokens = shingles(text.as_py())
                sizes.append(len(tokens))
                fps.append(fingerprint(tokens) if len(tokens) else None)
                sigs.append(signature(tokens).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "th", "fp", "n", "sig"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(describe, "doc_id long, th long, fp binary, n int, sig binary")


def _children(node: np.ndarray, level: int, sigs: np.ndarray) -> np.ndarray:
    """The children of each row's node that the row goes to, as one column for each of ``FANOUT``."""
    seed = mix(node + np.uint64(level))
    picks = []
    for k in range(FANOUT):
        at = (mix(seed + np.uint64(k + 1)) % np.uint64(WIDTH)).astype(np.int64)
        if k:  # another position than before
            at = np.where(at == last, (at + 1) % WIDTH, at)
        last = at
        value = sigs[np.arange(len(at)), at].astype(np.uint64)
        picks.append(mix(seed ^ mix(value + (at.astype(np.uint64) << np.uint64(32)))))
    return np.stack(picks, 1)


def _split(rows: DataFrame, level: int) -> DataFrame:
    """``parent``, ``node``, ``fp`` from ``node``, ``fp``, ``sig``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.array(batch.column(0), np.int64).view(np.uint64)
            sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, WIDTH)
            made = _children(node, level, sigs)
            take = pa.array(np.repeat(np.arange(len(node)), FANOUT))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(made.ravel().view(np.int64)), batch.column(1).take(take)], ["parent", "node", "fp"])

    return rows.select("node", "fp", "sig").mapInArrow(split, "parent long, node long, fp binary")


def _leaves(sets: DataFrame, n_runs: int) -> tuple[DataFrame, DataFrame | None]:
    """``leaf``, ``fp`` of leaves of two sets or more; ``node``, ``fp``, ``count`` of dense nodes, if there are any."""
    roots = F.array(*[F.lit(r + 1).cast("long") for r in range(n_runs)])
    level = materialise(_split(sets.select(F.explode(roots).alias("node"), "fp", "sig"), 0), "paths")
    found: list[DataFrame] = []
    crowded: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        sizes = materialise(level.groupBy("parent", "node").count().where(F.col("count") > 1), "path-sizes")
        big = sizes.where(F.col("count") > LIMIT)
        small = sizes.where(F.col("count") <= LIMIT).select("node")
        found.append(level.join(small, "node").select(F.col("node").alias("leaf"), "fp"))
        if big.isEmpty():
            break
        rows = materialise(level.join(big.select("node", "count"), "node").select("node", "fp", "count"), "paths")
        if depth == DEPTH:
            crowded.append(rows)
            break
        level = materialise(_split(rows.join(sets.select("fp", "sig"), "fp"), depth), "paths")
        # A node is dense when one of its children keeps most of it.
        shares = level.groupBy("parent", "node").count().groupBy("parent").agg(F.max("count").alias("most"))
        sized = big.select(F.col("node").alias("parent"), "count")
        dense = materialise(sized.join(shares, "parent").where(F.col("most") >= DENSE * F.col("count")).select("parent"), "path-dense")
        if not dense.isEmpty():
            crowded.append(rows.join(dense.withColumnRenamed("parent", "node"), "node").select("node", "fp", "count"))
            level = level.join(dense, "parent", "left_anti")
    return materialise(reduce(DataFrame.unionByName, found), "leaves"), materialise(reduce(DataFrame.unionByName, crowded), "crowd") if crowded else None


def _cores(crowd: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each dense ``node`` what its sample knows of its tokens: ``seen``, those of two sampled sets or more, with their ``times``, and ``asked``, the sampled sets."""
    drawn = F.pmod(F.xxhash64("fp", "node"), F.lit(1 << 30)) < F.lit(SAMPLE) / F.col("count") * float(1 << 30)

    def count(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        names, times = np.unique(np.concatenate(sets), return_counts=True)
        names, times = names[times > 1], times[times > 1]
        return pa.table({"node": table.column("node")[:1], "asked": pa.array([len(sets)], pa.int32()), "seen": pa.array([names.tobytes()], pa.binary()), "times": pa.array([times.astype(np.int32).tobytes()], pa.binary())})

    return crowd.where(drawn).select("node", "fp").join(tokens, "fp").select("node", "tokens").groupBy("node").applyInArrow(count, "node long, asked int, seen binary, times binary")


def _rare_leaves(crowd: DataFrame, tokens: DataFrame, similarity: float, layer: int = 0) -> DataFrame:
    """``leaf``, ``fp``, ``far``, ``core`` that bring together every similar pair of a dense node.

    A leaf is named by its token, so that the dense nodes of several trees that hold the same sets make the same
    leaves; the leaf of near sets (``core``) by the least of its common tokens. In further layers the node is part of the name.
    """
    cores = materialise(_cores(crowd, tokens), "cores")
    rows = crowd.select("node", "fp").join(cores, "node", "left").join(tokens, "fp").select("fp", "asked", "seen", "times", "tokens", "node")
    near, most = (1 - similarity) / (1 + similarity) + 1e-9, (1 - similarity) / similarity + 1e-9

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, fps, far, core = [], [], [], []

            def put(names: np.ndarray, node: int, fp: bytes, is_far: np.ndarray, is_core: bool) -> None:
                leaves.append(mix(names ^ mix(np.array([node], np.int64).view(np.uint64))) if layer else names)
                fps.extend([fp] * len(names))
                far.append(is_far)
                core.extend([is_core] * len(names))

            for fp, asked, seen, times, own, node in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                own = np.frombuffer(own, np.uint64)
                known, often = np.frombuffer(seen or b"", np.uint64), np.frombuffer(times or b"", np.int32)
                count = np.zeros(len(own), np.int32)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    count = np.where(known[at] == own, often[at], 0)
                is_core = count >= max(2, CORE * (asked or 0))
                rare = np.flatnonzero(~is_core)
                first = rare[np.argsort(count[rare], kind="stable")][: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
                put(mix(own[first]), node, fp, np.arange(len(first)) > near * len(own), False)
                common = known[often >= max(2, CORE * (asked or 0))]
                if len(common) and len(rare) <= most * len(own):
                    put(mix(mix(common[:1])), node, fp, np.array([len(rare) > near * len(own)]), True)
            names = np.concatenate([*leaves, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(fps, pa.binary()), pa.array(np.concatenate([*far, np.zeros(0, bool)])), pa.array(core, pa.bool_())], ["leaf", "fp", "far", "core"])

    return rows.mapInArrow(go_on, "leaf long, fp binary, far boolean, core boolean").groupBy("leaf", "fp").agg(F.min("far").alias("far"), F.min("core").alias("core"))


def _dense_leaves(crowd: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """``leaf``, ``fp``, ``far``, ``blocks``, ``farther`` of dense nodes, crowded leaves gone through again."""
    found: list[DataFrame] = []
    for layer in range(LAYERS + 1):
        rare = materialise(_merged(materialise(_rare_leaves(crowd, tokens, similarity, layer), "leaves")), "leaves")
        sizes = rare.groupBy("leaf").agg(F.count("*").alias("all"), F.count_if(F.col("far")).alias("away"), F.max("core").alias("core"))
        sizes = materialise(sizes.where((F.col("all") > 1) & (F.col("all") > F.col("away"))), "leaf-sizes")
        again = sizes.where((F.col("all") > CROWDED) & ~F.col("core")) if layer < LAYERS else sizes.where(F.lit(False))
        found.append(_sized(rare, sizes.join(again.select("leaf"), "leaf", "left_anti")))
        if again.isEmpty():
            break
        crowd = materialise(rare.join(again.select("leaf", F.col("all").alias("count")), "leaf").select(F.col("leaf").alias("node"), "fp", "count"), "crowd")
    return reduce(DataFrame.unionByName, found)


def _merged(leaves: DataFrame) -> DataFrame:
    """Leaves of the same sets as one: the tokens of a passage are named by the same texts, and bring nobody together twice.

    Leaves are told to be the same by the number of their sets and two sums of hashes. A set is near if it is in one of them.
    """
    own = [F.sum(F.xxhash64("fp", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    told = leaves.groupBy("leaf").agg(F.count("*").alias("n"), *own).where("n > 1")
    names = told.groupBy("n", "s1", "s2").agg(F.min("leaf").alias("one"), F.collect_set("leaf").alias("leaves"))
    renamed = names.select("one", F.explode("leaves").alias("leaf"))
    return leaves.join(renamed, "leaf").groupBy(F.col("one").alias("leaf"), "fp").agg(F.min("far").alias("far"), F.min("core").alias("core"))


def _sized(leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """``leaves`` with the number of ``blocks`` of near sets that a leaf is cut into, and of ``farther`` ones; without those that hold no pair."""
    cut = lambda n: F.ceil(n / BLOCK).cast("int")
    told = sizes.select("leaf", cut(F.col("all") - F.col("away")).alias("blocks"), cut(F.col("away")).alias("farther"))
    return leaves.join(told, "leaf").select("leaf", "fp", "far", "blocks", "farther")


def _placed(leaves: DataFrame) -> DataFrame:
    """A row for each place where a set is compared: ``leaf`` and blocks ``a`` <= ``b``, ``side`` 1 for ``a``, 2 for ``b``, 3 for both.

    Blocks of far sets come after those of near ones and meet these only.
    """
    near, away = F.col("blocks").cast("long"), F.col("farther").cast("long")
    own = F.when(F.col("far"), near + F.pmod(F.xxhash64("fp"), F.greatest(away, F.lit(1)))).otherwise(F.pmod(F.xxhash64("fp"), near))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("far"), near).otherwise(near + away) - 1))
    rows = leaves.select("*", own.alias("own"), other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    return rows.select("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), "fp")


_PLACE = ("leaf", "a", "b")


def _groups(rows: DataFrame) -> DataFrame:
    """Rows of a place next to one another. A place holds at most LIMIT or 2 * BLOCK rows."""
    return rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE)


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole places."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None and rest.num_rows:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        keys = [np.array(batch.column(k)) for k in range(3)]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(batch: pa.RecordBatch) -> np.ndarray:
    keys = [np.array(batch.column(k)) for k in range(3)]
    new = np.logical_or.reduce([np.diff(k, prepend=k[0] + 1) != 0 for k in keys])
    return np.append(np.flatnonzero(new), batch.num_rows)


def _pairs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs to compare in a place: all within one block, else those across the two."""
    i, j = np.triu_indices(len(side), 1)
    across = (side[i] == 3) | (side[i] != side[j])
    return i[across], j[across]


def _least_common(paths: list[np.ndarray], fars: list[np.ndarray], i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Which of the pairs have ``leaf`` as the least of the leaves where they are compared: both are in, and not both far."""
    m = len(paths)
    before = [*(p[p < leaf] for p in paths), *(p[p < leaf] for p in fars)]
    row, name = np.repeat(np.arange(2 * m), [len(b) for b in before]), np.concatenate(before)
    names, code, times = np.unique(name, return_inverse=True, return_counts=True)
    shared = times > 1  # a name that one set alone has brings nothing together
    row, code, n = row[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]], int(shared.sum())
    both = np.zeros((m, m), np.float32)
    step = max(1, 2_000_000 // m)
    for at in range(0, n, step):
        some = (code >= at) & (code < at + step)
        own = np.zeros((2 * m, min(step, n - at)), np.float32)
        own[row[some], code[some] - at] = 1
        near, far = own[:m], own[m:]
        both += near @ near.T
        if far.any():
            cross = near @ far.T
            both += cross + cross.T
    return both[i, j] == 0


def _lists(column: pa.Array) -> list[np.ndarray]:
    at, values = np.array(column.offsets), np.array(column.values)
    return [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _alike(sigs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs have enough equal values in their signatures."""
    step = 65_536
    return np.concatenate([(sigs[i[k : k + step]] == sigs[j[k : k + step]]).mean(1) >= SCREEN for k in range(0, len(i), step)] or [np.zeros(0, bool)])


def _screened(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows, without ``n`` and ``sig``, that have a partner left: one of fitting size and signature that they are compared with in no lesser leaf."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_place(batches):
            bounds = _bounds(batch)
            leaf, side, size = np.array(batch.column(0)), np.array(batch.column(3)), np.array(batch.column(7))
            sigs = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint32).reshape(-1, WIDTH)
            paths, fars = _lists(batch.column(5)), _lists(batch.column(6))
            keep = np.zeros(batch.num_rows, bool)
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if y - x < 2:
                    continue
                i, j = _pairs(side[x:y])
                n = size[x:y]
                tests = [
                    lambda i, j, n=n: np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]),
                    lambda i, j, x=x, y=y: _least_common(paths[x:y], fars[x:y], i, j, int(leaf[x])),
                    lambda i, j, x=x, y=y: _alike(sigs[x:y], i, j),
                ]
                if len(i) < 2000:  # the cheaper of the two comes first
                    tests[1:] = tests[:0:-1]
                for test in tests:
                    if len(i):
                        passed = test(i, j)
                        i, j = i[passed], j[passed]
                keep[x + i] = True
                keep[x + j] = True
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(7)], [*_PLACE, "side", "fp", "paths", "fars"])

    return _groups(rows).mapInArrow(screen, "leaf long, a long, b long, side int, fp binary, paths array<long>, fars array<long>")


def _links(rows: DataFrame, similarity: float) -> DataFrame:
    """``fp``, ``root``, ``n_links`` (documents of linked sets) from rows with ``paths``, ``fars``, ``copies`` and ``tokens``.

    A row for each set of a place that has links there.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_place(batches):
            bounds = _bounds(batch)
            leaf, side = np.array(batch.column(0)), np.array(batch.column(3))
            fps, copies = batch.column(4).to_pylist(), np.array(batch.column(7))
            paths, fars = _lists(batch.column(5)), _lists(batch.column(6))
            out: tuple[list, list, list] = ([], [], [])
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if y - x < 2:
                    continue
                i, j = _pairs(side[x:y])
                new = _least_common(paths[x:y], fars[x:y], i, j, int(leaf[x]))
                i, j = i[new], j[new]
                if not len(i):
                    continue
                sets = [np.frombuffer(t.as_py(), np.uint64) for t in batch.column(8).slice(x, y - x)]
                linked = _similar(sets, i, j, similarity)
                i, j = i[linked], j[linked]
                n = y - x
                count = np.bincount(i, copies[x + j], n) + np.bincount(j, copies[x + i], n)
                root = np.arange(n)
                while len(i):  # labels go down along links until they rest
                    low = np.minimum(root[i], root[j])
                    before = root.copy()
                    np.minimum.at(root, i, low)
                    np.minimum.at(root, j, low)
                    root = root[root]
                    if (root == before).all():
                        break
                for k in np.flatnonzero(count):
                    out[0].append(fps[x + k])
                    out[1].append(fps[x + root[k]])
                    out[2].append(int(count[k]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["fp", "root", "n_links"])

    return _groups(rows).mapInArrow(compare, "fp binary, root binary, n_links long")


def _similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs of token sets reach the Jaccard similarity, exactly."""
    size = np.array([len(s) for s in sets])
    fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
    out = np.zeros(len(i), bool)
    some = np.flatnonzero(fits)
    if len(some) <= 3 * len(sets):
        for k in some:
            both = len(np.intersect1d(sets[i[k]], sets[j[k]], assume_unique=True))
            out[k] = both >= similarity * (size[i[k]] + size[j[k]] - both)
        return out
    # Many pairs of few sets: their common tokens as a product of membership rows, in slices of the tokens.
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, 4_000_000 // len(sets))
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for at in range(0, len(names), step):
        x, y = np.searchsorted(code, (at, at + step))
        part = np.zeros((len(sets), min(step, len(names) - at)), np.float32)
        part[row[x:y], code[x:y] - at] = 1
        both += part @ part.T
    common = both[i[some], j[some]].astype(np.int64)
    out[some] = common >= similarity * (size[i[some]] + size[j[some]] - common)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, from edges ``x``, ``y``. Nodes without edges aren't in it.

    Each round a node takes the least label among its neighbours' and then the label of its label, so paths halve;
    rounds end when no label moves.
    """
    both = materialise(edges.where("x != y").select("x", "y").unionByName(edges.where("x != y").select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialise(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        lower = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        lower = materialise(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(lower.join(jump, "label", "left").select("node", F.least(F.col("label"), F.coalesce("next", "label")).alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if new.where("label != was").isEmpty():
            return labels


def _tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp`` and ``tokens`` of the sets in ``wanted`` (``fp``, ``th``: the text that stands for it, written before).

    A filter of the wanted texts goes to where the texts are; only the shingles of those that pass are moved.
    """
    text = F.col("text").cast("string")
    hit = Bloom(wanted.select("th")).among(docs.select(F.xxhash64(text).alias("th"), text.alias("text")), "th")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in a task give their set once
        for batch in batches:
            fps, sets = [], []
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if th not in seen:
                    seen.add(th)
                    tokens = shingles(text.as_py())
                    if len(tokens):
                        fps.append(fingerprint(tokens))
                        sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], ["fp", "tokens"])

    found = hit.mapInArrow(cut, "fp binary, tokens binary").groupBy("fp").agg(F.first("tokens").alias("tokens"))
    return found.join(wanted.select("fp"), "fp", "left_semi")


def _joined(docs: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """All rows (``doc_id``, ``th``, ``fp``), and for each set its ``label``, ``n_links``, ``copies`` and least ``doc_id``."""
    with passing_tables(docs.sparkSession) as lasting:
        return _join(docs, similarity, recall, lasting)


def _join(docs: DataFrame, similarity: float, recall: float, lasting: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    rows = lasting(_described(docs), "sets-rows")
    sets = rows.where("fp is not null").groupBy("fp").agg(F.min("th").alias("th"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = materialise(sets, "sets")
    leaves, crowd = _leaves(sets, runs(similarity, recall))
    leaves = leaves.select("leaf", "fp", F.lit(False).alias("far"), F.lit(1).alias("blocks"), F.lit(0).alias("farther"))
    tokens = None
    if crowd is not None:
        close = materialise(crowd.select("fp").distinct().join(sets.select("fp", "th"), "fp"), "crowd-sets")
        tokens = materialise(_tokens(docs, close), "tokens")
        leaves = leaves.unionByName(_dense_leaves(crowd, tokens, similarity).select(*leaves.columns))
        leaves = materialise(leaves, "leaves")
    # A set is in a bounded number of leaves, whatever the number of sets.
    where = lambda far: F.array_sort(F.collect_set(F.when(F.col("far") == far, F.col("leaf"))))
    paths = leaves.groupBy("fp").agg(where(False).alias("paths"), where(True).alias("fars"))
    marked = materialise(paths.join(sets.select("fp", "n", "sig"), "fp"), "set-paths")
    placed = _placed(leaves).join(marked, "fp").select(*_PLACE, "side", "fp", "paths", "fars", "n", "sig")
    kept = materialise(_screened(placed, similarity), "screened")
    wanted = kept.select("fp").distinct()
    if tokens is not None:
        wanted = wanted.join(close.select("fp"), "fp", "left_anti")
    wanted = materialise(wanted.join(sets.select("fp", "th"), "fp"), "wanted")
    more = materialise(_tokens(docs, wanted), "tokens")
    tokens = more if tokens is None else tokens.unionByName(more)
    packed = kept.join(sets.select("fp", "copies").join(tokens, "fp"), "fp").select(*_PLACE, "side", "fp", "paths", "fars", "copies", "tokens")
    links = materialise(_links(packed, similarity), "links")
    labels = components(links.select(F.col("fp").alias("x"), F.col("root").alias("y")))
    counts = links.groupBy("fp").agg(F.sum("n_links").alias("n_links"))
    known = sets.select("fp", "doc_id", "copies", "th").join(counts, "fp", "left").join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.select("fp", "doc_id", "copies", "th", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "fp").alias("label"))
    return rows, lasting(known, "sets-linked")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` and ``class_size`` of each document.

    ``class_id`` is the least id in the class; texts without words, and classes of rows without ids, have their own
    id. ``n_links`` counts the other documents of similarity at or above the threshold, copies included.
    """
    rows, sets = _joined(docs, similarity, recall)
    classes = materialise(sets.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size")), "classes")
    known = sets.join(classes, "label").select("fp", "class_id", "class_size", (F.col("n_links") + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "fp").join(known, "fp", "left")
    alone = F.col("fp").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents, with their columns, that are the only one or the first (least id, then text) of their class.

    Texts without words all stay.
    """
    rows, sets = _joined(docs, similarity, recall)
    # The first row of a set, then the first of a class: by id (null last), hash of the text.
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = rows.where("fp is not null").groupBy("fp").agg(F.min(key).alias("k"))
    winner = materialise(best.join(sets.select("fp", "label"), "fp").groupBy("label").agg(F.min("k").alias("k")), "winners")
    winners = materialise(sets.select("fp", "label").join(winner, "label").select("fp", F.col("k.doc_id").alias("w_id"), F.col("k.th").alias("w_th")), "winners")
    judged = rows.where("fp is not null").join(winners, "fp").withColumn("first", F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
    # Rows of equal id and text can't be told apart: of those that come first, one stays, whichever.
    judged = judged.groupBy("doc_id", "th").agg(F.max("first").alias("first"), F.count("*").alias("rows"))
    keyed = lambda df: df.withColumn("key", _row_key(F.col("doc_id"), F.col("th")))
    other = materialise(keyed(judged.where(~F.col("first") | (F.col("rows") > 1)).select("doc_id", "th", "first")), "losers")
    own = fresh(docs, "_row_id", "_row_text", "_row_key")
    named = docs.withColumns({own[0]: F.col("doc_id").cast("long"), own[1]: F.xxhash64(F.col("text").cast("string"))})
    named = named.withColumn(own[2], _row_key(F.col(own[0]), F.col(own[1])))
    stay = _without(named, own, other.drop("first"), keyed(rows.select("doc_id", "th")))
    tied = materialise(other.where("first").drop("first"), "tied")
    one = Bloom(tied.select("key")).among(named, own[2]).dropDuplicates(own[:2])
    return stay.unionByName(_matched(one, own, tied, "left_semi")).drop(*own)


def _row_key(doc_id: Column, text_hash: Column) -> Column:
    """64 bits for an id, which may be null, and the hash of a text."""
    return F.xxhash64(doc_id.isNull(), doc_id, text_hash)


def _matched(rows: DataFrame, own: list[str], keys: DataFrame, how: str) -> DataFrame:
    """Rows joined with ``keys`` by id and hash of the text, for which ``own`` names their columns."""
    their = fresh(rows, "_key_id", "_key_text", "_key")
    keys = keys.select("doc_id", "th", "key").toDF(*their)
    return rows.join(keys, F.col(own[0]).eqNullSafe(F.col(their[0])) & (F.col(own[1]) == F.col(their[1])), how)


def _without(rows: DataFrame, own: list[str], dropped: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that aren't among those ``dropped``; ``known`` has the keys of all rows.

    Rows that the filter of dropped keys doesn't pass stay where they are. Those that it passes wrongly are found among
    the known keys, without the rows themselves, and make a second filter: only rows that both pass are moved, to be
    joined exactly.
    """
    first = Bloom(dropped.select("key"))
    wrong = _matched(first.among(known, "key"), ["doc_id", "th"], dropped, "left_anti")
    second = Bloom(materialise(wrong.select("key"), "kept-keys"))
    unsure = second.among(first.among(rows, own[2]), own[2])
    return first.apart(rows, own[2]).unionByName(_matched(unsure, own, dropped, "left_anti"))


#: The same as DuckDB SQL, over all pairs that share a shingle (for small tables).
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN links ON b = x
), classes AS (
  SELECT a, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY a
), counts AS (
  SELECT x, count(*) AS n_links FROM links GROUP BY x
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, class_size FROM documents JOIN classes ON a = doc_id LEFT JOIN counts ON x = doc_id"""
