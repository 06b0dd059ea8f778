"""Toxicity by a character n-gram linear classifier with naive Bayes scaling (operator 8).

Features are the presence of hashed byte n-grams of the lower-case text. Their log-count ratios between toxic and
other texts scale them, and a logistic regression is fitted to the scaled features. It learns from at most
``TRAIN`` labelled ids of each class, chosen by a hash, and never from held-out ones. The n-grams are counted, ranked
and cut to the ``FEATURES`` most telling ones in the executors; the driver fits the regression to these alone. One of
``FOLDS`` parts of the sample is set aside from all that: on it the score at which the verdicts are best is found, which
then becomes 0.5.

Cases: a null text counts as empty, and an empty one gets the score of a text without any of the n-grams; a null id
isn't held out; repeated rows get equal scores; of several texts with a labelled id that of the least hash is learnt
from, and an id with both labels counts as toxic; without any toxic (or any other) labelled row every score is the
prior 0; scores that tie get one verdict; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import held_out, materialise

#: Labelled ids that are learnt from, of each class, and the parts of which one finds the threshold.
TRAIN = 6000
FOLDS = 5
ORDERS = (6, 7, 8)
BITS = 18
FEATURES = 4000
#: Rows that must hold an n-gram.
SEEN = 3
#: Tasks that share the sample, whatever the cluster.
SPREAD = 32
#: Pseudo-count of the ratios; weight of the penalty on the squared weights.
ALPHA, PENALTY = 1.0, 1e-4
THRESHOLD = 0.5
_SEED = 20_011


def hashed(text: str | None) -> np.ndarray:
    """The numbers of a text's n-grams, below ``len(ORDERS) << BITS``, repeats included. White space is one blank."""
    raw = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode(), np.uint8).astype(np.uint64)
    p = np.uint64(0x9E3779B97F4A7C15)
    pp = np.uint64(0x9E3779B97F4A7C15**2 % 2**64)
    two = raw[:-1] * p + raw[1:]
    found = []
    grams = {2: two}
    for n in range(3, max(ORDERS) + 1):
        if len(raw) < n:
            break
        grams[n] = grams[n - 2][: len(raw) - n + 1] * pp + two[n - 2 :] if n % 2 == 0 else grams[n - 1][: len(raw) - n + 1] * p + raw[n - 1 :]
    for k, n in enumerate(ORDERS):
        if n in grams:
            h = grams[n]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """``label``, ``fold`` (0 to FOLDS - 1) and ``text`` of the bounded sample, written once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col(target) == 1).cast("int")).alias("label"))
    order = F.xxhash64(F.lit(_SEED), F.col("_id"))
    chosen = [known.where(F.col("label") == y).orderBy(order, "_id").limit(TRAIN) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * TRAIN rows
    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("_doc"), text.alias("text")).join(ids, F.col("_doc") == F.col("_id"))
    one = found.groupBy("_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("label", F.pmod(F.xxhash64(F.lit(_SEED + 1), F.col("_id")), F.lit(FOLDS)).cast("int").alias("fold"), "text", "_id")
    return materialise(rows.repartition(SPREAD, "_id").drop("_id"), "toxic-train")


def class_counts(sample: DataFrame) -> DataFrame:
    """``slot``, ``clean``, ``toxic``: rows of each class with an n-gram, and under slot -1 all rows of each class. Summed in the executors."""
    width = len(ORDERS) << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width + 1), np.int32)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[label, np.unique(hashed(text.as_py())) + 1] += 1
                total[label, 0] += 1
        at = np.flatnonzero(total.any(0))
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some - 1), pa.array(total[0, some].astype(np.int64)), pa.array(total[1, some].astype(np.int64))], ["slot", "clean", "toxic"])

    found = sample.select("label", "text").mapInArrow(count, "slot long, clean long, toxic long")
    return found.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def telling(counts: DataFrame) -> list:
    """The most telling n-grams with their ``ratio``, at most FEATURES rows by ``slot``; none without rows of both classes. ``counts`` are written ones.

    The ratio is that of their smoothed shares among all n-grams, as logarithm; they are ranked by how many standard
    errors the shares of rows that hold them lie apart, ties by number.
    """
    rows = counts.where("slot = -1").first()
    if rows is None or not rows["clean"] or not rows["toxic"]:
        return []
    clean, toxic = float(rows["clean"]), float(rows["toxic"])
    grams = counts.where("slot >= 0")
    sums = grams.agg(F.sum("clean"), F.sum("toxic")).first()
    width = ALPHA * (len(ORDERS) << BITS)
    ratio = F.log((F.col("toxic") + ALPHA) / ((sums[1] or 0) + width)) - F.log((F.col("clean") + ALPHA) / ((sums[0] or 0) + width))
    both = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    apart = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(both * (1 - both) * (1 / clean + 1 / toxic) + 1e-9)
    ranked = grams.where(F.col("clean") + F.col("toxic") >= SEEN).select("slot", ratio.alias("ratio"), apart.alias("apart"))
    return sorted(ranked.orderBy(F.desc("apart"), "slot").limit(FEATURES).collect())


def _matrix(sample: DataFrame, slot: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Label, fold and chosen features (as 16-bit numbers) of each row: at most 2 * TRAIN rows."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                at = slot[np.unique(hashed(text.as_py()))]
                rows.append(at[at >= 0].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["label", "fold", "at"])

    return sorted((r["label"], r["fold"], bytes(r["at"])) for r in sample.select("label", "fold", "text").mapInArrow(present, "label int, fold int, at binary").collect())


def _sparse(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and the features as row numbers and feature numbers."""
    at = [np.frombuffer(x, "<u2").astype(np.int64) for *_, x in rows]
    return np.array([r[0] for r in rows], float), np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate([*at, np.zeros(0, np.int64)])


def best_threshold(labels: np.ndarray, z: np.ndarray) -> float:
    """The score from which on verdicts are best by F1: half-way between neighbours, the one nearest to 0 of equally good ones."""
    cuts = np.unique(z)
    cuts = np.append((cuts[:-1] + cuts[1:]) / 2, 0.0)
    right = np.array([((z >= c) & (labels == 1)).sum() for c in cuts])
    f1 = 2 * right / np.maximum(1, [(z >= c).sum() + labels.sum() for c in cuts])
    best = cuts[f1 >= f1.max() - 1e-12]
    return float(best[np.argmin(np.abs(best))])


def _fit(labels: np.ndarray, row: np.ndarray, col: np.ndarray, scale: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept: penalised logistic regression by Adam, over all rows each round."""
    n, k = len(labels), len(scale)
    value = scale[col]
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log((labels.mean() + 1e-9) / (1 - labels.mean() + 1e-9))
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[col], n) + w[k]
        err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) / n
        grad = np.append(np.bincount(col, value * err[row], k) + PENALTY * w[:k], err.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:k], float(w[k])


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> tuple[np.ndarray, float]:
    """A weight for each n-gram (most are 0) and the intercept."""
    sample = training_rows(docs, labels, target)
    width = len(ORDERS) << BITS
    weights = np.zeros(width, np.float32)
    chosen = telling(materialise(class_counts(sample.where("fold > 0")), "toxic-counts"))
    if not chosen:
        return weights, -30.0
    slots, ratio = np.array([r["slot"] for r in chosen]), np.array([r["ratio"] for r in chosen])
    slot = np.full(width, -1, np.int32)
    slot[slots] = np.arange(len(slots))
    rows = _matrix(sample, slot)
    fitted, base = _fit(*_sparse([r for r in rows if r[1]]), ratio)
    # The part set aside says where toxic begins.
    aside, row, col = _sparse([r for r in rows if not r[1]])
    if len(aside):
        base -= best_threshold(aside, np.bincount(row, (fitted * ratio)[col], len(aside)) + base)
    weights[slots] = fitted * ratio
    return weights, base


def score_documents(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (higher: toxic is likelier) and ``predicted`` for every document."""
    weights, base = train(docs, labels, target)
    used = np.flatnonzero(weights)
    shipped = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used], base))  # at most FEATURES entries

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        used, values, base = shipped.value
        dense = np.zeros(len(ORDERS) << BITS, np.float32)
        dense[used] = values

        def one(text: str | None) -> float:
            at = hashed(text)
            at = np.unique(at[dense[at] != 0])
            return 1 / (1 + np.exp(-np.clip(float(dense[at].sum()) + base, -30, 30)))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=float)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
