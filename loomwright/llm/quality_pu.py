"""Quality classifier by positive-unlabelled learning (operator 1).

Trusted positives are labelled rows of quality 1 outside the held-out fold; the unlabelled set is a hash sample of
all documents, whose labels are never looked at. The class prior is estimated from how a positive-against-unlabelled
classifier ranks the two samples (the best-bin bound), and a linear scorer then minimises the non-negative unbiased
risk: where the estimated risk of the negatives falls below zero, the step goes against its gradient.

A text is described by the make-up of its characters (shares of triples of character classes) and by how much it
repeats itself; language, source and ids aren't inputs.

Cases: a null text counts as empty; an empty text has all features 0 and gets the score that follows; null ids are
scored and never learnt from as positives; repeated rows get equal scores and are drawn once; of several texts with a
trusted id that of the least hash is learnt from, and an id with both labels isn't trusted less; scores that tie get one
verdict; without positives or documents to learn from every score is the prior 0.5; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import held_out

#: Trusted positives and unlabelled rows that are learnt from.
POSITIVES, UNLABELLED = 5000, 10_000
THRESHOLD = 0.3
_SEED = 40_487

# Classes of bytes: other, blank, line end, lower case, upper case, digit, sentence mark, other ASCII sign, within a longer character.
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((" \t\r\x0b\x0c", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"-()", "!?#*$%&|<>@^_`~=+/\\{}[]"), 1):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = 8
_N = 9
N_FEATURES = _N + _N**2 + _N**3 + 12


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, of their pairs and triples, and twelve figures of length and repetition."""
    out = np.zeros(N_FEATURES, np.float32)
    text = text or ""
    words = text.split()
    if not words:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    at = 0
    for k, code in enumerate((c, c[:-1] * _N + c[1:], (c[:-2] * _N + c[1:-1]) * _N + c[2:])):
        width = _N ** (k + 1)
        if len(code):
            out[at : at + width] = np.sqrt(np.bincount(code, minlength=width) / len(code))
        at += width
    n = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words[:-1], words[1:]))
    pairs = len(set(zip(words[:-1], words[1:], strict=True)))
    rare = np.log1p(n)
    out[at:] = (
        np.log1p(n) / 10,
        len(counts) / n,
        # Distinct words fall behind in long texts too: against what prose of this length has.
        min(len(counts) / n**0.85, 2.0),
        max(counts.values()) / n,
        same / n,
        pairs / max(1, n - 1),
        1 - len(set(lines)) / len(lines),
        min(len(lines) / n, 1.0),
        min(sum(map(len, words)) / n / 20, 2.0),
        min(max(map(len, words)) / 100, 2.0),
        min(len(zlib.compress(raw, 1)) / (len(raw) + 20), 1.2),
        float(n < 20) * rare / 3,
    )
    return out


def _samples(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the trusted positives and of the unlabelled rows, from one pass over the texts.

    A text for each of at most POSITIVES ids, and the UNLABELLED least of the different rows that a hash draws: copies
    are one before anything is collected, so none can push out others.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    trusted = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    trusted = F.broadcast(trusted.orderBy(F.xxhash64(F.lit(_SEED), F.col("_id")), "_id").limit(POSITIVES))  # at most POSITIVES rows
    own = F.xxhash64(F.lit(_SEED + 1), doc_id, text)
    share = min(1.0, 1.2 * UNLABELLED / max(1, docs.count()))
    drawn = F.pmod(own, F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.select(doc_id.alias("_doc"), text.alias("_text"), own.alias("_own"), drawn.alias("_drawn")).join(trusted, F.col("_doc") == F.col("_id"), "left")
    rows = rows.where(F.col("_drawn") | F.col("_id").isNotNull()).select("_text", "_id", "_own", "_drawn")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, trusted_id, own, drawn in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                x = features(text.as_py()).astype(np.float16).tobytes()  # half the driver's memory
                if trusted_id is not None:
                    out.append((True, trusted_id, own, x))
                if drawn:
                    out.append((False, own, own, x))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["p", "key", "own", "x"])

    found = rows.mapInArrow(describe, "p boolean, key long, own long, x binary").groupBy("p", "key").agg(F.min_by("x", "own").alias("x")).collect()
    found.sort(key=lambda r: r["key"])

    def stack(positive: bool, most: int) -> np.ndarray:
        chosen = [r["x"] for r in found if r["p"] == positive][:most]
        return np.frombuffer(b"".join(chosen), np.float16).reshape(len(chosen), N_FEATURES).astype(np.float32)

    return stack(True, POSITIVES), stack(False, UNLABELLED)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """A linear scorer over standardised features, fitted by Adam."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        self.mean, self.spread = mean.astype(np.float32), spread.astype(np.float32)
        self.w = np.zeros(len(mean) + 1, np.float32)
        self.m, self.v, self.t = np.zeros_like(self.w), np.zeros_like(self.w), 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = np.ones((len(x), len(self.w)), np.float32)
        np.subtract(x, self.mean, out=z[:, :-1])
        np.divide(z[:, :-1], self.spread, out=z[:, :-1])
        np.clip(z, -6, 6, out=z)
        return z

    def step(self, grad: np.ndarray, rate: float, penalty: float) -> None:
        grad = grad + penalty * np.append(self.w[:-1], 0)
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        self.w -= (rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The largest share of positives that the unlabelled scores allow: the least ratio of the two upper tails, with its slack.

    Every threshold bounds the share by P(unlabelled above) / P(positive above); the slack keeps thin tails from
    deciding.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, 401)))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    qp, qu = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    ok = qp > 0.05
    best = np.argmin(np.where(ok, (qu + slack) / np.maximum(qp, 1e-9), np.inf))
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def risk_gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk of a batch, with logistic losses, and the direction of the step.

    Positives weigh ``prior``; the negatives' risk is that of the unlabelled as negatives less that of the positives as
    negatives. Where this falls below zero it counts as zero, and the step goes against its gradient alone.
    """
    zp, zu = p @ w, u @ w
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    of_negative = (_sigmoid(zu) @ u) / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
    if negative < 0:
        return float(positive), -of_negative
    return float(positive + negative), of_negative - prior * ((1 - _sigmoid(zp)) @ p) / len(p)


def fit(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 60, batch: int = 1024, penalty: float = 2e-4) -> tuple[Linear, float]:
    """The scorer of least non-negative risk, and the estimated prior."""
    rows = len(positive) + len(unlabelled)
    mean = (positive.sum(0, dtype=float) + unlabelled.sum(0, dtype=float)) / rows
    square = sum(np.einsum("ij,ij->j", x, x, dtype=float) for x in (positive, unlabelled)) / rows
    model = Linear(mean, np.sqrt(np.maximum(square - mean**2, 0)) + 0.02)
    rng = np.random.default_rng(7)
    p, u = model.standard(positive), model.standard(unlabelled)
    # Half of each sample ranks and the other half is ranked; then the other way round.
    found = []
    for k in (0, 1):
        ranker = Linear(model.mean, model.spread)
        for _ in range(250):
            grad = (_sigmoid(u[k::2] @ ranker.w) @ u[k::2]) / max(1, len(u[k::2])) - ((1 - _sigmoid(p[k::2] @ ranker.w)) @ p[k::2]) / max(1, len(p[k::2]))
            ranker.step(grad, 0.05, 1e-3)
        found.append(estimate_prior(p[1 - k :: 2] @ ranker.w, u[1 - k :: 2] @ ranker.w))
    prior = sum(found) / 2
    model.w[-1] = np.log(prior / (1 - prior))
    for epoch in range(epochs):
        rate = 0.03 * 0.5 ** (epoch / 15)
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        steps = max(1, len(u) // batch)
        for a, b in zip(np.array_split(order_p, steps), np.array_split(order_u, steps), strict=True):
            if not len(a) or not len(b):
                continue
            grad = risk_gradient(p[a], u[b], model.w, prior)[1]
            model.step(grad, rate, penalty)
    return model, prior


def train(docs: DataFrame, labels: DataFrame) -> tuple[Linear | None, float]:
    positive, unlabelled = _samples(docs, labels)
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else (None, 0.5)


def scorer(model: Linear | None):  # noqa: ANN201
    """The model as a column function of the text."""
    if model is None:
        return lambda text: F.lit(0.5)
    mean, scale, weights = model.mean, model.spread, model.w

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.empty(len(texts))
            for k, text in enumerate(texts):
                z = np.clip((features(text) - mean) / scale, -6, 6)
                found[k] = z @ weights[:-1] + weights[-1]
            yield pd.Series(_sigmoid(found))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (higher: quality is likelier) and ``predicted`` for every document."""
    model, _ = train(docs, labels)
    score = scorer(model)(F.col("text").cast("string"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    model, _ = train(docs, labels)
    return docs.where(scorer(model)(F.col("text").cast("string")) >= threshold)
