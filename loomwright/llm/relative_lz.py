"""Passages that occurred before, found by relative Lempel-Ziv parsing, and texts without them (operator 12).

A window is ``WINDOW`` consecutive words. Every word goes that is in a window which also starts earlier: in a document of
lesser id, or earlier in the same one.

1. Reference blocks. Each window has an anchor, the stretch of ``GRAM`` words in it that hashes least; equal windows have equal
   anchors at equal places. So a text's anchors, about one in seven words, tell where it may repeat another, and the first
   place of each anchor in the corpus tells which block of ``BLOCK`` words it may repeat. Only pairs of a document's block and
   such a reference block are formed: as many as there are anchors at most, however often a passage occurs.
2. Parsing. A block's text is factored greedily against its reference block, which is indexed by its stretches of ``GRAM``
   words: at each place the longest match there, then on from its end. A factor of ``WINDOW`` words or more is a repeated
   span. A repeated window that no factor holds reaches over the end of one; windows around these ends are looked up.
   Within one document only what begins earlier is a match, which may overlap with what it matches.
3. The rest. A window whose anchor occurred before, but which the anchor's first block doesn't have, may have begun with
   another document. Such windows, which are few (around the ends of passages and changed words), are grouped by 128-bit
   hashes, and all but the first of a group are repeated spans.

Rows of a frequent anchor, window or block meet their one first place by a broadcast of the frequent ones, which are at most
``HOT`` for each shuffle partition; the others by a shuffle, where none of them can fill a task.

Cases: a null text has no words; texts of fewer than ``WINDOW`` words stay whole; null ids come after all others; of rows with
equal ids the one whose text hashes less is earlier, and rows of equal id and text are one document, which has one result on
each of them; an empty table gives no rows; further columns go through unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Bloom, fresh, materialise, passing_tables
from loomwright.llm.words import stretches, word_hashes

WINDOW, GRAM, BLOCK = 20, 8, 512
#: Frequent keys that are broadcast, for each shuffle partition.
HOT = 4
#: Bytes of text that are hashed together, and of blocks that are passed on together.
_TOGETHER, _PASSED = 1 << 18, 4 << 20

Span = tuple[int, int]


def least_places(grams: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values the place of the least, the first of equal ones."""
    at, reach = np.arange(len(grams)), 1
    better = lambda x, y: np.where(grams[x] <= grams[y], x, y)
    while 2 * reach <= width:
        at = better(at[:-reach], at[reach:])
        reach *= 2
    return better(at[: len(at) - (width - reach)], at[width - reach :]) if width > reach else at


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return ((x.as_py() or "").encode("utf-8", "surrogatepass") for x in column)


def _hashed(texts: Iterable[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Each text with the hashes, first bytes and ends of its words. Some are hashed at a time, as one with line feeds between them."""

    def cut(some: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        words, first, stop = word_hashes(b"\n".join(some))
        at = 0
        for text in some:
            lo, hi = np.searchsorted(first, (at, at + len(text)))
            yield text, words[lo:hi], first[lo:hi] - at, stop[lo:hi] - at
            at += len(text) + 1

    some: list[bytes] = []
    held = 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= _TOGETHER:
            yield from cut(some)
            some, held = [], 0
    yield from cut(some)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of a text's anchors, and for each window the place of its anchor."""
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    grams = stretches(words, GRAM)
    own = least_places(grams, WINDOW - GRAM + 1)
    places = own[np.diff(own, prepend=-1) != 0]
    return grams[places], places, own


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with their order, (d, th): id, and hash of the text."""
    names = fresh(docs, "_d", "_th")
    text = F.col("text").cast("string")
    return docs.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), names[1]: F.xxhash64(text)}), names


def _anchored(keyed: DataFrame) -> DataFrame:
    """``d``, ``th`` and the arrays ``h``, ``pos`` of the documents' anchors."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(w)[:2] for _, w, _, _ in _hashed(_bytes(batch.column(2)))]
            at = np.append(0, np.cumsum([len(h) for h, _ in found])).astype(np.int32)
            h = np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            pos = np.concatenate([p for _, p in found] or [np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, h), pa.ListArray.from_arrays(at, pos)], ["d", "th", "h", "pos"])

    return keyed.mapInArrow(find, "d long, th long, h array<long>, pos array<int>")


def _after_first(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """The rows that aren't the first (by ``place``) of those with equal ``keys``, with ``first``, the place of that one."""
    place_of = F.struct(*place)
    firsts = materialise(rows.groupBy(*keys).agg(F.count("*").alias("times"), F.min(place_of).alias("first")).where("times > 1"), "firsts")
    met = _met(rows, firsts, keys)
    return met.where(place_of != F.col("first")).select(*rows.columns, "first")


def _met(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined with ``others``, which has each of its ``keys`` once and how many ``times`` rows have it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = others.agg(F.sum("times")).first()[0] or 0
    limit = max(1, total // (HOT * parts))  # no more than HOT * parts keys are above it
    hot = F.broadcast(others.where(F.col("times") > limit).drop("times").withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    cold = others.where(F.col("times") <= limit).drop("times")
    return marked.where("_hot").drop("_hot").unionByName(marked.where("_hot IS NULL").select(*rows.columns).join(cold, keys))


def _blocks(keyed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``d``, ``th``, ``block`` and ``words`` (the text from some words before the block to some after it) of wanted blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, block, out, held = [], [], [], 0

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(block, pa.int32()), pa.array(out, pa.string())], ["d", "th", "block", "words"])

            for k, (text, _, first, stop) in enumerate(_hashed(_bytes(batch.column(2)))):
                for b in range(-(-len(first) // size)):
                    x, y = _around(b, size, len(first))
                    rows.append(k)
                    block.append(b)
                    out.append(text[first[x] : stop[y - 1]].decode("utf-8", "surrogatepass"))
                    held += len(out[-1])
                    if held >= _PASSED:
                        yield made()
                        rows, block, out, held = [], [], [], 0
            yield made()

    key = F.xxhash64("d", "th", "block")
    docs = Bloom(materialise(wanted.select(F.xxhash64("d", "th").alias("key")).distinct(), "repeating-texts")).among(keyed.withColumn("key", F.xxhash64("d", "th")), "key").select("d", "th", "text")
    cuts = docs.mapInArrow(cut, "d long, th long, block int, words string").withColumn("key", key)
    some = Bloom(wanted.select(key.alias("key"))).among(cuts, "key").drop("key")
    return some.groupBy("d", "th", "block").agg(F.first("words").alias("words")).join(wanted, ["d", "th", "block"], "left_semi")


def _around(block: int, size: int, n: int) -> Span:
    """The words of a block: those of all windows whose anchor begins in it."""
    return max(0, block * size - (WINDOW - GRAM)), min(n, (block + 1) * size + WINDOW)


class Reference:
    """A reference block, indexed by its stretches of ``GRAM`` words and by its windows."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.grams, self.windows = stretches(words, GRAM), stretches(words, WINDOW)
        self.by_gram, self.by_window = np.argsort(self.grams, kind="stable"), np.argsort(self.windows, kind="stable")
        self.grams, self.windows = self.grams[self.by_gram], self.windows[self.by_window]

    def candidates(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")

    def first_window(self, windows: np.ndarray) -> np.ndarray:
        """The least place of each window, or a very large number."""
        at = np.minimum(np.searchsorted(self.windows, windows), len(self.windows) - 1)
        return np.where(self.windows[at] == windows, self.by_window[at], 1 << 40)


def parse(words: np.ndarray, ref: Reference, ahead: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy factors (place, place in the reference, length) of ``GRAM`` words or more; words between them are literals.

    If both are of one document, ``ahead`` tells how far before the text's beginning the reference begins, and only what
    starts earlier in the document is matched.
    """
    low, high = ref.candidates(stretches(words, GRAM))
    seeds = np.flatnonzero(high > low)
    factors: list[tuple[int, int, int]] = []
    p = k = 0
    while (k := int(np.searchsorted(seeds, p))) < len(seeds):
        p = int(seeds[k])
        best, length = -1, 0
        for q in ref.by_gram[low[p] : high[p]].tolist():
            if ahead is not None and q - ahead >= p:
                break
            n = min(len(words) - p, len(ref.words) - q)
            other = words[p : p + n] != ref.words[q : q + n]
            first = int(other.argmax())
            own = first if other[first] else n
            if own > length:
                best, length = q, own
        if length >= GRAM:
            factors.append((p, best, length))
        p += max(1, length)
    return factors


def repeated(words: np.ndarray, ref: Reference, ahead: int | None = None) -> np.ndarray:
    """For each window of a text whether the reference has it (earlier, if both are of one document)."""
    n = len(words) - WINDOW + 1
    found, ends = np.zeros(n, bool), []
    for p, _, length in parse(words, ref, ahead):
        found[p : max(p, p + length - WINDOW + 1)] = True
        ends.append(p + length)
    # A window in the reference that lies in no factor reaches over the end of one.
    near = np.unique(np.concatenate([np.arange(max(0, e - WINDOW + 1), min(n, e)) for e in ends] or [np.zeros(0, np.int64)]))
    near = near[~found[near]]
    if len(near) and len(ref.words) >= WINDOW:
        q = ref.first_window(stretches(words, WINDOW)[near])
        found[near] = q < (1 << 40) if ahead is None else q - ahead < near
    return found


_FOUND = "d long, th long, start int, stop int, w1 long, w2 long"


def _compared(pairs: DataFrame, size: int) -> DataFrame:
    """Repeated spans of the blocks (``start``, ``stop`` in words), and windows that are left to be grouped (``start``, ``w1``, ``w2``)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            both = zip(_hashed(_bytes(batch.column(5))), _hashed(_bytes(batch.column(6))), strict=True)
            last: tuple[str | None, Reference | None] = (None, None)
            for k, ((_, own, _, _), (_, other, _, _)) in enumerate(both):
                if len(own) < WINDOW:
                    continue
                block, their, same = batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
                began, theirs = _around(block, size, 1 << 40)[0], _around(their, size, 1 << 40)[0]
                name = batch.column(6)[k].as_py()
                if last[0] != name:
                    last = (name, Reference(other))
                hit = repeated(own, last[1], began - theirs if same else None)
                starts = np.flatnonzero(hit)
                cuts = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
                for x, y in zip(cuts, [*cuts[1:], len(starts)], strict=False):
                    for column, value in zip(out, (k, began + starts[x], began + starts[y - 1] + WINDOW, None, None), strict=True):
                        column.append(value)
                asked = batch.column(7)[k].values.to_numpy() if len(batch.column(7)[k]) else np.zeros(0, np.int64)
                rest = np.flatnonzero(~hit & np.isin(anchors(own)[2] + began, asked))
                if len(rest):
                    w1, w2 = (stretches(own, WINDOW, turn)[rest].view(np.int64).tolist() for turn in (0, 31))
                    for column, values in zip(out, ([k] * len(rest), (began + rest).tolist(), [None] * len(rest), w1, w2), strict=True):
                        column.extend(values)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], ["d", "th", "start", "stop", "w1", "w2"])

    same = (F.col("d") == F.col("fd")) & (F.col("th") == F.col("fth"))
    return pairs.select("d", "th", "block", "fblock", same.alias("same"), "words", "fwords", "places").mapInArrow(compare, _FOUND)


def _spans(docs: DataFrame, size: int) -> DataFrame:
    """``d``, ``th`` and ``spans`` of the documents with repeated windows."""
    keyed, (d, th) = _keyed(docs.select("doc_id", "text"))
    keyed = keyed.select(F.col(d).alias("d"), F.col(th).alias("th"), F.col("text").cast("string").alias("text"))
    marks = materialise(_anchored(keyed), "anchors")
    each = marks.select("d", "th", F.explode(F.arrays_zip("h", "pos")).alias("a")).select("d", "th", F.col("a.h").alias("h"), F.col("a.pos").alias("pos"))
    hits = _after_first(each, ["h"], ["d", "th", "pos"])
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    sides = hits.select("d", "th", block("pos").alias("block"), F.col("first.d").alias("fd"), F.col("first.th").alias("fth"), block("first.pos").alias("fblock"), "pos")
    pairs = materialise(sides.groupBy("d", "th", "block", "fd", "fth", "fblock").agg(F.collect_set("pos").alias("places")), "block-pairs")
    theirs = pairs.groupBy(F.col("fd").alias("d"), F.col("fth").alias("th"), F.col("fblock").alias("block")).agg(F.count("*").alias("times"))
    theirs = materialise(theirs, "reference-blocks")
    wanted = materialise(pairs.select("d", "th", "block").unionByName(theirs.drop("times")).distinct(), "wanted-blocks")
    blocks = materialise(_blocks(keyed, wanted, size), "blocks")
    reference = theirs.join(blocks, ["d", "th", "block"]).select(F.col("d").alias("fd"), F.col("th").alias("fth"), F.col("block").alias("fblock"), F.col("words").alias("fwords"), "times")
    paired = _met(pairs, materialise(reference, "reference-words"), ["fd", "fth", "fblock"]).join(blocks, ["d", "th", "block"])
    found = materialise(_compared(paired, size), "compared")
    rest = _after_first(found.where("w1 IS NOT NULL").select("w1", "w2", "d", "th", "start"), ["w1", "w2"], ["d", "th", "start"])
    spans = found.where("stop IS NOT NULL").select("d", "th", "start", "stop").unionByName(rest.select("d", "th", "start", (F.col("start") + WINDOW).alias("stop")))
    return spans.groupBy("d", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def _kept(words: list[bytes], spans: list[Span]) -> list[bytes]:
    keep = bytearray(b"\1") * len(words)
    for x, y in spans:
        keep[x:y] = bytes(y - x)
    return list(compress(words, keep))


def without_repeats(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents with further columns: ``n_words``, ``removed`` (spans in words, end exclusive) and ``kept`` (what is left, joined by blanks)."""
    with passing_tables(docs.sparkSession) as lasting:
        spans = lasting(_spans(docs, block), "repeated-spans")
    keyed, own = _keyed(docs)
    key, found = fresh(keyed, "_key", "_spans")
    keyed = keyed.withColumn(key, F.xxhash64(*own))
    held = Bloom(spans.select(F.xxhash64("d", "th").alias("key")))
    # Texts without a repeated span stay where they are.
    clean = held.apart(keyed, key).withColumn(found, F.lit(None).cast("array<struct<start: int, stop: int>>"))
    hit = held.among(keyed, key).join(spans.toDF(*own, found), own, "left")
    rows = clean.unionByName(hit.select(*clean.columns)).drop(*own, key)
    at = rows.columns.index("text")
    out = [c for c in rows.columns if c != found]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = [], []
            for text, spans in zip(_bytes(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = text.split()
                counts.append(len(words))
                kept.append(b" ".join(_kept(words, [(s["start"], s["stop"]) for s in spans or ()])).decode("utf-8", "surrogatepass"))
            added = [pa.array(counts, pa.int64()), batch.column(batch.num_columns - 1), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*out, "n_words", "removed", "kept"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out]
    return rows.mapInArrow(drop, ", ".join([*kinds, "n_words long", "removed array<struct<start: int, stop: int>>", "kept string"]))


def digests(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the hash ``kept_sha256`` of what is left of each document."""
    found = without_repeats(docs.select("doc_id", F.col("text").cast("string").alias("text")), block)
    words_left = F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", " ")))
    return found.select("doc_id", "n_words", (F.col("n_words") - words_left).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same as DuckDB SQL, over all windows (for small tables).
ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT row, doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS k FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM texts)
), later AS (
  SELECT row, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), gone AS (
  SELECT row, list(DISTINCT p) AS gone FROM (SELECT row, unnest(range(s, s + {WINDOW})) AS p FROM later) GROUP BY row
), left_over AS (
  SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept FROM texts LEFT JOIN gone USING (row)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM left_over"""
