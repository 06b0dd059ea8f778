"""Packing token sequences by Karmarkar-Karp multiway differencing (operator 7).

A task streams its documents, cuts each into pieces, and packs every ``group`` pieces that don't fill a window
by themselves as one batch: memory is bounded by the batch, nothing is shuffled, and a key with many rows is no
different from many keys. The windows of a batch depend on its rows alone, so a task that runs again after a
lost executor gives the same ones; ``sequence_id`` holds the partition's number in its upper bits.

Cases: a null or empty text is one piece holding the end id alone; null ids stay null; repeated rows are packed
once for each row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: Pieces packed together. A batch of several hundred leaves under one window of padding to its end.
GROUP = 768
#: A piece that doesn't fill a window is cut into parts of at most so many ids: more parts for each window balance better.
PART = 512
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps; when full, it starts anew.
CACHE_WORDS = 300_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# The white space, letters and numbers of Latin-1 as the tokenizer's own pattern has them, lower case.
_L = "a-zªµºß-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = " \t\n\x0b\x0c\r\x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Characters that str.split() takes for white space and the tokenizer doesn't.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


class _Words(dict):
    """The ids of lower-case words, each worked out when first asked for."""

    def __init__(self, whole: Callable[[str], bytes], vocab: dict[str, int]) -> None:
        import tiktoken

        self.whole = whole
        # The same vocabulary for the faster library, over bytes: a word's last byte is another symbol than the same
        # byte within it, so it is mapped to a byte that these words don't have.
        letters = [*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(0x80, 0xC0), 0xC2, 0xC3]
        last = dict(zip(letters, (b for b in range(256) if b not in letters), strict=False))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies show these as themselves
        symbol = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for name, i in vocab.items():
            raw = [symbol.get(c, 0) for c in name.removesuffix("</w>")]
            if raw and all(b in last for b in raw):
                if name.endswith("</w>"):
                    raw[-1] = last[raw[-1]]
                ranks[bytes(raw)] = i
        self.last = [bytes([last.get(b, 0)]) for b in range(256)]
        core = getattr(tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
        self.merge = getattr(core, "encode_single_piece", None)  # not a public member: without it words go to the tokenizer

    def _letters(self, word: str) -> bytes:
        if self.merge is None:
            return self.whole(word)
        raw = word.encode()
        return array("I", self.merge(raw[:-1] + self.last[raw[-1]])).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self._letters(word)
        elif word[:-1].isalpha() and word[-1] in ".,;:!?":
            ids = self[word[:-1]] + self[word[-1]]
        else:
            ids = b"".join([self[p] if p != word else self.whole(p) for p in _PIECE.findall(word)])
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """The tokenizer's ids as little-endian unsigned 32-bit bytes.

    Byte-pair merges never cross a word, so the ids of a text are those of its words, one after another; words
    seen before come from a table. Texts with characters outside Latin-1, where lower case and normal forms have
    special cases, and texts that spell a special token go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.whole, self.tokenizer.get_vocab(with_added_tokens=False))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<|" in text or any(c in text for c in _ODD_SPACE):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def karmarkar_karp(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The way (0 to ways - 1) of each size, by repeatedly merging the two partial partitions of largest spread, largest sums on smallest."""
    n = len(sizes)
    if ways <= 1 or n == 0:
        return np.zeros(n, np.int64)
    nodes: list[tuple] = []  # (left node, right node, order) of merges; leaves are ~item
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        sums = np.zeros(ways, np.int64)
        sums[0] = sizes[i]
        heap.append((-int(sizes[i]), len(heap), ~i, sums))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = x + y[::-1]  # x falls, y rises
        order = np.argsort(-both, kind="stable")
        both = both[order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), tie, len(nodes) - 1, both))
        tie += 1
    way = np.zeros(n, np.int64)
    stack = [(heap[0][2], np.arange(ways))]
    while stack:
        node, label = stack.pop()
        if node < 0:
            way[~node] = label[0]
            continue
        a, b, order = nodes[node]
        mine = np.empty(ways, np.int64)
        mine[order] = label
        stack += [(a, mine), (b, mine[::-1])]
    return way


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most ``capacity``: as few as the total allows, and more whenever differencing exceeds it."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        way = karmarkar_karp(sizes, ways)
        over = np.bincount(way, sizes, ways).max(initial=0)
        if over <= capacity:
            return way
        ways += max(1, ways // 256)


def _cuts(tokens: int, window: int, part: int) -> Iterator[tuple[int, int]]:
    full = tokens // window
    for k in range(full):
        yield k * window, window
    at, rest = full * window, tokens - full * window
    parts = -(-rest // part)
    for k in range(parts):
        length = rest // parts + (k < rest % parts)
        yield at, length
        at += length


def _emit(rows: list[tuple], first: int, window: int) -> tuple[list[np.ndarray], int]:
    table = np.array(rows, object)
    doc, (start, length, crc, total) = table[:, 0], table[:, 1:].astype(np.int64).T
    full = length == window
    way = np.empty(len(rows), np.int64)
    small = np.flatnonzero(~full)
    way[small] = pack(length[small], window)
    used = int(way[small].max(initial=-1)) + 1
    way[full] = used + np.arange(full.sum())
    order = np.argsort(way, kind="stable")
    sorted_way, sorted_len = way[order], length[order]
    ends = np.cumsum(sorted_len)
    begins = ends - sorted_len
    offset = np.empty(len(rows), np.int64)
    offset[order] = begins - begins[np.searchsorted(sorted_way, sorted_way)]
    n = int(way.max(initial=-1)) + 1
    return [doc, start, length, crc, total, first + way, offset], first + n


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, group: int = GROUP, part: int = PART) -> DataFrame:
    """One row for each piece of a document's ids; the pieces of a ``sequence_id`` fill it from offset 0 without gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        else:
            path = tokenizer
        encode = Encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        small = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, rows, small
            columns, sequence = _emit(rows, sequence, window)
            rows, small = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c.tolist() if c.dtype == object else c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + end
                total = len(raw) // 4
                view = memoryview(raw)
                for start, length in _cuts(total, window, part):
                    rows.append((doc_id, start, length, zlib.crc32(view[start * 4 : (start + length) * 4]), total))
                    small += length < window
                    if small >= group or len(rows) >= 16 * group:
                        yield flush()
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
