"""Splitting a text into overlapping chunks at natural boundaries: plain functions over offsets, without Spark.

A text is cut at the strongest separator it has, separators staying at the head of what follows. Pieces below the
size are packed greedily, each chunk beginning with as many whole pieces of the one before as the overlap allows;
larger pieces are cut again at weaker separators. Lengths are code points; chunks are stripped, empty ones dropped.

Nothing is copied before a chunk is known: pieces are places in the text, a run of them is a sorted array, and each chunk's
end and the next one's beginning are found in it by binary search. Single characters need no array at all.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np

# Separators from strong to weak, and the default sizes.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", ". ", " ", "")
CHUNK_SIZE, CHUNK_OVERLAP = 1200, 200


def _windows(edges: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of a run of pieces, each below the size, that lie between ``edges``."""
    first, last = 0, len(edges) - 1
    while True:
        stop = bisect_right(edges, edges[first] + size) - 1
        yield edges[first], edges[stop]
        if stop == last:
            return
        first = bisect_left(edges, max(edges[stop] - overlap, edges[stop + 1] - size))


def _spans(text: str, start: int, stop: int, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    rank = next(k for k, s in enumerate(separators) if text.find(s, start, stop) >= 0)
    if not separators[rank]:
        if size == 1:  # single characters aren't below it
            yield from ((k, k + 1) for k in range(start, stop))
        else:
            yield from _windows(range(start, stop + 1), size, overlap)
        return
    found = re.compile(re.escape(separators[rank])).finditer(text, start, stop)
    edges = np.fromiter((m.start() for m in found), np.int64)
    edges = np.concatenate([[start], edges[edges > start], [stop]])
    run = 0
    for k in (*np.flatnonzero(np.diff(edges) >= size).tolist(), len(edges) - 1):
        if k > run:
            yield from _windows(edges[run : k + 1].tolist(), size, overlap)
        if k + 1 < len(edges):
            yield from _spans(text, int(edges[k]), int(edges[k + 1]), size, overlap, separators[rank + 1 :])
        run = k + 1


def chunk_spans(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[int, int]]:
    """Where the chunks of a text begin and end, in order; none for a null, empty or blank one."""
    if size < 1 or not 0 <= overlap <= size:
        raise ValueError("size must be positive, and overlap between 0 and size")
    if separators[-1] != "":
        separators = (*separators, "")
    if not text:
        return
    for start, stop in _spans(text, 0, len(text), size, overlap, separators):
        raw = text[start:stop]
        start, kept = start + len(raw) - len(raw.lstrip()), len(raw.strip())
        if kept:
            yield start, start + kept


def split_text(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text in order."""
    return [text[x:y] for x, y in chunk_spans(text, size, overlap, separators)]
