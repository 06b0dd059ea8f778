"""Words as 64-bit hashes, many texts at a time, in numpy. Words are runs of anything but ASCII white space."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
#: Powers that are kept for the next text: enough for most.
_KEPT = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


#: What the words of a stretch are multiplied with, by place.
_TURNS = _powers(0xD1342543DE82EF95, 65)[1:]
_POWERS, _BACK = _powers(_ODD, _KEPT), _powers(pow(_ODD, -1, 1 << 64), _KEPT)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, first byte and end of every word."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff((~_SPACE[raw]).astype(np.int8), prepend=0, append=0)
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word's hash: its bytes weighted by powers of an odd number, counted from its own start. Summed over the text
    # with powers from the text's start, and brought back to the word's by the inverse.
    n = len(raw)
    powers, back = (_POWERS, _BACK) if n < _KEPT else (_powers(_ODD, n + 1), _powers(pow(_ODD, -1, 1 << 64), n + 1))
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:n], out=upto[1:])
    return mix((upto[stop] - upto[first]) * back[first] + (stop - first).astype(np.uint64)), first, stop


def stretches(words: np.ndarray, size: int, turn: int = 0) -> np.ndarray:
    """The hash of every ``size`` consecutive words; of all of them, if there are fewer. Each ``turn`` gives other hashes."""
    n = max(1, len(words) - size + 1)
    found = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        found += words[k : k + n] * _TURNS[(k + turn) % len(_TURNS)]
    return mix(found)
