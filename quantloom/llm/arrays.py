"""Words and five-word shingles of many texts at once, as numpy arrays (helpers for Arrow-batched tasks)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

from quantloom.llm.common import WORD_BYTES

SHINGLE = 5
#: Texts are taken together up to so many bytes, which bounds a task's arrays.
SLICE_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int, base: int) -> np.ndarray:
    p = np.full(1 << bits, np.uint64(base))
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0, base ** 1, ... (modulo 2 ** 64), n of them at least."""
    return _powers(max(21, int(n).bit_length()), base)


def slices(texts: Sequence[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of up to ``limit`` bytes (or one longer text), with the index of their first."""
    run: list[bytes] = []
    first = total = 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and total + len(t) > limit:
            yield first, run
            first, run, total = i, [], 0
        run.append(t)
        total += len(t) + 1
    if run:
        yield first, run


def words(texts: list[bytes], table: bytes = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: the text's index, a 64-bit hash, start and end byte in the texts joined by a newline.

    ``table`` makes bytes of words alike and those between words (the newline, too) spaces.
    """
    a = np.frombuffer(b"\n".join(texts).translate(table), np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = a != 0x20
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * powers(len(a), _ODD)[: len(a)], out=total[1:])
    h = mix64((total[end] - total[start]) * powers(len(a), _INVERSE)[start] + (end - start).astype(np.uint64))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return np.searchsorted(at, start, "right") - 1, h, start, end


def shingles(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's index and hash of each run of five words; a text of one to four words has one shingle of all of them."""
    parts = []
    n = len(h) - SHINGLE + 1
    if n > 0:
        s = h[:n].copy()
        for k in range(1, SHINGLE):
            s = s * np.uint64(_ODD) + h[k : k + n]
        whole = doc[:n] == doc[SHINGLE - 1 :]
        parts.append((doc[:n][whole], mix64(s[whole])))
    ids, first, count = np.unique(doc, return_index=True, return_counts=True)
    short = count < SHINGLE
    if short.any():
        d, at, c = ids[short], first[short], count[short]
        s = h[at].copy()
        for k in range(1, SHINGLE - 1):
            more = c > k
            s[more] = s[more] * np.uint64(_ODD) + h[at[more] + k]
        parts.append((d, mix64(s + c.astype(np.uint64))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def counted(doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, shingle) pairs in order, and how often each stands in its text."""
    if not len(s):
        return doc, s, np.zeros(0, np.int64)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]))
    return doc[new], s[new], np.diff(np.append(new, len(s)))


def shingle_set(text: bytes) -> np.ndarray:
    """The different shingles of one text, sorted."""
    doc, h, _, _ = words([text])
    return np.unique(shingles(doc, h)[1])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all of two sorted arrays of different values; 0 where either is empty."""
    if not len(a) or not len(b):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)
