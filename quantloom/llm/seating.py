"""Numpy helpers of the Pitman-Yor model: arrays in little space, and seatings of restaurants' customers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Customers up to here are seated one by one; behind, in blocks of a 32nd of those seated.
SINGLE, BLOCK = 64, 32
#: Seatings that are drawn for one, of which one is taken by its weight.
DRAWS = 8
#: Dishes that are seated together: what they take stays in a core's cache.
ROWS = 4096


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0, byte plane by byte plane, as many planes as the largest needs: zeros compress to nothing."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    parts, planes = a.view(np.uint8).reshape(-1, 8), np.empty((width, len(a)), np.uint8)
    for i in range(width):  # several times faster than transposing
        planes[i] = parts[:, i]
    return bytes([width]) + planes.tobytes()


def unpack(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    out = planes[0].astype(np.int64)
    for i in range(1, width):
        out |= planes[i].astype(np.int64) << (8 * i)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b).view(np.uint64), dtype=np.uint64)


def blocks(most: int) -> Iterator[tuple[int, int]]:
    """(customers seated before, size) of each block behind the first customer."""
    s = 1
    while s < most:
        size = 1 if s < SINGLE else s // BLOCK
        yield s, size
        s += size


def reseat(c: np.ndarray, a: np.ndarray, b: np.ndarray, d: float, rng: np.random.Generator, draws: int = DRAWS) -> np.ndarray:
    """Tables of each dish's ``c`` customers, drawn given all that is seated elsewhere.

    A customer opens a table with weight a + b * t where t tables are open (a: strength and others' tables, b: discount, both times the parent's
    probability) or sits down at one with weight i - d * t after i customers. Each of several draws seats all customers in order by these
    weights; the product of the weights' sums is how much more likely the seating is than it was to be drawn, and one draw is
    taken in proportion to it. Two customers are seated exactly, more the nearer to their conditional the more draws there are; the cost is that of
    logarithmically many blocks.
    """
    t = np.ones(len(c), np.int64)
    # all draws of two customers weigh the same, so one does
    two = np.flatnonzero(c == 2)
    opens = a[two] + b[two]
    t[two] += rng.random(len(two)) * (opens + 1 - d) < opens
    order = np.flatnonzero(c > 2)
    if not len(order):
        return t
    order = order[np.argsort(-c[order], kind="stable")]
    for i in range(0, len(order), ROWS):
        some = order[i : i + ROWS]
        t[some] = _drawn(c[some], a[some, None], b[some, None], d, rng, draws)
    return t


def _drawn(n: np.ndarray, u: np.ndarray, v: np.ndarray, d: float, rng: np.random.Generator, draws: int) -> np.ndarray:
    """reseat of dishes with more than two customers each, the most first; u and v are columns."""
    tables, weight, far = np.ones((len(n), draws)), np.ones((len(n), draws)), np.zeros((int((n > SINGLE).sum()), draws))
    for s, size in blocks(int(n[0])):
        live = np.searchsorted(-n, -s)
        now = tables[:live]
        # before the second customer all draws are alike, so one column does
        opens = v[:live] * (now if s > 1 else 1)
        opens += u[:live]
        total = now * -d if s > 1 else np.full((live, 1), -d)
        total += opens
        total += s
        seated = np.minimum(size, n[:live] - s)[:, None]
        if size > 1:
            far[:live] += seated * np.log(total)
        elif s > 1:  # a share of what all draws have in common: from 1 - d to 1, so that no product leaves a double
            weight[:live] *= total / (u[:live] + v[:live] + s)
        now += rng.random(now.shape) * total < opens if size == 1 else rng.binomial(seated, opens / total)
    if len(far):
        weight[: len(far)] *= np.exp(far - far.max(1, keepdims=True))
    # the first of exponential times at these rates comes from a draw in proportion to its weight
    taken = np.argmax(weight / rng.standard_exponential(weight.shape), 1)
    return tables[np.arange(len(n)), taken].astype(np.int64)


def base_probability(k: np.ndarray, t: np.ndarray, g: dict) -> np.ndarray:
    """The unigram restaurant's probability of words with k customers at t tables; its parent is uniform over the known words and one for all others."""
    mass = g["theta"] + g["customers"]
    return np.maximum(k - g["d1"] * t, 0) / mass + (g["theta"] + g["d1"] * g["tables"]) / mass / (g["words"] + 1)


def predictive(c: np.ndarray, t: np.ndarray, c_u: np.ndarray, t_u: np.ndarray, parent: np.ndarray, g: dict) -> np.ndarray:
    """The probability of words in context restaurants that hold c_u customers at t_u tables, c and t of them the word's. An empty restaurant asks its parent."""
    mass = g["theta"] + c_u
    return np.where(c_u > 0, np.maximum(c - g["d2"] * t, 0) / mass + (g["theta"] + g["d2"] * t_u) / mass * parent, parent)
