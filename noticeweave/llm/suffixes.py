"""Sorting suffixes by their first bytes, compared by prefix hashes.

Prefix sums of a polynomial modulo 2**64 give the hash of any stretch of a buffer. Two suffixes are compared by a binary
search for their longest common extension, a number of hash comparisons that is logarithmic in its length, and the byte after it. A
mergesort places all elements of all runs at once: each finds its rank in the other run by binary search.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefixes:
    """Hashes of the stretches of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])
        self.inverse = powers(INVERSE, len(data) + 1)

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Bytes, up to most, that a and b have in common from their starts."""
        known = np.zeros(len(a), np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            tried = known + step
            ok = np.flatnonzero(tried <= most)
            same = ok[self.hashes(a[ok], tried[ok]) == self.hashes(b[ok], tried[ok])]
            known[same] = tried[same]
            step >>= 1
        return known

    def compare(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """-1, 0 or 1 for the first most bytes at a and at b."""
        same = self.extension(a, b, most)
        out = np.zeros(len(a), np.int64)
        rest = np.flatnonzero(same < most)
        out[rest] = np.where(self.data[a[rest] + same[rest]] < self.data[b[rest] + same[rest]], -1, 1)
        return out


def sort_suffixes(text: Prefixes, starts: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """Indexes of starts by segment (already in order) and, within a segment, by the first most bytes."""
    order = np.arange(len(starts))
    if not len(starts):
        return order
    begins = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(starts)]]))
    begin, end = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    width = 1
    while width < sizes.max():
        slot = np.flatnonzero(end - begin > width)
        at = slot - begin[slot]
        run = at // width
        other = begin[slot] + (run ^ 1) * width
        low = np.zeros(len(slot), np.int64)
        high = np.clip(end[slot] - other, 0, width)
        left = run % 2 == 0
        mine = starts[order[slot]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            sign = text.compare(starts[order[other[open_] + middle]], mine[open_], most)
            before = (sign < 0) | (sign == 0) & ~left[open_]
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        placed = order.copy()
        placed[begin[slot] + run // 2 * 2 * width + at % width + low] = order[slot]
        order = placed
        width *= 2
    return order


def repeated(text: Prefixes, starts: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """Whether each start's first most bytes occur at another start of its segment. Equal bytes are verified."""
    order = sort_suffixes(text, starts, segment, most)
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero((segment[a] == segment[b]) & (text.hashes(starts[a], most) == text.hashes(starts[b], most)))
    out = np.zeros(len(starts), bool)
    wrong: set[int] = set()
    span = np.arange(most)
    for at in range(0, len(pair), 4096):
        x, y = a[pair[at : at + 4096]], b[pair[at : at + 4096]]
        same = (text.data[starts[x][:, None] + span] == text.data[starts[y][:, None] + span]).all(1)
        out[x[same]] = out[y[same]] = True
        wrong.update(segment[x[~same]].tolist())
    for s in wrong:  # equal hashes of different bytes: compare the bytes themselves
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(segment == s).tolist():
            first = seen.setdefault(text.data[starts[i] : starts[i] + most].tobytes(), i)
            if first != i:
                out[[first, i]] = True
    return out
