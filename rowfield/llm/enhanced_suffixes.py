"""An enhanced suffix array over many short texts, and the maximal repeats of its common-prefix interval tree."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit odd hash of each `size` bytes of data; depends on these bytes alone."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * down[: n - size + 1]) | np.uint64(1)


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every node of the interval tree of at least `least` common bytes, children first.

    lcp[i] is the common prefix of the suffixes i and i + 1 in order.
    """
    stack: list[tuple[int, int]] = []
    for i, height in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > height:
            length, first = stack.pop()
            yield length, first, i
        if height >= least and (not stack or stack[-1][0] < height):
            stack.append((height, first))


def nodes(lcp: np.ndarray, least: int) -> np.ndarray:
    """`intervals` as rows. Runs of neighbours with one common prefix are one node each and need no stack."""
    joined = np.concatenate([[False], lcp >= least, [False]])
    firsts = np.flatnonzero(joined[1:] & ~joined[:-1])  # of the runs of neighbours that share enough
    lasts = np.flatnonzero(joined[:-1] & ~joined[1:])
    if not len(firsts):
        return np.zeros((0, 3), np.int64)
    ends = np.stack([firsts, lasts], axis=1).ravel()
    padded = np.append(lcp, 0)
    low, high = np.minimum.reduceat(padded, ends)[::2], np.maximum.reduceat(padded, ends)[::2]
    flat = low == high
    parts = [np.stack([low[flat], firsts[flat], lasts[flat]], axis=1)]
    step = np.zeros(len(padded) + 1, np.int64)
    step[firsts[~flat]] += 1
    step[lasts[~flat] + 1] -= 1
    place = np.flatnonzero(np.cumsum(step)[:-1])  # of the other runs, one after the other
    if len(place):
        heights = padded[place]
        found = np.fromiter(chain.from_iterable(intervals(np.where(heights >= least, heights, 0)[:-1], least)), np.int64).reshape(-1, 3)
        parts.append(np.stack([found[:, 0], place[found[:, 1]], place[found[:, 2]]], axis=1))
    return np.concatenate(parts)


def maximal_repeats(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes that share `least` bytes or more with another, in order: their texts and starts; and the maximal
    repeats as rows (length, first, last) over that order, all occurrences between first and last.

    Suffixes are ordered by the class of their first `least` bytes and, within it, by the bytes that follow; no repeat
    spans two classes. A repeat is maximal to the right as a node of the interval tree, and to the left if its
    occurrences have different bytes before them (the start of a text differs from all). Texts are UTF-8, so no byte
    is 255.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    widest = int(lengths.max(initial=0))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    if widest < least:
        return none
    # a row for each text, bytes raised by one, zeros beyond its end
    rows = np.zeros((len(texts), widest), np.uint8)
    rows[np.arange(widest) < lengths[:, None]] = np.frombuffer(b"".join(texts), np.uint8) + 1
    hashes = np.stack([rolling(row, least) for row in rows]) if widest > 4 * least else _by_row(rows, least)
    of, start = np.nonzero(np.arange(widest - least + 1) + least <= lengths[:, None])
    values, classes, counts = np.unique(hashes[of, start], return_inverse=True, return_counts=True)
    twice = counts[classes] > 1
    of, start, classes = of[twice], start[twice], classes[twice]
    if not len(of):
        return none
    flat = np.concatenate([rows, np.zeros((len(texts), widest), np.uint8)], axis=1).ravel()
    at = of * (2 * widest) + start
    ahead = np.lib.stride_tricks.sliding_window_view(flat, least)
    rest = widest - least
    key = np.empty((len(of), 8 + rest), np.uint8)
    key[:, :8] = (classes + 1).astype(">u8").view(np.uint8).reshape(-1, 8)
    if rest:
        key[:, 8:] = np.lib.stride_tricks.sliding_window_view(flat, rest)[at + least]
    order = np.argsort(key.view(f"S{8 + rest}").ravel(), kind="stable")
    key = key[order, 8:]
    of, start, classes, at = of[order], start[order], classes[order], at[order]
    lcp = np.zeros(len(of) - 1, np.int64)
    for lo in range(0, len(lcp), 65536):
        hi = min(lo + 65536, len(lcp))
        differ = key[lo + 1 : hi + 1] != key[lo:hi]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), rest) if rest else 0
        first = ahead[at[lo : hi + 1]]
        equal = (classes[lo + 1 : hi + 1] == classes[lo:hi]) & (first[1:] == first[:-1]).all(axis=1)
        lcp[lo:hi] = np.where(equal, least + common, 0)
    lcp = np.minimum(lcp, np.minimum((lengths[of] - start)[1:], (lengths[of] - start)[:-1]))
    before = np.where(start > 0, rows[of, start - 1], 0)
    # equal bytes before neighbours, counted up to each place: an interval is uniform if all of its pairs are
    same = np.concatenate([[0], np.cumsum((before[1:] == before[:-1]) & (before[1:] > 0))])
    found = nodes(lcp, least)
    return of, start, found[same[found[:, 2]] - same[found[:, 1]] < found[:, 2] - found[:, 1]]


def _by_row(rows: np.ndarray, size: int) -> np.ndarray:
    """`rolling` for all rows at once."""
    up, down = _powers(rows.shape[1])
    sums = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum(_BYTE[rows] * up[: rows.shape[1]], axis=1, out=sums[:, 1:])
    return (sums[:, size:] - sums[:, :-size]) * down[: rows.shape[1] - size + 1]
