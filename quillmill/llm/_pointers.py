"""Bucket-pointer refinement of suffixes held by one task (NumPy).

Suffixes begin in the buckets of their first q units.  A bucket's identifier is
the place of its first suffix in the sorted order.  Each level sorts the suffixes
of every open bucket on the identifiers of the suffixes ``step`` units later,
which splits it, and gives the parts identifiers of their own; these updates are
what the next level reuses, so a level doubles the depth.  A bucket of one suffix
is done: its identifier is its own and no level touches it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def refined(first: np.ndarray, q: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(depth so far, bucket identifiers of all suffixes) of each level.

    first: something equal for suffixes with equal first q units, of as many suffixes as there are units.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    at, size = _groups(first[order])
    ids = np.empty(n + 1, np.int32)
    ids[order] = np.repeat(at, size)
    ids[n] = -1  # beyond the end
    open_ = order[np.repeat(size > 1, size)]
    yield q, ids[:n]
    while q < depth and len(open_):
        step = min(q, depth - q)
        own = ids[open_].astype(np.int64)
        key = own * (n + 1) + ids[np.minimum(open_ + step, n)] + 1
        order = np.argsort(key, kind="stable")
        open_, own = open_[order], own[order]
        at, size = _groups(key[order])
        begin, held = _groups(own)
        ids = ids.copy()
        ids[open_] = own + np.repeat(at, size) - np.repeat(begin, held)
        open_ = open_[np.repeat(size > 1, size)]
        q += step
        yield q, ids[:n]


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def common(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many units the suffixes a and b have in common, in whole steps of the first level's q."""
    last = len(levels[0][1]) - 1
    out = np.zeros(len(a), np.int64)
    for width, ids in reversed(levels):
        x, y = a + out, b + out
        same = (ids[np.minimum(x, last)] == ids[np.minimum(y, last)]) & (x <= last) & (y <= last)
        out += np.where(same, width, 0)
    return out


def longest_earlier(units: np.ndarray, grams: np.ndarray, q: int, depth: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix the longest beginning that starts in a suffix of a lesser owner, and where it starts.

    Beginnings are compared in steps of q units, and what is found is then lengthened
    unit by unit; those under q units count as none.  The nearest suffixes of lesser
    owners before and after a suffix in the sorted order are found by jumps along
    those already found.
    """
    levels = list(refined(grams, q, depth))
    order = np.argsort(levels[-1][1], kind="stable")
    n = len(order)
    near = np.zeros(n, np.int64)
    near[1:] = common(order[:-1], order[1:], levels)  # with the one before
    own = owner[order]
    best, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for way in (-1, 1):
        to = np.arange(n) + way
        have = near.copy() if way < 0 else np.append(near[1:], 0)
        todo = np.arange(n)
        while True:
            todo = todo[(to[todo] >= 0) & (to[todo] < n) & (have[todo] > 0)]
            todo = todo[own[to[todo]] >= own[todo]]
            if not len(todo):
                break
            via = to[todo]
            have[todo] = np.minimum(have[todo], have[via])
            to[todo] = to[via]
        ok = (to >= 0) & (to < n) & (have > best)
        best[ok], source[ok] = have[ok], order[to[ok]]
    length, where = np.empty(n, np.int64), np.empty(n, np.int64)
    length[order], where[order] = best, source
    on = np.flatnonzero(length)
    for _ in range(q - 1):
        x, y = on + length[on], where[on] + length[on]
        fits = (x < n) & (y < n)
        on, x, y = on[fits], x[fits], y[fits]
        on = on[units[x] == units[y]]
        length[on] += 1
    return length, where
