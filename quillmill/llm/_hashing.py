"""Vectorised hashing of bytes, words and runs of them (NumPy, 64 bit).

A sequence x has prefix sums P[i] = sum of x[j] * B**j; the hash of x[a:b] is
mix((P[b] - P[a]) * B**-a), the same wherever the run stands.  Elements are
random 64-bit names of bytes or hashes of words, so it is a polynomial hash mod
2**64 over random names; runs here are far shorter than the 2**10 elements from
which such hashes have structured collisions.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.RandomState(20240607)
BYTE = _RNG.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
B = 0x9E3779B97F4A7C15
B_INVERSE = pow(B, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text hashed at once.
STRETCH = 1 << 20
#: x20 and x09-x0D end words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i up to n."""
    if len(_POWERS.get("up", ())) <= n:
        for name, base in (("up", B), ("down", B_INVERSE)):
            x = np.full(n + 1, np.uint64(base), np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


def prefix(x: np.ndarray) -> np.ndarray:
    p = np.empty(len(x) + 1, np.uint64)
    p[0] = 0
    np.cumsum(x * powers(len(x))[0][: len(x)], out=p[1:])
    return p


def runs(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the runs [a, b) from their sequence's prefix sums."""
    return mix((p[b] - p[a]) * powers(len(p))[1][a])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, first words of texts (n + 1), and the joined bytes with words' starts and ends."""
    joined = b"\n".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[0::2], edge[1::2]
    h, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # a stretch of whole words at a time, so long texts take no more memory
        low = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, low + STRETCH, side="right")))
        part = prefix(BYTE[buf[low : ends[end - 1]]])
        h[at:end] = runs(part, starts[at:end] - low, ends[at:end] - low)
        at = end
    offs = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(starts, offs), buf, starts, ends
