"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factors = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors)
    return _powers[kind][:n]


def word_hashes(text: str) -> np.ndarray:
    """One hash for each maximal run of bytes other than white space, ASCII letters in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    black = np.zeros(len(raw) + 2, np.int8)
    black[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(black)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(raw))[starts])


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles; of the whole sequence where it has fewer words; none without words."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    size = min(words, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * _STEP + h[k : k + len(out)]
    return np.unique(mix(out + np.uint64(size)))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())
