"""Vectorised text kernels shared by the Arrow-batched operators of this subpackage.

All functions work on one Arrow batch at a time, so their memory is bounded by the batch and not by the table.
Hashes are 64-bit polynomials over UTF-8 bytes (modulo 2**64) followed by an avalanche mix; they are pure functions of
the bytes, so a recomputed task gives the same values.
"""

from __future__ import annotations

import numpy as np

#: Multiplier of the byte polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n; kept between batches."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", BASE_INV)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


#: 1 for the ASCII white space x20 and x09 to x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, in order."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's 2-word shingles; of the one word where there is only one; else empty."""
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if len(words) > 1:
        words = mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])
    return np.unique(words)


def seeds(n: int) -> np.ndarray:
    """n fixed odd multipliers for minhash functions."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def half_keys(sets: np.ndarray, starts: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """Half keys of non-empty sets laid end to end: an array of len(starts) x halves, each from ``rows`` minhashes."""
    out = np.zeros((len(starts), halves), dtype=np.uint64)
    for i, seed in enumerate(seeds(halves * rows)):
        hashed = sets * seed
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(BASE)
        column = out[:, i // rows]
        column[:] = mix(column * np.uint64(31) + np.minimum.reduceat(hashed, starts))
    return out
