"""Hashes of all words of a batch of texts in numpy, with no loop over words.

A word's hash is a polynomial over a fixed random table of its bytes, modulo 2^64, taken as a difference of prefix sums
and mixed; equal words have equal hashes, and unequal ones differ but for chance at 64 bits.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SLAB = 1 << 20
_powers: list[np.ndarray] = []


def _need(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLAB + 1)
        inv = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE, np.uint64), np.full(n, inv, np.uint64)
            up[0] = down[0] = 1
            _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def space_map() -> np.ndarray:
    """Lower-cases A-Z; space and the controls 9 to 13 end words (0)."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[0x20, *range(0x09, 0x0E)]] = 0
    t[0] = 0xFE  # a NUL byte is part of a word; no UTF-8 text has this byte
    return t


def letter_map() -> np.ndarray:
    """As space_map, and ASCII punctuation and controls end words, too."""
    t = space_map()
    for b in range(128):
        if not chr(b).isalnum():
            t[b] = 0
    return t


def word_hashes(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data, by slabs that end between words."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(raw):
        end = min(len(raw), at + SLAB)
        if end < len(raw):
            ends_word = np.flatnonzero(table[raw[at:end]] == 0)
            while not len(ends_word) and end < len(raw):
                end = min(len(raw), end + SLAB)
                ends_word = np.flatnonzero(table[raw[at:end]] == 0)
            if end < len(raw):
                end = at + int(ends_word[-1]) + 1
        b = table[raw[at:end]]
        inside = np.concatenate([[False], b != 0, [False]])
        edge = np.diff(inside.view(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _need(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[b] * up[: len(b)], dtype=np.uint64)])
            h = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        out.append((s + at, e + at, mix(h)))
        at = end
    if not out:
        z = np.empty(0, np.int64)
        return z, z, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


class Batch:
    """Words of several texts: starts, ends, hashes over the joined bytes; words of text i are first[i] to first[i + 1]."""

    def __init__(self, texts: list[str | None], table: np.ndarray):
        parts = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join(parts)
        self.base = np.concatenate([[0], np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))])
        self.starts, self.ends, self.hashes = word_hashes(self.data, table)
        self.first = np.searchsorted(self.starts, self.base)

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def batches(texts: list, limit: int = 1 << 20):
    """Runs [a, b) of texts with about limit characters."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t) if t is not None else 0
        if n >= limit:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
