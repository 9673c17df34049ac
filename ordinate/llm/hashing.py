"""Hashes of words and of runs of words, a batch of texts at a time with numpy.

A word's hash is a polynomial in its bytes modulo 2**64, then mixed; a run's
hash is a polynomial in its words' hashes, then mixed.  Everything is fixed by
the seed, on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that lets every input bit reach every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mixed(number: int) -> int:
    return int(mix(np.array([number & (2**64 - 1)], U64))[0])


class Hasher:
    """Word hashes under one seed."""

    def __init__(self, seed: int, lower: bool = False):
        self.base = mixed(seed * 2 + 1) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.step = mixed(seed * 2 + 2) | 1
        values = np.arange(1, 257, dtype=U64)
        if lower:
            values[65:91] = values[97:123]
        # Every byte of a word counts, NUL too; white space counts nothing.
        self.values = np.where(_SPACE, U64(0), mix(values + U64(mixed(seed))))
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up, self.down = (np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, b, U64))]) for b in (self.base, self.inverse))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word of data and the byte where it starts."""
        if not data:
            return np.empty(0, U64), np.empty(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        word = ~_SPACE[raw]
        starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        if not len(starts):
            return np.empty(0, U64), starts
        self._powers(len(raw))
        sums = np.add.reduceat(self.values[raw] * self.up[: len(raw)], starts)
        return mix(sums * self.down[starts]), starts

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """The hash of each run of k words, by where it starts."""
        n = len(words) - k + 1
        if n <= 0:
            return np.empty(0, U64)
        total = words[:n].copy()
        factor = 1
        for j in range(1, k):
            factor = factor * self.step % 2**64
            total += words[j : j + n] * U64(factor)
        return mix(total ^ U64(mixed(k)))


def chunks(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Neighbouring texts joined by a space, about ``limit`` bytes at a time: the first one's number, the bytes, where each text starts (and the end)."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < limit):
            size += len(texts[end] or b"") + 1
            end += 1
        part = [t or b"" for t in texts[at:end]]
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        yield at, b" ".join(part), bounds
        at = end


def hashed(texts: list[bytes | None], hashers: list[Hasher]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each text its number and its word hashes, one array for each hasher."""
    for first, data, bounds in chunks(texts):
        found = [h.words(data) for h in hashers]
        cuts = np.searchsorted(found[0][1], bounds)
        for i in range(len(bounds) - 1):
            yield first + i, [f[0][cuts[i] : cuts[i + 1]] for f in found]
