"""Hashes of a text's words and of runs of words, by numpy over its bytes.

A word is hashed eight bytes at a time, each block added and mixed by a bijection of 64-bit
numbers, so words of up to eight bytes and equal length never collide. A run of words is a
polynomial over the prime field of 2**61 - 1 at a keyed place: two different runs of n words
have equal hashes with a probability of n / 2**61. (Modulo a power of two some patterns
would always collide.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

RNG = np.random.default_rng(64)
PRIME = np.uint64((1 << 61) - 1)
KEY = RNG.integers(0, 1 << 63, 2, dtype=np.uint64)
#: Where the polynomial is taken, and its inverse.
BASE = int(RNG.integers(1 << 40, (1 << 61) - 1))
INVERSE = pow(BASE, -1, int(PRIME))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer stretches are hashed one by one.
LONG = 256
#: Bytes of texts that are hashed at once.
GROUP_BYTES = 1 << 18
#: By length, the bits of a block of eight bytes that are of the stretch.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    out = ((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + al * bl
    out = (out & PRIME) + (out >> np.uint64(61))
    return np.where(out >= PRIME, out - PRIME, out)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers, or some more."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), int(PRIME))))])
    return out


KEPT = [powers(BASE, 1 << 14), powers(INVERSE, 1 << 14)]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def blocks(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The up to eight bytes (as many as are left) at places of bytes that end with eight more, as numbers."""
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view(np.uint64)[:, 0] & MASKS[np.clip(left, 0, 8)]


def padded(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a, np.zeros(16, dtype=np.uint8)])


def stretch_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes."""
    size = end - start
    h = mixed(size.astype(np.uint64) ^ KEY[0])
    if not len(h):
        return h
    more_bytes = padded(a)
    rows = np.flatnonzero(size <= LONG)
    at, left = start[rows], size[rows]
    while len(rows):
        h[rows] = mixed(h[rows] + (blocks(more_bytes, at, left) ^ KEY[1]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(a[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    """A hash for each word of a text's bytes; with lower, A-Z count as a-z."""
    return next(all_word_hashes([raw], lower))


def all_word_hashes(raws: Iterable[bytes], lower: bool = False) -> Iterator[np.ndarray]:
    """word_hashes of each text, about GROUP_BYTES of texts hashed at once."""
    for group in grouped(raws, GROUP_BYTES):
        a = np.frombuffer(b" ".join(group), dtype=np.uint8)
        if lower:
            a = LOWER[a]
        word = np.zeros(len(a) + 2, dtype=np.int8)
        word[1:-1] = ~SPACE[a]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.cumsum([len(x) + 1 for x in group])
        yield from np.split(stretch_hashes(a, start, end), np.searchsorted(start, bounds[:-1]))


def grouped(items: Iterable, size: int) -> Iterator[list]:
    """Lists of items whose lengths are about size together, in order."""
    held, n = [], 0
    for x in items:
        held.append(x)
        n += len(x)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def run_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash for every run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mixed(out + h[i : i + n], salt)
    return out


class Runs:
    """Hashes of runs of words, of any start and length, from the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if n >= len(KEPT[0]):
            KEPT[:] = powers(BASE, n + 1), powers(INVERSE, n + 1)
        each = times(hashes % PRIME, KEPT[0][:n])
        low, high = np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(each & np.uint64(0xFFFFFFFF), out=low[1:])
        np.cumsum(each >> np.uint64(32), out=high[1:])
        # 2**61 is 1, so the upper bits of high * 2**32 come round.
        self.sums = (((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (high >> np.uint64(29)) + low) % PRIME
        self.at = 0

    @classmethod
    def each(cls, hashes: Iterable[np.ndarray]) -> Iterator[Runs]:
        """Runs of each text; the sums are those of many texts one after the other."""
        for group in grouped(hashes, GROUP_BYTES // 4):
            whole, at = cls(np.concatenate(group)), 0
            for h in group:
                one = cls.__new__(cls)
                one.sums, one.at = whole.sums, at
                at += len(h)
                yield one

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        start = start + self.at
        between = (self.sums[start + length] + PRIME - self.sums[start]) % PRIME
        return mixed(mixed(times(between, KEPT[1][start])) + np.asarray(length, dtype=np.uint64))
