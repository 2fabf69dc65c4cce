"""Circular block bootstrap and percentile intervals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Values that one block of replicates may hold in memory.
BLOCK_VALUES = 1_000_000
#: Length from which blocks are copied as runs, with no place for each value.
RUN = 256


def replicates(x: np.ndarray, n_boot: int, block: int, seed: int, first: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Matrices of resampled series; all starts come from one stream, replicate after replicate.

    With first and count, those replicates alone, as they are in the whole stream: the starts before are drawn
    and left, as a draw may take more than one step of the generator, so that its place cannot be told.
    """
    n = len(x)
    block = max(1, min(int(block), n))
    per = -(-n // block)
    rng = np.random.default_rng(seed)
    end = max(1, int(n_boot)) if count is None else min(max(1, int(n_boot)), first + count)
    step, at = max(1, BLOCK_VALUES // n), 0
    around = np.concatenate([x, x[:block]]) if block >= RUN else x
    while at < end:
        k = min(step, (first if at < first else end) - at)
        starts = rng.integers(0, n, size=(k, per))
        if at >= first:
            if block < RUN:
                places = (starts[:, :, None] + np.arange(block)) % n
                yield x[places.reshape(k, per * block)[:, :n]]
            else:
                out = np.empty((k, n))
                for row, own in zip(out, starts.tolist(), strict=True):
                    for to, start in zip(range(0, n, block), own, strict=True):
                        row[to : to + block] = around[start : start + min(block, n - to)]
                yield out
        at += k


def percentile_intervals(samples: np.ndarray, levels: Iterable[float]) -> list[tuple[float, float, float]]:
    """(level, low, high) for the distinct levels in (0, 1), ascending."""
    kept = sorted({float(a) for a in levels if 0 < float(a) < 1})
    return [(a, *(float(q) for q in np.quantile(samples, [(1 - a) / 2, 1 - (1 - a) / 2]))) for a in kept]
