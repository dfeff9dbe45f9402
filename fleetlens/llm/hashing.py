"""Vectorised hashes of words and word windows (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import U64, mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(1 << max(n - 1, 1).bit_length(), base, U64)
        table[0] = 1
        table = _powers[base] = np.multiply.accumulate(table)
    return table


def word_hashes(texts: list[bytes], breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, firsts, starts, ends): a 64-bit hash of each word of all texts in
    order, the index of each text's first word (and one past the last), and the
    words' byte ranges in the texts joined by a newline. ``breaks`` marks the
    bytes between words (a newline always is one).

    A word's hash is a polynomial over random byte values, taken from one
    running sum over all bytes."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = breaks[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.empty(0, np.int64)
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1 if len(data) else starts
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_byte_values()[data] * _power_table(_BASE, len(data))[: len(data)], out=total[1:])
    hashes = (total[ends] - total[starts]) * _power_table(_INVERSE, len(data))[starts]
    hashes = mix64(hashes + (ends - starts).astype(U64))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, begins), starts, ends


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * U64(_BASE) + hashes[k : k + n]
    return mix64(out)


def range_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of each run of word hashes from ``low`` up to before ``high``."""
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * _power_table(_BASE, len(hashes) + 1)[: len(hashes)], out=total[1:])
    value = (total[high] - total[low]) * _power_table(_INVERSE, len(hashes) + 1)[low]
    return mix64(value + (high - low).astype(U64))


def slices(texts: list[bytes], limit: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0
