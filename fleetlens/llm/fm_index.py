"""A compressed FM-index over many short sequences, in numpy.

The sequences are put one after the other, each closed by an end mark that
differs from all others. Suffixes are sorted by prefix doubling; the
Burrows-Wheeler transform goes into a wavelet matrix of packed bits with counts
per 64. Searches run backwards and all queries advance together.
"""

from __future__ import annotations

import numpy as np

from .common import U64


class WaveletMatrix:
    """Ranks in a sequence of symbols, one packed bit vector for each bit."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n_levels = max(int(n_symbols - 1).bit_length(), 1)
        self._bits, self._before, self._zeros = [], [], []
        s = symbols.astype(np.int64)
        for level in range(self.n_levels - 1, -1, -1):
            bit = (s >> level) & 1 == 1
            packed = np.zeros((len(s) // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            self._bits.append(words)
            self._before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self._zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(U64)
        return self._before[k][word] + np.bitwise_count(self._bits[k][word] & ((U64(1) << rest) - U64(1))).astype(np.int64)

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place ``i`` of the sequence ends up among the rows of ``symbol``."""
        for k in range(self.n_levels):
            one = (symbol >> (self.n_levels - 1 - k)) & 1 == 1
            ones = self._ones(k, i)
            i = np.where(one, self._zeros[k] + ones, i - ones)
        return i


class FMIndex:
    """Index of ``symbols`` (0 ...) cut into sequences at ``firsts`` (first symbol
    of each, and the total); ``owner`` is a number per sequence, of which the
    least is reported for a match. ``threshold`` is the match length of interest."""

    def __init__(self, symbols: np.ndarray, firsts: np.ndarray, owner: np.ndarray, threshold: int):
        n_seq = len(firsts) - 1
        lengths = np.diff(firsts)
        self._threshold, self._lengths = threshold, lengths
        n = len(symbols) + n_seq
        self._text = np.zeros(n, np.int64)  # 0: an end mark
        at = np.arange(len(symbols)) + np.repeat(np.arange(n_seq), lengths)
        self._text[at] = symbols + 1
        self._ends = np.cumsum(lengths + 1) - 1
        rank = self._text + (n_seq - 1)
        rank[self._ends] = np.arange(n_seq)
        order, near = self._sort(rank, threshold)
        n_symbols = int(symbols.max()) + 2 if len(symbols) else 1
        self._bwt = WaveletMatrix(self._text[order - 1], n_symbols)
        self._smaller = np.concatenate([[0], np.cumsum(np.bincount(self._text, minlength=n_symbols))])
        every = np.arange(n_symbols)
        self._origin = self._bwt.follow(every, np.zeros(n_symbols, np.int64))
        # suffixes that agree on the first ``threshold`` symbols form a block
        a = near[0][order]
        b = near[1][np.minimum(order + near[2], n - 1)]
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        self._block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        self._block_start = np.append(starts, n)
        owners = np.repeat(owner, lengths + 1)[order]
        self._least = np.minimum.reduceat(owners, starts)
        self.size = n

    @staticmethod
    def _sort(rank: np.ndarray, threshold: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, int]]:
        """Suffix order, and what tells prefixes of ``threshold`` symbols apart:
        two ranks of h-symbol prefixes, the second that many places further."""
        n, h = len(rank), 1
        near = None
        order = np.argsort(rank, kind="stable")
        while True:
            if near is None and 2 * h >= threshold:
                near = (rank, rank, max(threshold - h, 0))
            ahead = np.zeros(n, np.int64)
            ahead[: n - h] = rank[h:] + 1
            key = rank * (n + 1) + ahead
            order = np.argsort(key)
            key = key[order]
            fresh = np.zeros(n, np.int64)
            fresh[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            rank, h = fresh, 2 * h
            if rank[order[-1]] == n - 1:
                return order, near if near is not None else (rank, rank, 0)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffix starts with ``symbol`` and goes on as the rows given."""
        base = self._smaller[symbol] - self._origin[symbol]
        return base + self._bwt.follow(symbol, low), base + self._bwt.follow(symbol, high)

    def least_owners(self) -> np.ndarray:
        """For each window of ``threshold`` symbols of each sequence, in order:
        the least owner of the sequences it occurs in.

        Each sequence is streamed backwards. Its match is extended by a symbol,
        and once longer than the threshold cut back to it, which widens its rows
        to their block; so every symbol costs one backward step."""
        k, length = self._threshold, self._lengths
        n_windows = np.maximum(length - k + 1, 0)
        first = np.cumsum(n_windows) - n_windows
        out = np.zeros(int(n_windows.sum()), np.int64)
        who = np.flatnonzero(n_windows)
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.size)
        done = 0
        while len(who):
            done += 1
            symbol = self._text[self._ends[who] - done]
            low, high = self.step(symbol, low, high)
            if done >= k:
                block = self._block[low]
                out[first[who] + length[who] - done] = self._least[block]
                low, high = self._block_start[block], self._block_start[block + 1]
            more = length[who] > done
            who, low, high = who[more], low[more], high[more]
        return out
