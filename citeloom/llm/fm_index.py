"""A compressed FM-index over integer symbols, with vectorised backward search.

The Burrows-Wheeler transform sits in a wavelet matrix: one bit vector for each bit of a symbol, packed
into 64-bit words with a 32-bit running count for each word, so a rank is a lookup and a bit count.
Suffixes are sorted by their first ``depth`` symbols only, which is enough for matches up to that length.
Their array isn't kept: the index holds the owner of each suffix, in their order, as a small integer.
Searches run for many places at once; every step is a few numpy operations over all places still open.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(np.bitwise_count(packed), dtype=np.uint32))))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))
        self.base = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of each symbol's occurrences lands at the bottom."""
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word].astype(np.int64) + np.bitwise_count(self.words[k][word] & below)
            up = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            at = np.where(up, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self.descend(symbols, at) - self.base[symbols]


class FMIndex:
    """Index of ``text``, integers from 0 to sigma - 1 of which 0 parts the pieces; each place has an owner."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, owners: np.ndarray) -> None:
        n = len(text)
        rank, k = text.astype(np.int64), 1
        while k < depth:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1]
            k *= 2
        suffixes = np.argsort(rank, kind="stable")
        self.owners = owners[suffixes].astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        self.tree = WaveletMatrix(text[suffixes - 1].astype(np.int64), sigma)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) of the longest match that ends at each place of a streamed text.

        A match is a run of up to ``most`` symbols, none of them 0, that ``least`` suffixes of the index or more begin with;
        lo and hi bound those suffixes.  Backward search adds one symbol to the left of all places that
        still match; the others keep what they had.
        """
        length = np.zeros(len(ends), np.int64)
        lo_all, hi_all = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.owners), np.int64)
        open_, lo, hi = np.arange(len(ends)), lo_all, hi_all
        for step in range(most):
            open_, lo, hi = (x[ends[open_] >= step] for x in (open_, lo, hi))
            c = text[ends[open_] - step]
            m = len(open_)
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
            lo, hi = self.before[c] + both[:m], self.before[c] + both[m:]
            live = (c > 0) & (hi - lo >= least)
            open_, lo, hi = open_[live], lo[live], hi[live]
            if not len(open_):
                break
            length[open_] = step + 1
            lo_all[open_], hi_all[open_] = lo, hi
        return length, lo_all, hi_all
