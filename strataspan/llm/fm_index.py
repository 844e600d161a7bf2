"""FM-index of a symbol sequence: suffix array by induced sorting, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

from strataspan.llm.suffixes import suffix_array


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, width: int):
        self.levels: list[tuple[int, Bits, int]] = []
        s = symbols
        for shift in range(max(1, int(width - 1).bit_length()) - 1, -1, -1):
            bit = (s >> shift) & 1 != 0
            zeros = int(len(s) - bit.sum())
            self.levels.append((shift, Bits(bit), zeros))
            s = np.concatenate((s[~bit], s[bit]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c in [0, i), for many (c, i) at once."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for shift, bits, zeros in self.levels:
            one = (c >> shift) & 1 != 0
            lo1, hi1 = bits.rank(lo), bits.rank(hi)
            lo = np.where(one, zeros + lo1, lo - lo1)
            hi = np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, its occurrences before i)."""
        c, lo, at = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.astype(np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            lo1, at1 = bits.rank(lo), bits.rank(at)
            c |= one.astype(np.int64) << shift
            lo = np.where(one, zeros + lo1, lo - lo1)
            at = np.where(one, zeros + at1, at - at1)
        return c, at - lo


class FMIndex:
    """Counts and locates patterns in a sequence of symbols 1..width-1; a closing 0 is added.

    Every ``sample``-th text position is kept; others are found by walking back to one.
    """

    def __init__(self, text: np.ndarray, width: int, sample: int = 8):
        t = np.append(text, 0).astype(np.int32)
        self.sample = sample
        sa = suffix_array(t)
        self.last = WaveletMatrix(t[sa - 1], width)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=width))))
        kept = sa % sample == 0
        self.kept, self.places = Bits(kept), sa[kept].astype(np.int64)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns (rows), by backward search of all rows together."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.first[-1], np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = patterns[live, k].astype(np.int64)
            lo[live] = self.first[c] + self.last.rank(c, lo[live])
            hi[live] = self.first[c] + self.last.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.kept.get(at[live])
            done = live[hit]
            out[done] = self.places[self.kept.rank(at[done])] + steps[done]
            live = live[~hit]
            if len(live):
                c, r = self.last.access_rank(at[live])
                at[live] = self.first[c] + r
                steps[live] += 1
        return out
