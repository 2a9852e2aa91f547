"""FM-index of a shard of word sequences in numpy: suffix array, wavelet matrix over its Burrows-Wheeler transform,
sampled suffix positions; many patterns are searched at once."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence whose last symbol is unique; ranks are tripled or doubled in length each round,
    and only suffixes that still tie are sorted again."""
    n = len(text)

    def shifted(a, h):
        return np.concatenate((a[h:], np.zeros(min(h, n), a.dtype))) if h < n else np.zeros(n, a.dtype)

    bits = int(text.max(initial=1)).bit_length()
    times = 3 if 3 * bits <= 63 else 2
    key = text.astype(np.int64)
    for k in range(1, times):
        key = (key << bits) | shifted(text, k)
    sa = np.argsort(key)
    s = key[sa]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h, bits = times, max(1, n - 1).bit_length()
    times = 3 if 3 * bits <= 63 else 2
    slots = np.arange(n)
    while True:
        tied = ~new | np.concatenate((~new[1:], [False]))
        if not tied.any():
            return sa
        slots = slots[tied]
        at = sa[slots]
        key = rank[at]
        for k in range(1, times):
            to = at + k * h
            key = (key << bits) | np.where(to < n, rank[np.minimum(to, n - 1)], 0)
        order = np.argsort(key)
        at, s = at[order], key[order]
        sa[slots] = at
        new = np.concatenate(([True], s[1:] != s[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= times


class Bits:
    """Bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    def __init__(self, text: np.ndarray):
        n = len(text)
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.levels: list[tuple[int, Bits, int]] = []
        seq = self.bwt
        for shift in range(int(text.max()).bit_length() - 1, -1, -1):
            ones = (seq >> shift) & 1 == 1
            zeros = n - int(ones.sum())
            self.levels.append((shift, Bits(ones), zeros))
            seq = np.concatenate((seq[~ones], seq[ones]))
        sampled = sa % SAMPLE == 0
        self.sampled, self.marks, self.samples = sampled, Bits(sampled), sa[sampled]

    def occurrences_before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before position i."""
        base = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            r, b = bits.rank(i), bits.rank(base)
            i = np.where(one, zeros + r, i - r)
            base = np.where(one, zeros + b, base - b)
        return i - base

    def search(self, flat: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each pattern ``flat[end - length : end]`` of symbols; empty where it doesn't occur."""
        lo, hi = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        live = np.flatnonzero(length > 0)
        c = flat[end[live] - 1]
        lo[live], hi[live] = self.starts[c], self.starts[c + 1]
        k = 1
        while True:
            live = live[hi[live] > lo[live]]
            live = live[length[live] > k]
            if not len(live):
                return lo, hi
            k += 1
            c = flat[end[live] - k]
            both = self.occurrences_before(np.concatenate((c, c)), np.concatenate((lo[live], hi[live]))) + np.tile(self.starts[c], 2)
            lo[live], hi[live] = both[: len(live)], both[len(live) :]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, walking back to a sampled one."""
        out, steps, at, who = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(who):
            found = self.sampled[at]
            out[who[found]] = self.samples[self.marks.rank(at[found])] + steps
            at, who = at[~found], who[~found]
            if len(who):
                c = self.bwt[at]
                at = self.starts[c] + self.occurrences_before(c, at)
                steps += 1
        return out
