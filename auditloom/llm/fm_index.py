"""FM-index of a sequence of symbols: suffix array, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; t: symbols below 2**31, the last one 0 and nowhere else.

    The first round sorts by three symbols at once (two, if any needs more than 20 bits); each later round sorts only what
    is still tied.
    """
    n = len(t)
    x = np.concatenate([t.astype(np.int64), np.zeros(3, np.int64)])
    wide = int(t.max()) >= 1 << 20
    key = x[:n] << 31 | x[1 : n + 1] if wide else x[:n] << 40 | x[1 : n + 1] << 20 | x[2 : n + 2]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    at, sorted_key, k = np.arange(n), key[sa], 2 if wide else 3
    while True:
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        group = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[sa[at]] = group
        alone = new & np.concatenate([new[1:], [True]])
        at = at[~alone]
        if not len(at):
            return sa
        e = sa[at]
        after = np.where(e + k < n, rank[np.minimum(e + k, n - 1)] + 1, 0)
        key = rank[e] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sa[at], sorted_key = e[order], key[order]
        k *= 2


class Bits:
    """A bit vector with constant-time ranks: 64-bit words and a running count for each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """Wavelet tree stored level by level: rank of a symbol and access to a symbol in one pass over the levels."""

    def __init__(self, s: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.rows: list[Bits] = []
        for k in range(self.levels - 1, -1, -1):
            bit = (s >> k & 1).astype(bool)
            self.rows.append(Bits(bit))
            s = np.concatenate([s[~bit], s[bit]])
        first = np.full(top + 1, -1, np.int64)
        change = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        first[s[change]] = change
        self.first = first  # of each symbol, below the last level

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i."""
        for k, row in enumerate(self.rows):
            one = row.rank(i)
            i = np.where(c >> (self.levels - 1 - k) & 1, row.zeros + one, i - one)
        return i - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for row in self.rows:
            bit, one = row.get(i), row.rank(i)
            c = c << 1 | bit
            i = np.where(bit, row.zeros + one, i - one)
        return c, i - self.first[c]


class FMIndex:
    """t: symbols from 1 on, below 2**31; a terminator is added."""

    def __init__(self, t: np.ndarray, sample: int = 32):
        t = np.concatenate([np.asarray(t, np.int64), [0]])
        top = int(t.max())
        sa = suffix_array(t)
        self.n = len(t)
        self.wavelet = Wavelet(t[sa - 1], top)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=top + 1))])
        marked = sa % sample == 0
        self.marked, self.samples = Bits(marked), sa[marked].astype(np.int32)

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(p) for p in patterns], np.int64)
        return self.search_in(np.concatenate([*patterns, np.zeros(0, np.int64)]), np.cumsum(lens) - lens, lens)

    def search_in(self, symbols: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern symbols[start : start + len], by backward search of
        all patterns at once; negative symbols are unknown."""
        low, high = np.zeros(len(lens), np.int64), np.where(lens > 0, self.n, 0)
        alive = np.flatnonzero(lens)
        for step in range(int(lens.max(initial=0))):
            alive = alive[(step < lens[alive]) & (low[alive] < high[alive])]
            if not len(alive):
                break
            c = symbols[starts[alive] + lens[alive] - 1 - step]
            known = (c >= 0) & (c < len(self.wavelet.first))
            known[known] = self.wavelet.first[c[known]] >= 0
            high[alive[~known]] = low[alive[~known]]
            alive, c = alive[known], c[known]
            low[alive] = self.less[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.less[c] + self.wavelet.rank(c, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: steps back to a sampled position."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            got = self.marked.get(rows[todo]).astype(bool)
            done = todo[got]
            out[done] = self.samples[self.marked.rank(rows[done])] + steps
            todo = todo[~got]
            c, before = self.wavelet.access(rows[todo])
            rows[todo] = self.less[c] + before
            steps += 1
        return out
