"""A compressed FM-index of a shard of texts, and the matching statistics of other texts against it.

Kept are the Burrows-Wheeler transform in a wavelet tree of packed bits, every
RATE-th place of the texts, and the lengths of the prefixes that neighbouring
suffixes share (one or two bytes each, cut off at the length asked for). The
texts and their suffix array are dropped after the construction; texts are
streamed through the index by backward search, and places are found by walking
back to a kept one.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank queries over a sequence of small numbers; bits are packed, with counts for each 64."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        s = sequence.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bits = ((s >> level) & 1).astype(np.uint8)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)]))
            self.zeros.append(len(s) - int(bits.sum()))
            s = np.concatenate([s[bits == 0], s[bits == 1]])
        # Where each symbol's places begin in the last order.
        self.begin = self._walk(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places followed through the levels along the bits of their symbols."""
        for i in range(self.levels):
            ones = self._ones(i, at)
            at = np.where((symbol >> (self.levels - 1 - i)) & 1, self.zeros[i] + ones, at - ones)
        return at

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros_like(at)
        for i in range(self.levels):
            one = (self.words[i][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(i, at)
            at = np.where(one, self.zeros[i] + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at - self.begin[symbol]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, at) - self.begin[symbol]


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence whose last value is unique, by prefix doubling."""
    n = len(values)
    _, rank = np.unique(values, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        steps = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        new[order] = steps
        rank = new
        if steps[-1] == n - 1 or k >= n:
            return order
        k *= 2


def shared_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix of an order, the length of the prefix it shares with the one before, up to most; separators (0) end it."""
    length = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for i in range(most):
        x, y = order[live - 1] + i, order[live] + i
        ok = (x < len(symbols)) & (y < len(symbols))
        live, x, y = live[ok], x[ok], y[ok]
        live = live[(symbols[x] == symbols[y]) & (symbols[x] > 0)]
        if not len(live):
            break
        length[live] = i + 1
    return length


class FMIndex:
    """Index of several texts (arrays of code points) for matches of ``span`` characters."""

    RATE = 16

    def __init__(self, texts: list[np.ndarray], span: int):
        self.span, sizes = span, np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.alphabet = np.unique(np.concatenate(texts)) if texts else np.empty(0, np.uint32)
        m, n = len(texts), int(sizes.sum()) + len(texts)
        values, symbols = np.empty(n, np.int64), np.zeros(n, np.int64)
        for i, (a, t) in enumerate(zip(self.starts, texts, strict=True)):
            code = np.searchsorted(self.alphabet, t) + 1
            symbols[a : a + len(t)] = code
            values[a : a + len(t)] = m + code
            values[a + len(t)] = i
        order, self.n = suffix_array(values) if n else np.empty(0, np.int64), n
        self.tree = WaveletTree(symbols[order - 1], len(self.alphabet) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1))])[:-1]
        # Kept places: each RATE-th, and the first of each text, before which no walk goes.
        marked = (order % self.RATE == 0) | np.isin(order, self.starts)
        self.marks, self.kept = np.packbits(marked), order[marked].astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(marked.astype(np.int64), np.arange(0, n, 64)))]) if n else np.zeros(1, np.int64)
        # Shared lengths + 1, with 0 at both ends; level k has the least of each 2**k neighbours.
        lcp = np.zeros(n + 1, np.uint8 if span < 255 else np.uint32)
        lcp[1:n] = shared_prefixes(symbols, order, span)[1:] + 1
        self.least = [lcp]
        while 2 << (len(self.least) - 1) <= n + 1:
            x, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(x[:-half], x[half:]))

    def _widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all suffixes that share their first ``length`` characters with those within lo and hi."""
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.least) - 1, -1, -1):
            x, size = self.least[k], 1 << k
            at = lo - size + 1
            go = (at >= 0) & (x[np.maximum(at, 0)] > length)
            lo[go] -= size
            go = (hi < len(x)) & (x[np.minimum(hi, len(x) - 1)] > length)
            hi[go] += size
        return lo, hi

    def _marked(self, rows: np.ndarray) -> np.ndarray:
        return (self.marks[rows >> 3] >> (7 - (rows & 7)).astype(np.uint8)) & 1 == 1

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of suffixes, by walking back to a kept place."""
        at, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self._marked(at[live])
            rows_ = at[live[done]]
            # Which of the kept places it is: marks before the block of 64, and within it.
            within = np.unpackbits(self.marks[np.minimum((rows_ >> 6 << 3)[:, None] + np.arange(8), len(self.marks) - 1)], axis=1)
            ones = (within * (np.arange(64) < (rows_ & 63)[:, None])).sum(1, dtype=np.int64)
            out[live[done]] = self.kept[self.before[rows_ >> 6] + ones] + walked[live[done]]
            live = live[~done]
            symbol, rank = self.tree.step(at[live])
            at[live] = self.first[symbol] + rank
            walked[live] += 1
        text = np.searchsorted(self.starts, out, side="right") - 1
        return text, out - self.starts[text]

    def matches(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of texts, where they reach span: text, place, and bounds of the suffixes that start with its span characters.

        The texts are read backward side by side; each step is one step of
        backward search. Where a match can't be extended it is shortened at its
        right end to the longest that other suffixes share, and tried again.
        """
        codes = []
        for t in texts:
            at = np.minimum(np.searchsorted(self.alphabet, t), max(0, len(self.alphabet) - 1))
            codes.append(np.where(self.alphabet[at] == t, at + 1, 0) if len(self.alphabet) else np.zeros(len(t), np.int64))
        flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
        sizes = np.array([len(c) for c in codes], np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        lo, hi = np.zeros(len(texts), np.int64), np.full(len(texts), self.n, np.int64)
        length, pos = np.zeros(len(texts), np.int64), sizes - 1
        out, live = [], np.flatnonzero(pos >= length)
        while len(live):
            c = flat[start[live] + pos[live]]
            a, b = (self.first[c] + self.tree.rank(np.tile(c, 2), np.concatenate([lo[live], hi[live]])).reshape(2, -1))
            ok = (c > 0) & (a < b)
            up = live[ok]
            lo[up], hi[up], length[up] = a[ok], b[ok], length[up] + 1
            over = up[length[up] > self.span]
            if len(over):
                length[over] = self.span
                lo[over], hi[over] = self._widen(lo[over], hi[over], length[over])
            full = up[length[up] == self.span]
            if len(full):
                out.append((full, pos[full], lo[full], hi[full]))
            pos[up] -= 1
            gone = live[~ok & ((c == 0) | (length[live] == 0))]
            lo[gone], hi[gone], length[gone] = 0, self.n, 0
            pos[gone] -= 1
            cut = live[~ok & (c > 0) & (length[live] > 0)]
            if len(cut):
                x = self.least[0]
                length[cut] = np.maximum(np.maximum(x[lo[cut]], x[hi[cut]]).astype(np.int64) - 1, 0)
                lo[cut], hi[cut] = self._widen(lo[cut], hi[cut], length[cut])
                none = cut[length[cut] == 0]
                lo[none], hi[none] = 0, self.n
            # What is left must be able to reach the span.
            live = live[(pos[live] >= 0) & (pos[live] + 1 + length[live] >= self.span)]
        if not out:
            e = np.empty(0, np.int64)
            return e, e, e, e
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
