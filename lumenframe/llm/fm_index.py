"""An FM-index over word ids: Burrows-Wheeler transform in a wavelet tree, with array-wise backward search.

The wavelet tree is stored level by level (a wavelet matrix): one bit vector for
each bit of a symbol, packed in 64-bit words with a running count for each word.
Rank queries take arrays, so many patterns are searched in step.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)
        self.zeros = int(len(bits) - self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)


class WaveletTree:
    """Occurrences of a symbol in a prefix of a sequence."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.height, seq = [], max(1, int(size - 1).bit_length()), symbols
        for level in reversed(range(self.height)):
            bit = (seq >> level & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        #: where each symbol starts in the last order
        self.start = self._descend(np.arange(size), np.zeros(size, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(reversed(range(self.height)), self.levels, strict=True):
            ones = bits.rank1(i)
            i = np.where(c >> level & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] occurs among the first i[k] symbols."""
        return self._descend(c, i) - self.start[c]


def suffix_array(text: np.ndarray, at: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of at least their first ``enough`` symbols, by prefix doubling; and the ranks by the first ``at`` (a power of two below that).

    Patterns of up to ``enough`` symbols are intervals of this order, so a text that repeats itself is not sorted to its end.
    """
    n = len(text)
    rank, k, kept, order = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, None, None
    while k < enough or order is None:
        if k == at:
            kept = rank.copy()
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ranked = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = ranked
        k *= 2
    return order, kept


class FMIndex:
    """Index of several word-id sequences, each of one document. Word ids start at 1; 0 parts the sequences."""

    def __init__(self, sequences: list[np.ndarray], docs: list[int], window: int):
        self.window = window
        zero = np.zeros(1, np.int64)
        self.text = np.concatenate([x for s in sequences for x in (s, zero)]) if sequences else zero
        owner = np.repeat(np.array(docs, np.int64), [len(s) + 1 for s in sequences]) if sequences else zero
        n, at = len(self.text), 1 << (window - 1).bit_length() - 1
        order, rank = suffix_array(self.text, at, window)
        size = int(self.text.max()) + 1
        self.size, self.n = size, n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=size))])
        self.tree = WaveletTree(self.text[order - 1], size)
        # runs of suffixes that share their first window - 1 and window symbols
        self.low, self.high = self._runs(order, rank, at, window - 1)
        low, _ = self._runs(order, rank, at, window)
        starts = np.flatnonzero(low == np.arange(n))
        self.least = np.minimum.reduceat(owner[order], starts)[np.cumsum(low == np.arange(n)) - 1]

    def _runs(self, order, rank, at, length):
        """First place, and the one past the last, of each suffix's run."""
        shift = length - at
        past = np.full(len(rank), -1, np.int64)
        past[: len(rank) - shift] = rank[shift:]
        a, b = rank[order], past[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        return starts[which], np.append(starts[1:], len(order))[which]

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each pattern with one more symbol in front."""
        both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low, high]))
        return self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]

    def matches(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each query, the least document that holds it, or -1.

        Queries are read backwards in step. The interval of the last window - 1
        words is kept: a word in front gives the window's interval, and widening
        that to its run of shared window - 1 words drops the last word again.
        """
        m, out = self.window, [np.full(max(0, len(q) - self.window + 1), -1, np.int64) for q in queries]
        lanes = sorted((k for k in range(len(queries)) if len(queries[k]) >= m), key=lambda k: len(queries[k]))
        if not lanes or self.n <= m:
            return out
        lengths = np.array([len(queries[k]) for k in lanes])
        flat, base = np.concatenate([queries[k] for k in lanes]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.where(flat < self.size, flat, 0)
        result = np.full(len(flat), -1, np.int64)
        place = base + lengths - m  # the window that comes next; its last m - 1 words give the state
        low, high = self._search(flat, place + 1)
        active = np.arange(len(lanes))
        while len(active):
            at, c = place[active], flat[place[active]]
            l, h = self.step(c, low[active], high[active])
            found = (l < h) & (c > 0)
            hit = active[found]
            result[at[found]] = self.least[l[found]]
            low[hit], high[hit] = self.low[l[found]], self.high[l[found]]
            lost = active[~found]
            if len(lost):  # the state for the next window is searched anew
                low[lost], high[lost] = self._search(flat, place[lost])
            place[active] -= 1
            active = active[place[active] >= base[active]]
        for k, b, n in zip(lanes, base.tolist(), lengths.tolist(), strict=True):
            out[k] = result[b : b + n - m + 1]
        return out

    def _search(self, flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the window - 1 words from each start."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        for k in reversed(range(self.window - 1)):
            c = flat[start + k]
            low, high = self.step(c, low, high)
            high = np.where((c > 0) & (low < high), high, low)
        return low, high
