"""Pairs of token sets with a least Jaccard similarity: the part that a task does on its own sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Parity bits of a set, one of which each token flips.
BITS = 1024
#: Meetings on a token that are looked at together.
TOGETHER = 1 << 21


def ceiling(x: np.ndarray) -> np.ndarray:
    """``ceil``, where what is a whole number but for rounding stays one: a bound must not be above what it bounds."""
    return np.ceil(x - 1e-9).astype(np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def pieces(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of sets of some hundred thousand tokens, or one set, so that what is made of tokens on the way stays small."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def parities(offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """BITS parity bits of each set, as 64-bit words."""
    parts, rows = [np.zeros((0, BITS // 64), np.uint64)], len(offsets) - 1
    for first in range(0, rows, 1024):
        last = min(rows, first + 1024)
        own = tokens[offsets[first] : offsets[last]]
        at = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1])) * BITS + (own & (BITS - 1))
        parts.append(np.packbits((np.bincount(at, minlength=(last - first) * BITS) & 1).astype(np.uint8)).view(np.uint64).reshape(last - first, -1))
    return np.concatenate(parts)


class Index:
    """Sets of distinct 64-bit tokens, looked up by those that are close to others.

    Prefix filtering: tokens are ordered by how many sets of the index hold them,
    and two sets that are close share one of the first of each in that order, so
    only the first are indexed and asked for. Sets are in order of their size,
    so those whose size is out of reach are a range that is not looked at.
    ``wide``: sets that ask may be smaller than those that are found.
    """

    def __init__(self, offsets: np.ndarray, tokens: np.ndarray, least: float, shared: int, wide: bool = False) -> None:
        self.least, self.shared = least, shared
        n = np.diff(offsets)
        #: Which of the given sets is at each place.
        self.rows = np.argsort(n, kind="stable")
        self.n = n[self.rows]
        self.offsets = np.concatenate([[0], np.cumsum(self.n)])
        tokens, given = np.empty_like(tokens), tokens
        for x, y in pieces(self.offsets):
            tokens[self.offsets[x] : self.offsets[y]] = given[spread(offsets[self.rows[x:y]], self.n[x:y])]
        self.marks = parities(self.offsets, tokens)
        self.vocabulary, many = np.unique(tokens, return_counts=True)
        self.rank = np.empty(len(many), np.int32)
        self.rank[np.argsort(many, kind="stable")] = np.arange(len(many))
        self.ranks = self._ordered(self.offsets, tokens)
        reach = self._reach(self.n, least if wide else 2 * least / (1 + least))
        at = spread(self.offsets[:-1], reach)
        key = self.ranks[at].astype(np.int64) << 32 | np.repeat(np.arange(len(self.n)), reach)
        order = np.argsort(key)
        self.key, self.place = key[order], (at - np.repeat(self.offsets[:-1], reach))[order].astype(np.int32)
        self.stamp = np.zeros(len(many), bool)

    def _ordered(self, offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Ranks in order in each set; -1, of a token that no set of the index holds, comes first."""
        out = np.empty(len(tokens), np.int32)
        for first, last in pieces(offsets):
            own = tokens[offsets[first] : offsets[last]]
            at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            key = np.where(self.vocabulary[at] == own, self.rank[at], -1).astype(np.int64) + 1
            key |= np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1])) << 32
            key.sort()
            out[offsets[first] : offsets[last]] = (key & 0xFFFFFFFF) - 1
        return out

    def _reach(self, n: np.ndarray, part: float) -> np.ndarray:
        """How many tokens are first, where at least a part of the set is shared."""
        return np.maximum(0, n - np.maximum(self.shared, ceiling(n * part)) + 1)

    def own(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``asked`` by the sets of the index itself, each pair once."""
        for x, y in pieces(self.offsets):
            for a, b, *more in self._met(self.n[x:y], self.offsets[x : y + 1] - self.offsets[x], self.ranks[self.offsets[x] : self.offsets[y]], self.marks[x:y], np.arange(x, y)):
                yield self.rows[a + x], self.rows[b], *more

    def asked(self, offsets: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of sets given here and of sets of the index that are close to them, their shared tokens, and the parity bits in which they differ, folded to a word."""
        for x, y in pieces(offsets):
            begin, own = offsets[x : y + 1] - offsets[x], tokens[offsets[x] : offsets[y]]
            for a, b, *more in self._met(np.diff(begin), begin, self._ordered(begin, own), parities(begin, own), None):
                yield a + x, self.rows[b], *more

    def _met(self, n: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, marks: np.ndarray, before: np.ndarray | None) -> Iterator[tuple]:
        reach = self._reach(n, self.least)
        at = spread(offsets[:-1], reach)
        row = np.repeat(np.arange(len(n)), reach)
        place, rank = at - offsets[row], ranks[at].astype(np.int64)
        row, place, rank = (x[rank >= 0] for x in (row, place, rank))
        low = np.searchsorted(self.n, ceiling(n * self.least))
        high = np.searchsorted(self.n, np.floor(n / self.least + 1e-9), "right") if before is None else before
        first = np.searchsorted(self.key, rank << 32 | low[row])
        count = np.maximum(0, np.searchsorted(self.key, rank << 32 | high[row]) - first)
        row, place, first, count = (x[count > 0] for x in (row, place, first, count))
        # Whole sets go together, up to TOGETHER meetings; one with more is looked at in pieces.
        sums = np.concatenate([[0], np.cumsum(count)])
        ends = np.flatnonzero(np.diff(row, append=-1)) + 1
        begin = 0
        while begin < len(row):
            end = max(ends[np.searchsorted(ends, begin, "right")], ends[max(0, np.searchsorted(sums[ends], sums[begin] + TOGETHER, "right") - 1)])
            pairs, x = [], begin
            while x < end:
                y = min(end, max(x + 1, int(np.searchsorted(sums, sums[x] + TOGETHER, "right")) - 1))
                post = spread(first[x:y], count[x:y])
                a, b = np.repeat(row[x:y], count[x:y]), self.key[post] & 0xFFFFFFFF
                # At the first token that two sets share, all others that they share come later in both.
                most = np.minimum(n[a] - np.repeat(place[x:y], count[x:y]), self.n[b] - self.place[post])
                keep = most >= self._need(n[a], self.n[b])
                pairs.append(np.unique(a[keep] << 32 | b[keep]))
                x = y
            met = pairs[0] if len(pairs) == 1 else np.unique(np.concatenate(pairs))
            for some in range(0, len(met), 1 << 18):
                a, b = met[some : some + (1 << 18)] >> 32, met[some : some + (1 << 18)] & 0xFFFFFFFF
                need, apart = self._need(n[a], self.n[b]), marks[a] ^ self.marks[b]
                keep = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= n[a] + self.n[b] - 2 * need
                a, b, need, apart = a[keep], b[keep], need[keep], apart[keep]
                both = self._shared(offsets, ranks, a, b)
                keep = both >= need
                yield a[keep], b[keep], both[keep], np.bitwise_xor.reduce(apart[keep], axis=1)
            begin = end

    def _need(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        return np.maximum(self.shared, ceiling((na + nb) * (self.least / (1 + self.least))))

    def _shared(self, offsets: np.ndarray, ranks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many tokens the sets a share with the sets b of the index; equal a follow each other."""
        out = np.zeros(len(a), np.int64)
        cuts = np.flatnonzero(np.diff(a, prepend=-1))
        for x, y in zip(cuts, [*cuts[1:], len(a)]):
            own = ranks[offsets[a[x]] : offsets[a[x] + 1]]
            own = own[own >= 0]
            self.stamp[own] = True
            for some in range(x, y, 4096):
                n = self.n[b[some : min(y, some + 4096)]]
                hits = self.stamp[self.ranks[spread(self.offsets[b[some : min(y, some + 4096)]], n)]]
                out[some : some + len(n)] = np.add.reduceat(hits, np.cumsum(n) - n, dtype=np.int64)
            self.stamp[own] = False
        return out
