"""Maximal repeats of many short texts: an enhanced suffix array and a stack scan of its common-prefix intervals."""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """Sorted suffixes of joined texts that have at least `least` bytes left in their text, and the common prefix with the one before.

    Suffixes are ranked by doubling the length ranked: eight bytes are an integer, then pairs of ranks are ranked again, up to the
    longest text. Bytes past a text's end count as zero, and common prefixes are cut at the nearer end.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> None:
        n = len(data)
        end = np.repeat(ends, ends - starts)
        left = end - np.arange(n)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        one = np.zeros(n, dtype=np.uint64)
        self.ranks: dict[int, np.ndarray] = {}
        for i in range(8):
            one = (one << np.uint64(8)) | np.where(left > i, padded[i : i + n], 0).astype(np.uint64)
            if i + 1 in (1, 2, 4):
                self.ranks[i + 1] = one.astype(f"u{i + 1}")
        rank = np.unique(one, return_inverse=True)[1].astype(np.int64) + 1
        self.ranks[8], length = rank, 8
        while length < (left.max() if n else 0):
            after = np.zeros(n, dtype=np.int64)
            if n > length:
                after[:-length] = np.where(left[:-length] > length, rank[length:], 0)
            rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            length *= 2
            self.ranks[length] = rank
        own = np.flatnonzero(left >= least)
        self.order = own[np.argsort(rank[own], kind="stable")]
        self.left = left
        self.before = np.where(np.arange(n) > np.repeat(starts, ends - starts), np.concatenate([[0], data[:-1]]).astype(np.int32) if n else 0, -1)
        self.common = self._common()

    def _common(self) -> np.ndarray:
        """Length of the common prefix of each suffix and the one before it; zero for the first."""
        if len(self.order) < 2:
            return np.zeros(len(self.order), np.int64)
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.left[a], self.left[b])
        out, n = np.zeros(len(a), dtype=np.int64), len(self.left)
        for length in sorted(self.ranks, reverse=True):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += np.where((out + length <= most) & (self.ranks[length][x] == self.ranks[length][y]), length, 0)
        # A rest shorter than the least length ranked above can agree up to the nearer end; the small lengths have found it.
        return np.concatenate([[0], out])

    def intervals(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, first, last) of the intervals of suffixes with a common prefix of at least `least` that are maximal repeats:
        what stands before their suffixes differs, or is a text's start. Runs with one length are read off; others are scanned with a stack."""
        linked = self.common >= least
        if not linked.any():
            return (np.empty(0, np.int64),) * 3
        edge = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1) - 1
        size = last - first
        inner = np.flatnonzero(linked)
        cuts = np.concatenate([[0], np.cumsum(size)[:-1]])
        low, high = np.minimum.reduceat(self.common[inner], cuts), np.maximum.reduceat(self.common[inner], cuts)
        found = [np.stack([low, first, last], axis=1)[low == high]]
        more: list[tuple[int, int, int]] = []
        for a, b in zip(first[low != high].tolist(), last[low != high].tolist(), strict=True):
            stack: list[tuple[int, int]] = []
            for i, length in enumerate([*self.common[a + 1 : b + 1].tolist(), 0], a + 1):
                start = i - 1
                while stack and stack[-1][0] > length:
                    deep, start = stack.pop()
                    more.append((deep, start, i - 1))
                if length and (not stack or stack[-1][0] < length):
                    stack.append((length, start))
        if more:
            found.append(np.array(more, dtype=np.int64))
        every = np.concatenate(found)
        diverse = self._diverse(every[:, 1], every[:, 2])
        return every[diverse, 0], every[diverse, 1], every[diverse, 2]

    def _diverse(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        chars = self.before[self.order]
        changed = np.concatenate([[0], np.cumsum((chars[1:] != chars[:-1]) | (chars[1:] < 0))])
        return (changed[last] > changed[first]) | (chars[first] < 0)


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Each repeat of at least `least` bytes that can't be made longer on either side in all its places, with all places (text, offset)."""
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    starts = ends - np.array([len(x) for x in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    own = SuffixArray(data, starts, ends, least)
    out = []
    for length, a, b in zip(*own.intervals(least), strict=True):
        places = np.sort(own.order[a : b + 1])
        of = np.searchsorted(ends, places, side="right")
        out.append((data[places[0] : places[0] + length].tobytes(), list(zip(of.tolist(), (places - starts[of]).tolist(), strict=True))))
    return out
