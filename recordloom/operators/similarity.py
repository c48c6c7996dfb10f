"""Similarity of two texts by the blocks that they share.

The longest block that both hold is taken first, then the longest ones left and
right of it, and so on; twice their length over both lengths is the ratio.
Blocks are found by a suffix automaton, in time that grows with the lengths and
not with their product. Of equally long blocks the first in ``a``, then in
``b``, counts. Letters that make up much of a long ``b`` begin no block, but
lengthen one.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From this length of ``b`` on, letters that are over a hundredth of it (and one more) are popular.
LONG, SHARE = 200, 100


class Automaton:
    """All substrings of a part of a text without its popular letters: next states by letter, lengths, links, first ends."""

    def __init__(self, b: str, low: int, high: int, popular: frozenset[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        last = 0
        for j in range(low, high):
            c = b[j]
            if c in popular:  # a block ends here, and a new one begins
                last = 0
                continue
            last = self._add(c, last, j)

    def _state(self, size: int, first: int, link: int, ways: dict[str, int]) -> int:
        self.size.append(size)
        self.first.append(first)
        self.link.append(link)
        self.next.append(ways)
        return len(self.size) - 1

    def _split(self, at: int, c: str) -> int:
        """The state reached from ``at`` by ``c``, for words no longer than one letter more than those of ``at``."""
        far = self.next[at][c]
        if self.size[far] == self.size[at] + 1:
            return far
        near = self._state(self.size[at] + 1, self.first[far], self.link[far], dict(self.next[far]))
        self.link[far] = near
        while at >= 0 and self.next[at].get(c) == far:
            self.next[at][c] = near
            at = self.link[at]
        return near

    def _add(self, c: str, last: int, j: int) -> int:
        if c in self.next[last]:  # known from before a popular letter
            return self._split(last, c)
        new = self._state(self.size[last] + 1, j, 0, {})
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, c)
        return new

    def longest(self, a: str, low: int, high: int) -> tuple[int, int, int]:
        """(start in a, start in b, length) of the longest block of a part of ``a``."""
        best, state, n = (low, 0, 0), 0, 0
        ways, link, size = self.next, self.link, self.size
        for i in range(low, high):
            c = a[i]
            while state and c not in ways[state]:
                state = link[state]
                n = size[state]
            if c in ways[state]:
                state = ways[state][c]
                n += 1
                if n > best[2]:
                    best = (i - n + 1, self.first[state] - n + 1, n)
            else:
                n = 0
        return best


def popular(b: str) -> frozenset[str]:
    n = len(b)
    return frozenset(c for c, k in Counter(b).items() if k > n // SHARE + 1) if n >= LONG else frozenset()


def shared(a: str, b: str) -> int:
    """The letters of all blocks that ``a`` and ``b`` share."""
    often, total, parts = popular(b), 0, [(0, len(a), 0, len(b))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        if a[a0:a1] == b[b0:b1] and not often:
            total += a1 - a0
            continue
        i, j, n = Automaton(b, b0, b1, often).longest(a, a0, a1)
        if not n:  # popular letters alone begin no block; without one, a block is where both begin
            i, j = a0, b0
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            parts += [p for p in ((a0, i, b0, j), (i + n, a1, j + n, b1)) if p[0] < p[1] and p[2] < p[3]]
    return total


def ratio(a: str, b: str) -> float:
    return 2.0 * shared(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of each pair of texts; null where either is null. Equal pairs of a batch are compared once."""
    out = pd.Series(float("nan"), index=a.index)
    known: dict[tuple[str, str], float] = {}
    for at in (a.notna() & b.notna()).to_numpy().nonzero()[0]:
        pair = a.iat[at], b.iat[at]
        if pair not in known:
            known[pair] = ratio(*pair)
        out.iat[at] = known[pair]
    return out
