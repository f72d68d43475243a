"""T-occurrence search over inverted lists: short lists are merged by a heap that skips, long ones are probed (DivideSkip)."""

from __future__ import annotations

import math
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np

#: Cost of a probe of a long list against a step of the merge: the smaller, the more lists are probed.
PROBE = 0.002


def overlap(total: int, percent: int) -> int:
    """The least intersection of two sets whose sizes add up to ``total`` and that link: shared / union >= percent / 100."""
    return -(-percent * total // (100 + percent))


class Lists:
    """Inverted lists of the sets of a cell. Sets are numbered from the smallest, so a bound on size is a range of numbers."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.percent, self.order = percent, np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order].tolist()
        tokens = np.concatenate([*(sets[i] for i in self.order), np.zeros(0, np.uint64)])
        by = np.argsort(tokens, kind="stable")
        tokens = tokens[by]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        self.tokens = tokens[first]
        self.first, self.end = first, np.append(first[1:], len(tokens))
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[by].tolist()

    def linked(self, query: np.ndarray, low: int, high: int, known, link) -> list[int]:
        """Numbers in [low, high) of sets that link to ``query``, one of each component.

        ``known(number)`` says whether a set with enough occurrences in the short lists is connected to the query already, so
        that it need not be probed; ``link(number)`` records a link and says whether the query can stop.
        """
        n, owner, sizes, percent = len(query), self.owner, self.sizes, self.percent
        found: list[int] = []
        if low >= high or not len(self.tokens):
            return found
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        least = overlap(n + sizes[low], percent)
        if len(at) < least:
            return found
        spans = []
        for a, b in zip(self.first[at].tolist(), self.end[at].tolist(), strict=True):
            if owner[a] < low:
                a = bisect_left(owner, low, a, b)
            if a < b and owner[b - 1] >= high:
                b = bisect_left(owner, high, a, b)
            if a < b:
                spans.append((b - a, a, b))
        if len(spans) < least:
            return found
        spans.sort(reverse=True)
        n_long = min(least - 1, int(least / (PROBE * math.log2(spans[0][0] + 1) + 1)))
        long, times = [s[1:] for s in spans[:n_long]], least - n_long
        heap = [(owner[a], a, b) for _, a, b in spans[n_long:]]
        heapify(heap)
        while len(heap) >= times:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heappop(heap))
            count = len(popped)
            if count >= times:
                if not known(top):
                    need = overlap(n + sizes[top], percent)
                    left = n_long
                    for a, b in long:
                        if count >= need or count + left < need:
                            break
                        k = bisect_left(owner, top, a, b)
                        count += k < b and owner[k] == top
                        left -= 1
                    if count >= need:
                        found.append(top)
                        if link(top):
                            return found
                to = top + 1
            else:  # what comes before the times-th list's head has too few occurrences: all lists skip to it
                while heap and len(popped) < times - 1:
                    popped.append(heappop(heap))
                if not heap:
                    break
                to = heap[0][0]
            for _, a, b in popped:
                a = bisect_left(owner, to, a, b)
                if a < b:
                    heappush(heap, (owner[a], a, b))
        return found


class Forest:
    """Union-find with the sizes of its trees; a root is the smallest member."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> int:
        """Connect two members; the size of their tree."""
        a, b = sorted((self.root(x), self.root(y)))
        if a != b:
            self.up[b] = a
            self.size[a] += self.size[b]
        return self.size[a]


def largest(n: int, percent: int) -> int:
    """The size of the largest set that a set of ``n`` links to."""
    return n * 100 // percent


def smallest(n: int, percent: int) -> int:
    """The size of the smallest set that a set of ``n`` links to."""
    return -(-n * percent // 100)


def within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The root of each set's component by the links among ``sets``: each set is looked up among the smaller ones before it.

    A set that is connected to all before it is done; of a component that it has reached, no other set is probed.
    """
    lists, forest = Lists(sets, percent), Forest(len(sets))
    for q in range(1, len(sets)):
        low = bisect_left(lists.sizes, smallest(lists.sizes[q], percent), 0, q)

        lists.linked(sets[lists.order[q]], low, q, lambda x, q=q: forest.root(x) == forest.root(q), lambda x, q=q: forest.join(x, q) == q + 1)
    roots = np.empty(len(sets), dtype=np.int64)
    roots[lists.order] = lists.order[[forest.root(x) for x in range(len(sets))]] if len(sets) else roots
    return roots


class Across:
    """Search of many queries against the sets of one block, some of which are known to be connected already."""

    def __init__(self, sets: list[np.ndarray], roots: list[int], percent: int):
        self.lists, self.percent = Lists(sets, percent), percent
        self.roots = [roots[i] for i in self.lists.order.tolist()]
        self.up: dict[int, int] = {}

    def root(self, r: int) -> int:
        while (up := self.up.get(r, r)) != r:
            r = up
        return r

    def links(self, query: np.ndarray, root: int) -> list[int]:
        """Places in the block of one set of each component that ``query``, of the component ``root``, newly links to."""
        sizes, n = self.lists.sizes, len(query)
        low, high = bisect_left(sizes, smallest(n, self.percent)), bisect_left(sizes, largest(n, self.percent) + 1)

        def link(x: int) -> bool:
            a, b = sorted((self.root(self.roots[x]), self.root(root)))
            if a != b:
                self.up[b] = a
            return False

        found = self.lists.linked(query, low, high, lambda x: self.root(self.roots[x]) == self.root(root), link)
        return self.lists.order[found].tolist()


def search(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Roots of the components that links among ``sets`` give; with ``side``, only links between sides 0 and 1 count."""
    if side is None:
        return within(sets, percent)
    own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    across, forest = Across([sets[i] for i in own], own.tolist(), percent), Forest(len(sets))
    for q in other.tolist():
        for x in across.links(sets[q], q):
            forest.join(int(own[x]), q)
    return np.array([forest.root(x) for x in range(len(sets))])
