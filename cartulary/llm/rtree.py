"""A packed R-tree over count vectors, searched by an upper bound of set overlap.

A point is the number of a set's elements in each hash group.  Two sets share at
most the sum of their coordinates' minima, so a node whose upper corner gives a
sum under the overlap that is needed holds no partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUPS = 256
FANOUT = 16


def counts_of(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of counts for each of some sets whose elements are strung together."""
    at = np.repeat(np.arange(len(sizes)), sizes) * GROUPS + (elements & np.uint64(GROUPS - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(sizes) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


class CountTree:
    """sizes: elements of each set, none empty; counts: a row per set.  left: where given, pairs have one row in it and one not."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, left: np.ndarray | None = None):
        spread = counts.std(axis=0)
        widest = np.argsort(-spread)[:2]
        order = np.lexsort([*(counts[:, k] // max(1, int(spread[k])) for k in widest), sizes])
        self.order, self.sizes, self.counts = order, sizes[order], counts[order]
        self.left = None if left is None else left[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        corner, low, high = self.counts, self.sizes, self.sizes
        while len(low) > FANOUT:
            at = np.arange(0, len(low), FANOUT)
            corner, low, high = np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((corner, low, high))

    def partners(self, size: int, count: np.ndarray, percent: int) -> np.ndarray:
        """Positions, in the tree's order, of sets that may reach the percentage of the union with this one."""
        nodes = np.arange(len(self.levels[-1][1]) if self.levels else len(self.sizes))
        for corner, low, high in [*reversed(self.levels), (self.counts, self.sizes, self.sizes)]:
            nodes = nodes[nodes < len(low)]
            nodes = nodes[(100 * high[nodes] >= percent * size) & (percent * low[nodes] <= 100 * size)]
            least = np.maximum(low[nodes], -(-percent * size // 100))
            shared = np.minimum(corner[nodes], count).sum(axis=1)
            nodes = nodes[(100 + percent) * shared >= percent * (size + least)]
            if corner is not self.counts:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return nodes

    def candidates(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each row the rows that may be similar to it, by row numbers; each pair once."""
        for i in range(len(self.order)):
            if self.left is not None and not self.left[i]:
                continue
            near = self.partners(int(self.sizes[i]), self.counts[i], percent)
            near = near[~self.left[near]] if self.left is not None else near[near > i]
            if len(near):
                yield int(self.order[i]), self.order[near]


class Forest:
    """Trees of linked rows; the edges that joined two trees are kept."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        own = self.root[i]
        apart = others[self.root[others] != own]
        if len(apart):
            roots, first = np.unique(self.root[apart], return_index=True)
            self.edges += [(i, int(apart[k])) for k in first]
            self.root[np.isin(self.root, roots)] = own


def verified(elements: np.ndarray, sizes: np.ndarray, percent: int, left: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the sets that reach the percentage of the union with it, each pair once: found by the tree, tested on all elements."""
    tree = CountTree(sizes, counts_of(elements, sizes), left)
    values, number = np.unique(elements, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(values), bool)
    for i, near in tree.candidates(percent):
        mark[number[at[i] : at[i + 1]]] = True
        n = sizes[near]
        begin = np.cumsum(n) - n
        flat = np.repeat(at[near] - begin, n) + np.arange(int(n.sum()))
        shared = np.add.reduceat(mark[number[flat]], begin, dtype=np.int64)
        mark[number[at[i] : at[i + 1]]] = False
        near = near[100 * shared >= percent * (n + sizes[i] - shared)]
        if len(near):
            yield i, near
