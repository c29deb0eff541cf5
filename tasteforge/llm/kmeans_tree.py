"""A hierarchical k-means tree: fitted on a bounded sample, walked best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BRANCHES = 16
ROUNDS = 8
QUERIES_AT_ONCE = 256


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root.  ``children`` of a leaf are empty; ``leaf`` numbers the leaves from left to right, -1 elsewhere."""

    centres: np.ndarray
    children: tuple[np.ndarray, ...]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every level."""
        node = np.zeros(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            at, members = waiting.pop()
            below = self.children[at]
            if not len(below):
                node[members] = at
                continue
            chosen = nearest(rows[members], self.centres[below])
            waiting += [(int(child), members[chosen == n]) for n, child in enumerate(below) if (chosen == n).any()]
        return self.leaf[node]

    def visits(self, rows: np.ndarray) -> Iterator[Iterator[int]]:
        """For each row its leaves, best bin first, by the inner product with their centres."""
        for begin in range(0, len(rows), QUERIES_AT_ONCE):
            for scores in (rows[begin : begin + QUERIES_AT_ONCE] @ self.centres.T).tolist():
                yield self._best_first(scores)

    def _best_first(self, scores: list[float]) -> Iterator[int]:
        """Down to a leaf by the best child each time; the other children wait in the queue."""
        waiting = [(0.0, 0)]
        while waiting:
            node = heapq.heappop(waiting)[1]
            while len(self.children[node]):
                best, *others = sorted((-scores[child], child) for child in self.children[node].tolist())
                for other in others:
                    heapq.heappush(waiting, other)
                node = best[1]
            yield int(self.leaf[node])


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (rows @ centres.T)).argmin(axis=1)


def _k_means(rows: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray | None:
    """The cluster of each row; None where the rows cannot be told apart."""
    centres = rows[draw.choice(len(rows), min(k, len(rows)), replace=False)]
    centres = np.unique(centres, axis=0)
    for _ in range(ROUNDS):
        own = nearest(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = sums[sizes > 0] / sizes[sizes > 0, None]
    own = nearest(rows, centres)
    return own if (own != own[0]).any() else None


def grow(sample: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = 16) -> Tree:
    """Split the sample until a node has at most ``leaf_rows`` rows; one leaf if there is nothing to split."""
    draw = np.random.default_rng(seed)
    centres, children = [sample.mean(axis=0)], [np.empty(0, np.int64)]
    waiting = [(0, sample)]
    while waiting:
        at, rows = waiting.pop()
        own = _k_means(rows, min(branches, -(-len(rows) // leaf_rows)), draw) if len(rows) > leaf_rows else None
        if own is None:
            continue
        parts = [rows[own == n] for n in np.unique(own)]
        children[at] = np.arange(len(centres), len(centres) + len(parts))
        waiting += list(zip(children[at].tolist(), parts))
        centres += [part.mean(axis=0) for part in parts]
        children += [np.empty(0, np.int64)] * len(parts)
    leaf = np.full(len(centres), -1, np.int64)
    down = [0]
    while down:
        node = down.pop()
        if len(children[node]):
            down += children[node][::-1].tolist()
        else:
            leaf[node] = leaf.max() + 1
    return Tree(np.array(centres), tuple(children), leaf)
