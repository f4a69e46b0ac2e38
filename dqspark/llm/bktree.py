"""Burkhard-Keller trees over 64-bit fingerprints, many trees at a time in numpy arrays.

A child hangs on its parent under their integer Hamming distance.  A query at
distance d from a node can only match below the edges d - r to d + r, and follows
no other.  Insertion goes level by level: of all items that meet at a node under
the same distance, the first becomes the child and the others move on to it.
"""

from __future__ import annotations

import numpy as np

EDGES = 65
# Pairs of query and node looked at in one go.
FRONT = 1 << 16


class Forest:
    """One tree per tree number; items are fingerprints, equal ones of a tree share a node's place."""

    def __init__(self, tree: np.ndarray, prints: np.ndarray):
        self.prints = prints
        order = np.lexsort((prints, tree))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (tree[order][1:] != tree[order][:-1]) | (prints[order][1:] != prints[order][:-1])
        # Items in order, cut into runs of equal fingerprints; the first of a run is the node.
        self.members = order
        self.run_start = np.flatnonzero(fresh)
        self.run_end = np.append(self.run_start[1:], len(order))
        self.node_print = prints[order[self.run_start]]
        node_tree = tree[order[self.run_start]]
        first = np.ones(len(node_tree), bool)
        first[1:] = node_tree[1:] != node_tree[:-1]
        self.tree_numbers, self.roots = node_tree[first], np.flatnonzero(first)
        self._hang(node_tree, first)

    def _hang(self, node_tree: np.ndarray, first: np.ndarray) -> None:
        waiting = np.flatnonzero(~first)
        # A fixed shuffle keeps sorted fingerprints from making lopsided trees.
        waiting = waiting[np.random.default_rng(7).permutation(len(waiting))]
        at = self.roots[np.searchsorted(self.tree_numbers, node_tree[waiting])]
        keys, children = [], []
        while len(waiting):
            edge = at * EDGES + np.bitwise_count(self.node_print[waiting] ^ self.node_print[at])
            found, place, back = np.unique(edge, return_index=True, return_inverse=True)
            child = waiting[place]
            keys.append(found)
            children.append(child)
            rest = np.ones(len(waiting), bool)
            rest[place] = False
            waiting, at = waiting[rest], child[back[rest]]
        edge = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.child = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(edge, kind="stable")
        self.child = self.child[order]
        # Children of a node below each distance, by node and distance: a place in ``child``.
        # A node has one child at most under a distance, so a mark each and a running sum will do.
        self.below = np.zeros(len(node_tree) * EDGES + 1, np.int32)
        self.below[edge + 1] = 1
        np.cumsum(self.below, out=self.below)

    def search(self, tree: np.ndarray, prints: np.ndarray, radius: int):
        """Yield ``(query, node)`` index arrays of all matches within ``radius``."""
        if not len(self.roots):
            return
        where = np.searchsorted(self.tree_numbers, tree)
        known = (where < len(self.tree_numbers)) & (
            self.tree_numbers[np.minimum(where, len(self.tree_numbers) - 1)] == tree)
        start = np.flatnonzero(known)
        stack = [(start[i:i + FRONT], self.roots[where[start[i:i + FRONT]]])
                 for i in range(0, len(start), FRONT)]
        while stack:
            asked, node = stack.pop()
            far = np.bitwise_count(prints[asked] ^ self.node_print[node]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield asked[near], node[near]
            base = node * EDGES
            low = self.below[base + np.maximum(far - radius, 0)]
            width = self.below[base + np.minimum(far + radius, EDGES - 1) + 1] - low
            some = np.flatnonzero(width)
            asked, low, width = asked[some], low[some].astype(np.int64), width[some].astype(np.int64)
            ends = np.cumsum(width)
            if not len(ends):
                continue
            # Cut the next level into pieces of a bounded size.
            cuts = np.unique(np.searchsorted(ends, np.arange(FRONT, ends[-1] + FRONT, FRONT)))
            a = 0
            for b in [*(cuts + 1), len(ends)]:
                b = min(int(b), len(ends))
                if b <= a:
                    continue
                w = width[a:b]
                step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                stack.append((np.repeat(asked[a:b], w), self.child[np.repeat(low[a:b], w) + step]))
                a = b

    def items(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of nodes: positions into ``node`` and the item at each."""
        width = self.run_end[node] - self.run_start[node]
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        return np.repeat(np.arange(len(node)), width), self.members[np.repeat(self.run_start[node], width) + step]


def hook(parent: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Join the sets of linked items in place; a set's parent is its least item."""
    while len(one):
        a, b = parent[one], parent[two]
        apart = a != b
        if not apart.any():
            return
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
