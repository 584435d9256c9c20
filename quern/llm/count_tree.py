"""An R-tree over vectors of group counts, joined with itself.

A set's tokens are hashed to G groups; its point is the vector of group counts. Two sets share at most the sum of the smaller
counts of each group, and two nodes' sets at most the sum of the smaller of the nodes' largest counts. Sets of like size
have equal G or G of neighbouring powers of two; a vector is folded to half of its G by adding its
halves, so the tree of each G also holds the folded points of 2 G. Points are packed bottom-up, LEAF to a leaf and FAN nodes to a
node; the join goes down from the top and keeps the pairs of nodes whose bound allows a link.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, FAN = 8, 8
#: Counts that are compared at once, whatever the width of points.
CELLS = 1 << 20


def groups_for(size: int, per_group: int) -> int:
    return max(16, 1 << (size // per_group).bit_length())


def count_vector(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Counts of tokens by group, held to 255 by spreading no further: a set's tokens are distinct hashes."""
    at = ((tokens >> np.uint64(12)) & np.uint64(groups - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=groups), 255).astype(np.uint8)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection for which 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def shared_by_all(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed coordinate minima of each row of x and each row of y, over some coordinates at a time."""
    out, step = np.zeros((len(x), len(y)), dtype=np.int64), max(1, CELLS // (len(x) * len(y)))
    for k in range(0, x.shape[1], step):
        out += np.minimum(x[:, None, k : k + step], y[None, :, k : k + step]).sum(axis=2, dtype=np.int64)
    return out


class Tree:
    """Members in order of size, then of the count in the first half of groups, under nodes of several levels."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = max(LEAF, int(np.sqrt(len(points) * LEAF)))
        rank = np.empty(len(points), dtype=np.int64)
        rank[np.argsort(sizes, kind="stable")] = np.arange(len(points))
        half = points[:, : points.shape[1] // 2].sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((half, rank // slab))
        self.points, self.sizes = points[self.order], sizes[self.order]
        #: Largest counts, smallest and largest size of each node, from leaves up.
        self.levels = [self._above(self.points, self.sizes, self.sizes, LEAF)]
        while len(self.levels[-1][0]) > FAN:
            self.levels.append(self._above(*self.levels[-1], FAN))

    @staticmethod
    def _above(most: np.ndarray, least_size: np.ndarray, most_size: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cuts = np.arange(0, len(most), fan)
        return np.maximum.reduceat(most, cuts, axis=0), np.minimum.reduceat(least_size, cuts), np.maximum.reduceat(most_size, cuts)

    def leaf(self, k: int) -> slice:
        return slice(k * LEAF, min((k + 1) * LEAF, len(self.points)))

    def near_leaves(self, percent: int) -> list[tuple[int, int]]:
        """Pairs of leaves, p <= q, that may hold a link."""
        p, q = np.triu_indices(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            most, least_size, most_size = self.levels[level]
            fits = percent * np.maximum(least_size[p], least_size[q]) <= 100 * np.minimum(most_size[p], most_size[q])
            p, q = p[fits], q[fits]
            fits, step = np.zeros(len(p), dtype=bool), max(1, CELLS // most.shape[1])
            for k in range(0, len(p), step):
                a, b = p[k : k + step], q[k : k + step]
                bound = np.minimum(most[a], most[b]).sum(axis=1, dtype=np.int64)
                fits[k : k + step] = bound >= needed(least_size[a], least_size[b], percent)
            p, q = p[fits], q[fits]
            if level:
                below = len(self.levels[level - 1][0])
                a, b = np.broadcast_arrays((p * FAN)[:, None, None] + np.arange(FAN)[:, None], (q * FAN)[:, None, None] + np.arange(FAN))
                there = (a < below) & (b < below) & (a <= b)
                p, q = a[there], b[there]
        return list(zip(p.tolist(), q.tolist(), strict=True))


def forest(
    sizes: np.ndarray,
    vectors: list[np.ndarray],
    percent: int,
    verify: Callable[[int, int], bool] | None = None,
    side: np.ndarray | None = None,
    joined: np.ndarray | None = None,
) -> np.ndarray:
    """For each set a number of its component in the graph of pairs that the bound lets pass and verify accepts.

    Pairs inside one component are skipped, so a group of like sets costs about a verification for each of its
    sets. With side, only pairs of different sides count. Joined gives numbers of components to begin with.
    """
    component = np.arange(len(sizes)) if joined is None else joined.copy()
    widths = np.array([len(v) for v in vectors])
    for width in np.unique(widths)[::-1].tolist():
        native = np.flatnonzero(widths == width)
        folded = np.flatnonzero(widths == 2 * width)
        at = np.concatenate([native, folded])
        if len(at) < 2:
            continue
        points = np.empty((len(at), width), dtype=np.uint16)
        for k, m in enumerate(at.tolist()):
            points[k] = vectors[m] if k < len(native) else vectors[m].reshape(2, width).sum(axis=0, dtype=np.uint16)
        tree = Tree(points, sizes[at])
        del points
        ids, own = at[tree.order], (tree.order < len(native))
        for p, q in tree.near_leaves(percent):
            leaf, other = tree.leaf(p), tree.leaf(q)
            i, j = ids[leaf], ids[other]
            open_ = component[i][:, None] != component[j][None, :]
            open_ &= own[leaf][:, None] | own[other][None, :]
            if side is not None:
                open_ &= side[i][:, None] != side[j][None, :]
            if not open_.any():
                continue
            spare = shared_by_all(tree.points[leaf], tree.points[other]) - needed(tree.sizes[leaf][:, None], tree.sizes[other][None, :], percent)
            open_ &= spare >= 0
            while open_.any():
                a, b = divmod(int(np.argmax(np.where(open_, spare, -1))), len(j))
                if verify is None or verify(int(i[a]), int(j[b])):
                    component[component == component[j[b]]] = component[i[a]]
                    open_ &= component[i][:, None] != component[j][None, :]
                else:
                    open_[a, b] = False
                    if p == q:
                        open_[b, a] = False
    return component
