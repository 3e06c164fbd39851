"""Similarity join of sets by signature trees.

Leaves are sets, in an order that puts similar ones side by side. A node holds the OR of its sets' token bitmaps and the
range of their sizes. Two nodes are walked at once, from the root with itself; a pair of nodes is dropped where even the
tokens that both bitmaps show can't make an overlap that their sizes call for. What is left is checked exactly.
"""

from __future__ import annotations

import numpy as np

FAN = 16
#: Bits of a bitmap when sets have too many tokens for one bit each.
MOST_BITS = 4096


class Forest:
    """Union-find; a root is the least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def _bitmaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """A bitmap of each set, how many tokens it shows, and whether each has its own bit. Tokens that one set alone has get
    no bit: they can't be common. With few other tokens every one has its own bit, else they are folded."""
    every = np.sort(np.concatenate(sets))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    bits = min(MOST_BITS, max(64, -(-len(shared) // 64) * 64))
    maps = np.zeros((len(sets), bits // 8), np.uint8)
    common = np.zeros(len(sets), np.int64)
    for k, s in enumerate(sets):
        at = np.searchsorted(shared, s)
        at = at[shared[np.minimum(at, len(shared) - 1)] == s] if len(shared) else at[:0]
        common[k] = len(at)
        np.bitwise_or.at(maps[k], at % bits // 8, (1 << (at % 8)).astype(np.uint8))
    return maps.view(np.uint64), common, len(shared) <= bits


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def linked(sets: list[np.ndarray], percent: int = 80, both: np.ndarray | None = None) -> np.ndarray:
    """Which of the sets (sorted, distinct, none empty) are linked, directly or by others: a root for each, the least
    index. Two sets link when 100 * intersection >= percent * union. With `both`, a side for each set, only pairs from
    different sides are of use; pairs of one side may be skipped."""
    n = len(sets)
    forest = Forest(n)
    if n < 2:
        return forest.up
    sizes = np.fromiter(map(len, sets), np.int64, n)
    maps, common, exact = _bitmaps(sets)
    free = common - _popcount(maps)
    low = np.fromiter((int(s.min()) for s in sets), np.uint64, n)
    high = np.fromiter((int((s * np.uint64(0x9E3779B97F4A7C15)).min()) for s in sets), np.uint64, n)
    order = np.lexsort((sizes, high, low))

    def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least overlap of sets of sizes a and b that link."""
        return -(-percent * (a + b) // (100 + percent))

    def check(i: np.ndarray, j: np.ndarray) -> None:
        """Join the pairs that link."""
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            root = forest.roots()
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if both is not None:
                cross = both[a] != both[b]
                a, b = a[cross], b[cross]
            most = _popcount(maps[a] & maps[b]) + np.minimum(free[a], free[b])
            least = needed(sizes[a], sizes[b])
            for x, y, need in zip(a[most >= least].tolist(), b[most >= least].tolist(), least[most >= least].tolist(), strict=True):
                if forest.root(x) != forest.root(y) and (exact or len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= need):
                    forest.join(x, y)

    # Neighbours in the order, and all with one set, join most of what is one group; the walk then passes over it.
    check(order[:-1], order[1:])
    check(np.full(n - 1, order[n // 2]), np.delete(order, n // 2))

    # Levels from the leaves up: a node's bitmap, least and greatest size, and greatest number of folded tokens.
    levels = [(maps[order], sizes[order], sizes[order], free[order])]
    while len(levels[-1][1]) > 1:
        cuts = np.arange(0, len(levels[-1][1]), FAN)
        m, lo, hi, fr = levels[-1]
        levels.append((np.bitwise_or.reduceat(m, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(fr, cuts)))

    def walk(level: int, a: np.ndarray, b: np.ndarray) -> None:
        m, lo, hi, fr = levels[level]
        keep = (100 * hi[a] >= percent * lo[b]) & (100 * hi[b] >= percent * lo[a])
        a, b = a[keep], b[keep]
        if level and len(a):
            # Nodes whose sets are all in one component, the same for both, have nothing left to find.
            root = forest.roots()[order]
            cuts = np.arange(0, n, FAN**level)
            least, most = np.minimum.reduceat(root, cuts), np.maximum.reduceat(root, cuts)
            done = (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])
            a, b = a[~done], b[~done]
        if not len(a):
            return
        most = _popcount(m[a] & m[b]) + np.minimum(fr[a], fr[b])
        least = np.maximum(needed(lo[a], lo[b]), -(-percent * np.maximum(lo[a], lo[b]) // 100))
        a, b = a[most >= least], b[most >= least]
        if not level:
            check(order[a], order[b])
            return
        below = len(levels[level - 1][1])
        for at in range(0, len(a), 32):
            x = a[at : at + 32, None, None] * FAN + np.arange(FAN)[:, None]
            y = b[at : at + 32, None, None] * FAN + np.arange(FAN)
            x, y = (v.ravel() for v in np.broadcast_arrays(x, y))
            ok = (x < below) & (y < below) & ((x < y) | ((x == y) & (level > 1)))
            walk(level - 1, x[ok], y[ok])

    if len(levels) > 1:
        walk(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return forest.roots()
