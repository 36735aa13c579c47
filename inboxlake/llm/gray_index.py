"""A Gray-order hierarchical index over bit codes, for joining a set of codes with itself within a Hamming radius.

Codes are sorted by their rank in the reflected Gray code, so neighbours share most bits. Each upper node stands for up
to ``FAN`` neighbours and holds the bits that all codes below it share (a mask and a pattern); a child counts only the bits
that its parent does not hold yet. A search adds up differences from the root down and drops a whole group of codes as soon as
the sum exceeds the radius.
"""

from __future__ import annotations

import numpy as np

#: Children of a node.
FAN = 8

#: Queries that descend together, and pairs of a query and a node looked at in one step.
QUERIES, PAIRS = 1024, 1 << 20


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code (rows of uint64 words, first word first) in the Gray sequence, as words of the same shape."""
    out = np.empty_like(codes)
    odd = np.zeros(len(codes), dtype=np.uint64)
    for k in range(codes.shape[1]):
        x = codes[:, k].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(shift)
        x ^= np.uint64(0) - odd
        odd = x & np.uint64(1)
        out[:, k] = x
    return out


def distance(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count(x if mask is None else x & mask).sum(axis=1, dtype=np.int32)


class GrayIndex:
    """An index over ``codes`` (n x words, uint64) for each of their ``buckets``; only codes of one bucket are compared."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray):
        rank = gray_rank(codes)
        self.order = np.lexsort((*rank.T[::-1], buckets))
        self.codes = codes[self.order]
        group = buckets[self.order]
        #: of each level, leaves first: patterns, masks, first child, first leaf
        self.levels = [(self.codes, np.full_like(self.codes, ~np.uint64(0)), None, np.arange(len(codes) + 1))]
        while True:
            pattern, mask, _, leaf = self.levels[-1]
            new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
            if new.all() and len(self.levels) > 1:
                break
            at = np.arange(len(group))
            first = np.flatnonzero(new)
            since = at - np.repeat(first, np.diff(np.append(first, len(at))))
            starts = np.flatnonzero(since % FAN == 0)
            if not len(starts):
                break
            top = np.repeat(pattern[starts], np.diff(np.append(starts, len(at))), axis=0)
            shared = np.bitwise_and.reduceat(mask, starts, axis=0) & ~np.bitwise_or.reduceat(pattern ^ top, starts, axis=0)
            self.levels.append((pattern[starts], shared, np.append(starts, len(at)), np.append(leaf[:-1][starts], leaf[-1])))
            group = group[starts]
        #: of each level, the bits that a node counts: those its parent does not
        self.own = [
            mask & ~np.repeat(self.levels[k + 1][1], np.diff(self.levels[k + 1][2]), axis=0) if k + 1 < len(self.levels) else mask
            for k, (_, mask, _, _) in enumerate(self.levels)
        ]
        top_leaf = self.levels[-1][3]
        self.root = np.repeat(np.arange(len(top_leaf) - 1), np.diff(top_leaf))
        self.label = np.arange(len(codes))

    def _uniform(self) -> list[np.ndarray]:
        """Of each level, the component that all leaves of a node are in, or -1."""
        out = []
        for _, _, _, leaf in self.levels:
            low = np.minimum.reduceat(self.label, leaf[:-1])
            out.append(np.where(low == np.maximum.reduceat(self.label, leaf[:-1]), low, -1))
        return out

    def _merge(self, a: np.ndarray, b: np.ndarray) -> bool:
        parent = np.arange(len(self.label))
        merged = False
        while True:
            x, y = parent[self.label[a]], parent[self.label[b]]
            apart = x != y
            if not apart.any():
                break
            merged = True
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
        if merged:
            self.label = parent[self.label]
        return merged

    def components(self, radius: int) -> np.ndarray:
        """For each code, in the order given, the place of a code of its component under links within ``radius``.

        A group whose codes are all in the query's component already is dropped like one too far away, so a dense cluster
        costs far less than its pairs.
        """
        n = len(self.codes)
        if not n:
            return np.zeros(0, dtype=np.int64)
        top = len(self.levels) - 1
        uniform = self._uniform()
        for lo in range(0, n, QUERIES):
            q = np.arange(lo, min(n, lo + QUERIES))
            node = self.root[q]
            stack = [(top, q, node, distance(self.codes[q], self.levels[top][0][node], self.own[top][node]))]
            changed = False
            while stack:
                level, q, node, sums = stack.pop()
                leaf = self.levels[level][3]
                near = (sums <= radius) & (leaf[node + 1] > q + 1) & (uniform[level][node] != self.label[q])
                q, node, sums = q[near], node[near], sums[near]
                if not len(q):
                    continue
                if level == 0:
                    changed |= self._merge(q, node)
                    continue
                first = self.levels[level][2]
                many = first[node + 1] - first[node]
                ends = np.cumsum(many)
                if ends[-1] > PAIRS and len(q) > 1:
                    half = len(q) // 2
                    stack += [(level, q[half:], node[half:], sums[half:]), (level, q[:half], node[:half], sums[:half])]
                    continue
                child = np.arange(ends[-1]) - np.repeat(ends - many - first[node], many)
                q, sums = np.repeat(q, many), np.repeat(sums, many)
                below = self.levels[level - 1][0][child]
                stack.append((level - 1, q, child, sums + distance(self.codes[q], below, self.own[level - 1][child])))
            if changed:
                uniform = self._uniform()
        out = np.empty(n, dtype=np.int64)
        out[self.order] = self.order[self.label]
        return out
