"""Suffix arrays of many strings in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, binary search."""

from __future__ import annotations

import numpy as np

#: Symbols (a byte plus one; zero is past a string's end) that fit into one signed 64-bit number, and bits of each.
PACK, BITS = 7, 9


class Suffixes:
    """The suffixes of ``strings``, sorted. A string ends below every byte; equal suffixes are sorted by their place.

    ``start`` is where each string begins in the text, ``left`` how many bytes a place has up to its string's end, ``sa`` the places in
    order and ``lcp`` the common prefix of each with the one before it, never beyond a string's end.
    """

    def __init__(self, strings: list[bytes]):
        length = np.array([len(x) for x in strings], dtype=np.int64)
        self.start = np.cumsum(length + 1) - length - 1
        n = int((length + 1).sum())
        text = np.frombuffer(b"\0".join(strings) + b"\0" if strings else b"", dtype=np.uint8).astype(np.int64) + 1
        end = np.repeat(self.start + length, length + 1)
        self.left = end - np.arange(n)
        text[self.left == 0] = 0
        #: the next symbols of every place as one number
        self.key = np.zeros(n, dtype=np.int64)
        for k in range(PACK):
            self.key <<= BITS
            if k < n:
                self.key[: n - k] |= np.where(self.left[: n - k] > k, text[k:], 0)
        self.text = text
        self.sa = self._sorted(n)
        self.lcp = self._prefixes(n)

    def _sorted(self, n: int) -> np.ndarray:
        """Larsson-Sadakane: sort by the first symbols, then refine only the groups that are still equal, each time by twice as many."""
        sa = np.argsort(self.key, kind="stable")
        if not n:
            return sa
        rank = np.empty(n, dtype=np.int64)
        key = self.key[sa]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        h = PACK
        slots = np.arange(n)
        while True:
            # slots of groups that have two members or more; those whose strings have ended are in the order of their places
            single = head & np.append(head[1:], True)
            slots = slots[~single]
            if not len(slots):
                return sa
            at = sa[slots]
            over = self.left[at] < h
            if over.any():
                rank[at[over]] = slots[over]
                slots, at = slots[~over], at[~over]
                if not len(slots):
                    return sa
            group, then = rank[at], rank[np.minimum(at + h, n - 1)]
            order = np.argsort(group * n + then, kind="stable")
            at, group, then = at[order], group[order], then[order]
            sa[slots] = at
            head = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
            rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
            h *= 2

    def common(self, a: np.ndarray, b: np.ndarray, other: Suffixes | None = None, most: int | None = None) -> np.ndarray:
        """Common prefix of the suffixes at ``a`` and at ``b`` (of ``other``, if given), ``most`` or more if it is that long."""
        other = other or self
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        shift = 0
        while len(live) and (most is None or shift < most):
            x, y = self.key[a[live] + shift], other.key[b[live] + shift]
            differ = x ^ y
            # the first symbol that differs, or the end of both strings
            bits = np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1).astype(np.longdouble))), -1).astype(np.int64)
            same = np.where(differ > 0, PACK - 1 - bits // BITS, PACK)
            same = np.minimum(same, np.minimum(self.left[a[live]], other.left[b[live]]) - shift)
            out[live] += same
            live = live[same == PACK]
            shift += PACK
        return out

    def _prefixes(self, n: int) -> np.ndarray:
        """Kasai's rule on whole arrays: a place whose symbol before equals that of its neighbour has one less than the place before; the others are compared."""
        lcp = np.zeros(n, dtype=np.int64)
        if n < 2:
            return lcp
        before = np.empty(n, dtype=np.int64)  # the neighbour in front, by place
        before[self.sa[0]] = -1
        before[self.sa[1:]] = self.sa[:-1]
        place = np.arange(n)
        known = (place > 0) & (before > 0)
        known &= (self.text[place - 1] > 0) & (self.text[place - 1] == self.text[before - 1])
        known[1:] &= before[1:] == before[:-1] + 1
        known[0] = False
        compare = np.flatnonzero(~known)
        plcp = np.zeros(n, dtype=np.int64)
        some = compare[before[compare] >= 0]
        plcp[some] = self.common(some, before[some])
        last = np.maximum.accumulate(np.where(known, 0, place))
        plcp = np.where(known, plcp[last] - (place - last), plcp)
        lcp[:] = plcp[self.sa]
        return lcp

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with ``size`` bytes or more, in order, and the class of each: equal if the first ``size`` bytes are."""
        whole = self.left[self.sa] >= size
        # the least common prefix since the last such place; shorter suffixes between two that agree can't be
        places = self.sa[whole]
        apart = np.minimum(self.lcp, size) < size
        return places, np.cumsum(apart)[whole]

    def found(self, other: Suffixes, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of this and of the other whose first ``size`` bytes begin in both, by binary search of each class."""
        mine, mine_class = self.windows(size)
        theirs, their_class = other.windows(size)
        if not len(mine) or not len(theirs):
            return mine[:0], theirs[:0]
        ask = np.concatenate([[True], their_class[1:] != their_class[:-1]])
        want = theirs[ask]
        lo, hi = np.zeros(len(want), dtype=np.int64), np.full(len(want), len(mine), dtype=np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            a, b = mine[mid], want[open_]
            same = np.minimum(self.common(a, b, other, size), size - 1)
            less = self.text[a + same] < other.text[b + same]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        at = np.minimum(lo, len(mine) - 1)
        hit = (lo < len(mine)) & (self.common(mine[at], want, other, size) >= size)
        return mine[np.isin(mine_class, mine_class[at[hit]])], theirs[np.isin(their_class, their_class[ask][hit])]


def repeated(suffixes: Suffixes, size: int) -> np.ndarray:
    """Places whose first ``size`` bytes begin at another place too."""
    places, class_ = suffixes.windows(size)
    if not len(places):
        return places
    many = np.bincount(class_ - class_[0])
    return places[many[class_ - class_[0]] > 1]
