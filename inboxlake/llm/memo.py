"""What a Python worker remembers of words: results as slices of flat arrays, gathered for whole blocks of texts at once.

Texts are cut before single spaces and line feeds. Arrow splits a block and numbers its different parts; only parts
that are new are worked on, and the results of all parts in order are one gather.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that are remembered, and the longest that is, in characters.
MEMORY, LONGEST = 600_000, 64


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices [start, start + size) of ``values``, one after the other."""
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(int(size.sum()))]


Make = Callable[[list[str]], tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]]


class Flat:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        self.values, self.n = np.zeros(1024, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            wider = np.zeros(2 * (self.n + len(more)), dtype=self.values.dtype)
            wider[: self.n] = self.values[: self.n]
            self.values = wider
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class Memo:
    """Results of parts, an array for each field."""

    def __init__(self, fields: list[str], apart: bool = False, memory: int | None = None, longest: int | None = None):
        #: apart: whether a text's first part, which no space precedes, has a result of its own; it is given to ``make`` of ``numbered`` after a space
        self.apart, self.kinds = apart, fields
        self.memory, self.longest = MEMORY if memory is None else memory, LONGEST if longest is None else longest
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bad, self.kept = Flat("?"), (0, [0] * len(self.kinds))
        self.values, self.start, self.size = ([Flat(k) for k in kinds] for kinds in (self.kinds, ["i8"] * len(self.kinds), ["i8"] * len(self.kinds)))

    def _learn(self, parts: list[str], make: Make) -> None:
        if not parts:
            return
        found, bad = make(parts)
        self.bad.add(bad)
        for (values, size), flat, start, sizes in zip(found, self.values, self.start, self.size):
            start.add(flat.n + np.cumsum(size) - size)
            sizes.add(size)
            flat.add(values)

    def numbered(self, texts: pa.Array, make: Make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts (null: empty): the number of every part, where each text's parts end, and which texts hold a part that can't stand alone.

        ``make`` takes new parts and gives for each field the values of all in a row and how many each has, and which parts can't be worked on
        alone; texts with such a part are left to the caller. Numbers hold until the next call.
        """
        self._release()
        if len(self.known) > self.memory:
            self.forget()
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n"), " ")
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        flat = split.flatten().dictionary_encode()
        place, parts = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        first = [" " + parts[i] for i in place[begin].tolist()] if self.apart else []
        parts += dict.fromkeys(first)
        own = np.fromiter(map(self.known.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        at = np.flatnonzero(own < 0)
        new = [parts[i] for i in at.tolist()]
        long = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) > self.longest
        if long.any():  # they come last, so that they can be given back
            order = np.argsort(long, kind="stable")
            at, new = at[order], [new[i] for i in order.tolist()]
        short = len(new) - int(long.sum())
        own[at] = np.arange(self.bad.n, self.bad.n + len(new))
        self.known.update(zip(new[:short], range(self.bad.n, self.bad.n + short)))
        self._learn(new[:short], make)
        kept = self.bad.n, [x.n for x in self.values]
        self._learn(new[short:], make)
        number = own[place]
        if self.apart:
            late = dict(zip(parts[len(flat.dictionary) :], own[len(flat.dictionary) :].tolist()))
            number[begin] = [late[x] for x in first]
        bad = np.logical_or.reduceat(self.bad.values[number], begin) if len(begin) else np.zeros(0, dtype=bool)
        self.kept = kept
        return number, ends.astype(np.int64), bad

    def _release(self) -> None:
        """Gives back what parts too long to be remembered took."""
        self.bad.n, values = self.kept
        for flat, most, start, size in zip(self.values, values, self.start, self.size):
            flat.n, start.n, size.n = most, self.bad.n, self.bad.n

    def sizes(self, field: int, number: np.ndarray) -> np.ndarray:
        return self.size[field].values[number]

    def results(self, field: int, number: np.ndarray) -> np.ndarray:
        return gathered(self.values[field].values, self.start[field].values[number], self.size[field].values[number])
