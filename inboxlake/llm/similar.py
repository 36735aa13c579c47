"""Exact links between sets of shingles inside groups of candidates.

A group that one task can hold is searched there. In a larger one a few sets, the pivots, meet all others first: all that are similar to a pivot
are connected without having met each other, as near copies of one text are. Pivots are drawn anew among what is not yet connected to the
group's largest part. What is left after some rounds meets every set of its group that is not connected to it, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, quoted, row_key, texts
from inboxlake.sources.tables import settled

#: Sets, and shingles in them, that one task holds; about how many pivots a round draws from a group, and rounds.
GROUP, GROUP_SHINGLES = 1_000, 1 << 20
PIVOTS, ROUNDS = 16, 2

#: Pairs of a shingle and a set that are counted at once.
HITS = 1 << 22


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), np.array(list(map(len, sets)), dtype=np.int64)


def search(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Places of pairs that connect all sets which links connect; two link if 100 times what they share is ``percent`` times their union or more.

    Every set that the search has reached is compared with all that it has not: a pair is left out only if links that were compared connect it.
    """
    flat, many = _flat(sets)
    name = np.unique(flat, return_inverse=True)[1] if len(flat) else np.zeros(0, dtype=np.int64)
    start = np.cumsum(many) - many
    here = np.zeros(int(name.max(initial=-1)) + 1, dtype=np.int64)
    left = np.flatnonzero(many > 0)
    a, b = [], []
    body, size = name, many[left]  # the shingles of what is left
    while len(left):
        reached = [int(left[0])]
        body, left, size = body[size[0] :], left[1:], size[1:]
        while reached and len(left):
            i = reached.pop()
            own = name[start[i] : start[i] + many[i]]
            here[own] = 1
            both = np.add.reduceat(here[body], np.cumsum(size) - size)
            here[own] = 0
            linked = 100 * both >= percent * (size + many[i] - both)
            if linked.any():
                new = left[linked].tolist()
                reached += new
                a += [i] * len(new)
                b += new
                body, left, size = body[np.repeat(~linked, size)], left[~linked], size[~linked]
    return a, b


class Lookup:
    """A few sets that many others are compared with."""

    def __init__(self, codes: np.ndarray, sets: list[np.ndarray]):
        flat, self.many = _flat(sets)
        owner = np.repeat(np.arange(len(sets)), self.many)
        order = np.argsort(flat, kind="stable")
        self.codes, self.owner = codes, owner[order]
        self.shingles, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)

    def linked(self, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``sets`` and in the lookup of all pairs that link."""
        if not len(self.shingles):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        flat, many = _flat(sets)
        at = np.minimum(np.searchsorted(self.shingles, flat), len(self.shingles) - 1)
        hit = self.shingles[at] == flat
        at, owner = at[hit], np.repeat(np.arange(len(sets)), many)[hit]
        each = self.count[at]
        pairs, shared = [], []
        # whole sets, HITS at a time
        turn = np.cumsum(np.bincount(owner, each, len(sets)))[owner] // HITS
        for lo, hi in zip(*(np.searchsorted(turn, np.unique(turn), side=s) for s in ("left", "right"))):
            n = each[lo:hi]
            place = np.repeat(self.first[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            base, span = int(owner[lo]), int(owner[hi - 1] - owner[lo] + 1) * len(self.codes)
            pair = np.repeat(owner[lo:hi] - base, n) * len(self.codes) + self.owner[place]
            if span <= HITS:
                count = np.bincount(pair, minlength=span)
                found = np.flatnonzero(count)
                count = count[found]
            else:
                found, count = np.unique(pair, return_counts=True)
            pairs.append(found + base * len(self.codes))
            shared.append(count)
        if not pairs:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        x, y = np.divmod(np.concatenate(pairs), len(self.codes))
        both = np.concatenate(shared)
        own = 100 * both >= percent * (many[x] + self.many[y] - both)
        return x[own], y[own]


def _sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def _edges(a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _searched(sets: DataFrame, percent: int) -> DataFrame:
    """Edges inside the groups ``cell`` of sets, each in one task."""

    def compared(table: pa.Table) -> pa.RecordBatch:
        cell, code, found = table.column("cell").to_numpy(), table.column("code").to_numpy(), _sets(table.column("shingles"))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        a, b = [], []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(cell)]):
            x, y = search(found[lo:hi], percent)
            a += code[lo:hi][x].tolist()
            b += code[lo:hi][y].tolist()
        return _edges(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows come sorted by cell; the last cell waits for its other rows
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column("cell")[-1].as_py()
            if held[0].column("cell")[0].as_py() == last:
                continue
            whole = pa.Table.from_batches(held)
            to = int(np.searchsorted(whole.column("cell").to_numpy(), last, side="left"))
            yield compared(whole.slice(0, to))
            held = whole.slice(to).to_batches()
        if held:
            yield compared(pa.Table.from_batches(held))

    return sets.select("cell", "code", "shingles").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _met(few: DataFrame, many: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Edges between the sets of ``few`` and those of ``many`` in one ``cell``: a task holds the few of a cell, and the others pass by.

    ``every`` link is an edge (set of ``many``, set of ``few``), or only as many as connect the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lookup, codes, sets = None, None, [], []
        for batch in batches:
            cell, late = batch.column("cell").to_numpy(), batch.column("late").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (late[1:] != late[:-1])])) if len(cell) else cell
            a, b, seen = [], [], set()
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)]):
                part = batch.slice(lo, hi - lo)
                own = part.column("code").to_numpy()
                if not late[lo]:
                    if cell[lo] != at or lookup is not None:
                        at, lookup, codes, sets = cell[lo], None, [], []
                    codes.append(own)
                    sets += _sets(part.column("shingles"))
                    continue
                if cell[lo] != at:
                    continue  # no lookup for this cell
                lookup = lookup or Lookup(np.concatenate(codes), sets)
                x, y = lookup.linked(_sets(part.column("shingles")), percent)
                if not len(x):
                    continue
                if every:
                    a += own[x].tolist()
                    b += lookup.codes[y].tolist()
                    continue
                # one edge for each set, to the first that it links with; those that it connects are few
                first = np.concatenate([[True], x[1:] != x[:-1]])
                near = lookup.codes[y]
                to = np.repeat(near[first], np.diff(np.append(np.flatnonzero(first), len(x))))
                a += own[x[first]].tolist()
                b += near[first].tolist()
                seen.update(zip(to[~first].tolist(), near[~first].tolist()))
            yield _edges(a + [p for p, _ in seen], b + [q for _, q in seen])

    both = few.select("cell", F.lit(False).alias("late"), "code", "shingles").union(many.select("cell", F.lit(True).alias("late"), "code", "shingles"))
    return both.repartition("cell").sortWithinPartitions("cell", "late").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _drawn(rest: DataFrame, turn: int) -> DataFrame:
    """(root, code): about ``PIVOTS`` of each root's sets by a hash, at least one, as many as a task can hold."""
    h = F.xxhash64("code", F.lit(turn))
    share = rest.groupBy("root").agg(F.count("*").alias("many"), F.min_by("code", h).alias("least"))
    some = rest.join(share, "root").where((F.col("code") == F.col("least")) | (F.pmod(h, F.ceil(F.col("many") / PIVOTS).cast("long")) == 0))
    order = Window.partitionBy("root").orderBy(h, "code")
    held = some.select("root", "code", F.row_number().over(order).alias("k"), F.sum("n").over(order).alias("so_far"))
    return held.where((F.col("k") == 1) | ((F.col("k") <= 4 * PIVOTS) & (F.col("so_far") <= GROUP_SHINGLES))).select("root", "code")


def _reached(sets: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """``sets`` (root, code, n, main) after a round that gave the edges ``found`` (a, b: pivot), of the roots in which some set is not main yet.

    ``main`` are sets that links are known to connect: first those of the pivot with most of them, then those of every pivot that a main set links with.
    No search for components is needed, as all edges go to pivots.
    """
    of = sets.select(F.col("code").alias("a"), "root", "main")
    stars = found.join(of, "a").groupBy("root", "b").agg(F.count("*").alias("many"))
    begun = sets.groupBy("root").agg(F.max("main").alias("begun")).where("not begun").select("root")
    top = stars.join(begun, "root").groupBy("root").agg(F.max_by("b", F.struct("many", "b")).alias("code")).select("code")
    main = sets.where("main").select("code").union(top)
    for _ in range(2):
        good = found.join(main.withColumnRenamed("code", "a"), "a", "left_semi").select("b").union(main.withColumnRenamed("code", "b")).distinct()
        main = found.join(good, "b", "left_semi").select(F.col("a").alias("code")).union(good.select(F.col("b").alias("code")))
    main = main.distinct().withColumn("new", F.lit(True))
    rows = sets.join(main, "code", "left").select("root", "code", "n", (F.col("main") | F.coalesce("new", F.lit(False))).alias("main"))
    rows = settled(rows, folder, "reached")
    return rows.join(rows.where("not main").select("root").distinct(), "root", "left_semi")


def linked(sets: DataFrame, folder: str, percent: int = 80) -> DataFrame:
    """Edges (a, b) that connect what links connect, inside each ``root`` of ``sets`` (root, code, n: long; shingles: binary, sorted unsigned 64-bit).

    A code stands in one root only. Empty sets link with nothing. See the module on how groups of more than ``GROUP`` sets are handled; no pair is left out.
    """
    pieces = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES)).cast("long")
    large = settled(sets.groupBy("root").agg(pieces.alias("pieces")).where("pieces > 1"), folder, "large-groups")
    if large.isEmpty():
        return _searched(sets.withColumn("cell", F.col("root")), percent)
    edges = [settled(_searched(sets.join(large, "root", "left_anti").withColumn("cell", F.col("root")), percent), folder, "small")]
    sets = settled(sets.join(large, "root"), folder, "large-sets")
    mixed = lambda *c: F.xxhash64("root", *c)
    left = sets.select("root", "code", "n", F.lit(False).alias("main"))
    for turn in range(ROUNDS):
        pivots = settled(sets.drop("n", "pieces").join(_drawn(left.where("not main"), turn), ["root", "code"]).join(large, "root"), folder, "pivots")
        few = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).withColumn("cell", mixed("salt"))
        here = sets.join(left.select("root").distinct(), "root", "left_semi")
        many = here.withColumn("cell", mixed(F.pmod(F.xxhash64("code", F.lit("salt")), F.col("pieces"))))
        found = settled(_met(few, many, percent, every=True), folder, "met")
        edges.append(found)
        left = _reached(left, found, folder)
        if left.isEmpty():
            break
    else:
        # what is not in the largest part meets the whole group, in blocks of sets of about one size
        rest = sets.drop("n").join(left.where("not main").select("code", "n"), "code")
        many = rest.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES)).cast("long").alias("dealt"))
        many = settled(many, folder, "dealt")
        block = F.pmod(F.xxhash64("code", F.lit("block")), F.col("dealt"))
        few = rest.join(many, "root").withColumn("cell", mixed(block))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("dealt") - 1))
        passing = sets.join(many, "root").withColumn("block", salts).withColumn("cell", mixed("block"))
        edges.append(settled(_met(few, passing, percent), folder, "met"))
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out


def candidate_sets(docs: DataFrame, members: DataFrame, folder: str, key: str, text: str, make) -> DataFrame:
    """What ``linked`` takes, for ``members`` (doc: ``row_key``, root, code); one text of each is read again. ``make`` gives a text's set."""
    # members have no size bound, so they are not broadcast, however few they look
    rows = docs.select(row_key(key, text).alias("doc"), F.col(quoted(text)).alias("text")).join(members.hint("merge"), "doc").dropDuplicates(["doc"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = [make(x) for x in texts(block)]
            columns = [pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(block.column, ("root", "code")), *columns], names=["root", "code", "n", "shingles"])

    return settled(rows.select("root", "code", "text").mapInArrow(read, "root long, code long, n long, shingles binary"), folder, "sets")
