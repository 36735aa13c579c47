"""Alignment of two tokenizers: which of their tokens overlap in the texts, how often in the whole corpus, and which are each other's most frequent.

Tasks encode texts with both tokenizers and buffer records (pair of ids, document). A full buffer is sorted and radix-partitioned by the
low bits of the second side's id into runs: frames of zstd, pairs in side-major order. Runs of a partition are merged through a heap of their
next frames, which counts each pair; as the pairs of a second-side id follow each other, its maximum is known as soon as the next
id begins. The counts then meet the runs again, one after the other, and what each document's links add is streamed back to it.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, extended, packed
from inboxlake.llm.memo import Memo, gathered
from inboxlake.llm.packing import Tokens, byte_letters
from inboxlake.llm.pieces import SPACE, Pieces
from inboxlake.sources.tables import settled

#: Links that a task buffers before it writes runs, pairs of a frame, partitions, and runs that one merge takes.
RECORDS, FRAME, PARTS, FAN_IN = 1 << 22, 8192, 64, 256

def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array(list(map(len, entries)), dtype=np.int64)
    return np.frombuffer(b"".join(entries), dtype=np.uint8), np.cumsum(size) - size, size


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64), np.array([len(x) // 4 for x in ids], dtype=np.int64)


class Linker:
    """Both tokenizers of one task, and what they make of parts of texts."""

    def __init__(self, byte_model: str, piece_model: str):
        self.a, self.b = Tokens(byte_model), Pieces(piece_model)
        letter = byte_letters()
        names = {i: x for x, i in self.a.model.get_vocab().items()}
        self.n_a, self.n_b = max(names) + 1, self.b.size
        self.a_bytes = _table([bytes(letter[c] for c in names[i]) if i in names and all(c in letter for c in names[i]) else b"" for i in range(self.n_a)])
        self.b_bytes = _table(self.b.bytes)
        self.digits = _table([str(i).encode() for i in range(max(self.n_a, self.n_b))])
        #: whether texts can be cut before line feeds for the second tokenizer too
        self.lines = "\n" not in self.b.char
        self.strings: list[bytes] = []
        self.memo = Memo(["<i8", "<i8"])

    def _made(self, parts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        ids, many_ids, bad = self.a.parts(parts)
        bad |= np.array([SPACE in p or p[:1] == " " or (not self.lines and "\n" in p) or not self.b.cuts for p in parts], dtype=bool)
        good = np.flatnonzero(~bad).tolist()
        spelled = [parts[i] if parts[i][0] == "\n" else " " + parts[i] for i in good]
        pieces = self.b.merged([x.replace(" ", SPACE) for x in spelled])
        first = gathered(ids, (np.cumsum(many_ids) - many_ids)[good], many_ids[good]).astype(np.int64), many_ids[good]
        counts, same, strings, pairs, many = self.linked([x.encode() for x in spelled], first, _joined(pieces))
        bad[[g for g, s in zip(good, same.tolist()) if not s]] = True  # the whole text will show that it differs
        four, size = np.zeros((len(parts), 4), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        four[good], size[good] = counts, many
        text = [b""] * len(parts)
        for i, s in zip(good, strings):
            text[i] = s
        del self.strings[self.memo.bad.n :]
        self.strings += text
        return [(pairs, size), (four.ravel(), np.full(len(parts), 4))], bad

    def linked(self, spelled: list[bytes], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of byte strings and their ids on both sides (all in a row, and how many each has): (n_a, n_b, n_groups, n_links) of each, whether both sides spell it, its groups as text with a
        ``;`` after each, all linked pairs (second id times ``n_a`` plus first id) in a row, and how many each has. Those that differ have nothing."""
        nothing = np.zeros((len(spelled), 4), dtype=np.int64)
        (ia, at_a), (ib, at_b) = a, b
        owner_a, owner_b = np.repeat(np.arange(len(at_a)), at_a), np.repeat(np.arange(len(at_b)), at_b)
        len_a, len_b = self.a_bytes[2][ia], self.b_bytes[2][ib]
        size = np.array(list(map(len, spelled)), dtype=np.int64)
        same = (np.bincount(owner_a, len_a, len(size)).astype(np.int64) == size) & (np.bincount(owner_b, len_b, len(size)).astype(np.int64) == size)
        if same.all():
            want = np.frombuffer(b"".join(spelled), dtype=np.uint8)
            wrong = np.zeros(len(want), dtype=bool)
            for table, i, n in ((self.a_bytes, ia, len_a), (self.b_bytes, ib, len_b)):
                wrong |= gathered(table[0], table[1][i], n) != want
            if wrong.any():
                same[np.repeat(np.arange(len(size)), size)[wrong]] = False
        if not same.all():  # go on with the others
            keep = np.flatnonzero(same)
            sides = [(ids[same[owner]], n[keep]) for ids, n, owner in ((ia, at_a, owner_a), (ib, at_b, owner_b))]
            counts, again, strings, pairs, many = self.linked([spelled[i] for i in keep.tolist()], *sides)
            nothing[keep] = counts
            same[keep] = again
            text, n = [b""] * len(spelled), np.zeros(len(spelled), dtype=np.int64)
            for i, s in zip(keep, strings):
                text[i] = s
            n[keep] = many
            return nothing, same, text, pairs, n
        if not len(ia):
            return nothing, same, [b""] * len(spelled), ia, nothing[:, 0]
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        # the tokens of the second side that overlap each of the first
        lo = np.searchsorted(end_b, end_a - len_a, side="right")
        hi = np.searchsorted(end_b, end_a, side="left")
        n = hi - lo + 1
        pairs = ib[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] * self.n_a + np.repeat(ia, n)
        cut_a, cut_b = end_b[hi] == end_a, np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        upto_a, upto_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        place_a = np.arange(len(ia)) + np.concatenate([[0], upto_b])[group_a]
        place_b = np.arange(len(ib)) + upto_a[group_b]
        ids, mark = np.zeros(len(ia) + len(ib), dtype=np.int64), np.zeros(len(ia) + len(ib), dtype=np.uint8)
        ids[place_a], ids[place_b] = ia, ib
        mark[place_a], mark[place_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
        length = self.digits[2][ids] + 1
        to = np.cumsum(length)
        text = np.zeros(int(to[-1]), dtype=np.uint8)
        own = np.ones(len(text), dtype=bool)
        own[to - 1] = False
        text[to - 1] = mark
        text[own] = gathered(self.digits[0], self.digits[1][ids], length - 1)
        last = np.cumsum(at_a + at_b)
        stop = np.where(last > 0, to[last - 1], 0).tolist()
        flat = text.tobytes()
        strings = [flat[x:y] for x, y in zip([0, *stop[:-1]], stop)]
        links = np.bincount(owner_a, n, len(size)).astype(np.int64)
        counts = np.stack([at_a, at_b, np.bincount(owner_a, cut_a, len(size)).astype(np.int64), links], axis=1)
        return counts, same, strings, pairs, links

    def whole(self, text: str) -> tuple[np.ndarray, bytes, np.ndarray]:
        """Counts, groups and pairs of one text in one go."""
        sides = (self.a.raw(" " + text), self.b.encode([text])[0])
        counts, _, strings, pairs, _ = self.linked([b" " + text.encode()], *((x.astype(np.int64), np.array([len(x)])) for x in sides))
        return counts[0], strings[0], pairs

    def of(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of texts: counts, groups as text, and all linked pairs with the places of their texts."""
        number, ends, bad = self.memo.numbered(texts, self._made)
        begin = np.concatenate([[0], ends[:-1]])
        four = self.memo.results(1, number).reshape(-1, 4)
        counts = np.add.reduceat(four, begin, axis=0)
        many = self.memo.sizes(0, number)
        owner = np.repeat(np.repeat(np.arange(len(ends)), ends - begin), many)
        pairs, text = self.memo.results(0, number), self.strings
        found, some = number.tolist(), []
        for lo, hi in zip(begin.tolist(), ends.tolist()):
            some.append(b"".join([text[i] for i in found[lo:hi]])[:-1])
        if bad.any():
            keep = ~bad[owner]
            more = [(pairs[keep], owner[keep])]
            for i in np.flatnonzero(bad).tolist():
                body = texts[i].as_py()
                counts[i], some[i], own = self.whole(body) if body else (0, b"", pairs[:0])
                some[i] = some[i].removesuffix(b";")
                more.append((own, np.full(len(own), i)))
            pairs, owner = (np.concatenate([x[k] for x in more]) for k in (0, 1))
        return counts, some, pairs, owner


@lru_cache(maxsize=2)
def linker_of(byte_model: str, piece_model: str) -> Linker:
    """Both tokenizers, kept by a Python worker from task to task."""
    return Linker(byte_model, piece_model)


# Runs. A frame is the first key, sizes and the compressed columns; numbers are stored by byte planes, differences where they ascend.


def _planes(x: np.ndarray) -> bytes:
    width = 4 if int(x.max(initial=0)) < 1 << 32 else 8
    return struct.pack("<BI", width, len(x)) + x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _columns(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width, n = struct.unpack_from("<BI", data, at)
        planes = np.frombuffer(data, dtype=np.uint8, count=width * n, offset=at + 5)
        out.append(np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64))
        at += 5 + width * n
    return out


def framed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """A run of ascending keys with further columns, as frames of ``FRAME`` keys."""
    out, press = [], zstandard.ZstdCompressor(level=1)
    for lo in range(0, len(keys), FRAME):
        part = keys[lo : lo + FRAME]
        data = press.compress(_planes(np.diff(part)) + b"".join(_planes(c[lo : lo + FRAME]) for c in columns))
        out.append(struct.pack("<qI", int(part[0]), len(data)) + data)
    return b"".join(out)


class Run:
    """The frames of a run, read one at a time."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def first(self) -> int | None:
        return struct.unpack_from("<q", self.data, self.at)[0] if self.at < len(self.data) else None

    def read(self) -> list[np.ndarray]:
        key, size = struct.unpack_from("<qI", self.data, self.at)
        self.at += 12
        steps, *rest = _columns(zstandard.ZstdDecompressor().decompress(self.data[self.at : self.at + size]))
        self.at += size
        return [key + np.concatenate([[0], np.cumsum(steps)]), *rest]

    def all(self) -> list[np.ndarray]:
        found = []
        while self.at < len(self.data):
            found.append(self.read())
        return [np.concatenate(x) for x in zip(*found)]


def merged(runs: list[bytes], side: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The keys of all runs in order, their counts added up, and whether each count is the highest of its ``key // side``.

    A heap holds the first key of every run's next frame. Frames are read in that order, and what lies below the second-side id of the least key that
    is still unread is complete.
    """
    open_ = [Run(x) for x in runs]
    heap = [(r.first(), k) for k, r in enumerate(open_) if r.first() is not None]
    heapq.heapify(heap)
    keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    held = []
    while heap:
        _, k = heap[0]
        held.append(open_[k].read()[:2])
        after = open_[k].first()
        if after is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (after, k))
        if heap and sum(len(x[0]) for x in held) < 16 * FRAME:
            continue
        keys, counts = np.concatenate([keys, *(x[0] for x in held)]), np.concatenate([counts, *(x[1] for x in held)])
        held = []
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[start], np.add.reduceat(counts, start)
        to = int(np.searchsorted(keys, heap[0][0] // side * side)) if heap else len(keys)
        if to:
            own = keys[:to] // side
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            most = np.repeat(np.maximum.reduceat(counts[:to], first), np.diff(np.append(first, to)))
            yield keys[:to], counts[:to], counts[:to] == most
            keys, counts = keys[to:], counts[to:]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def encoded(docs: DataFrame, byte_model: str, piece_model: str, folder: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Rows of two kinds in one written table: documents (doc, ``rest``, the four counts, groups), and runs (part, chunk, pairs, records).

    ``doc`` numbers documents; ``chunk`` is the number of a run's first document, from which its records count.
    """
    rows = packed(docs, text)
    schema = extended(rows.select("rest"), "doc long, n_a long, n_b long, n_groups long, n_links long, groups string, part int, chunk long, pairs binary, records binary")

    schema["rest"].nullable = True  # runs have none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker = linker_of(byte_model, piece_model)
        base = TaskContext.get().partitionId() << 40
        names = schema.names
        stride = -(-linker.n_b // PARTS) * linker.n_a  # keys of a partition
        chunk, seen, held, kept = base, base, [], 0
        kind = None

        def runs() -> pa.RecordBatch:
            # partitions by the low bits of the second id, then the second id, then the first, then the document
            pair, doc = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            second, first = np.divmod(pair, linker.n_a)
            key = second % PARTS * stride + second // PARTS * linker.n_a + first
            span = seen - chunk
            both, n = np.unique(key * span + doc, return_counts=True)  # below 2**63: span is at most the records and documents of one buffer
            key, doc = np.divmod(both, span)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            keys, total = key[start], np.add.reduceat(n, start)
            press, out = zstandard.ZstdCompressor(level=1), []
            cuts = np.searchsorted(keys, stride * np.arange(PARTS + 1))
            for p, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if lo == hi:
                    continue
                x, y = int(start[lo]), int(start[hi]) if hi < len(start) else len(key)
                step = np.diff(doc[x:y], prepend=0)
                step[start[lo:hi] - x] = doc[start[lo:hi]]
                records = press.compress(_planes(size[lo:hi]) + _planes(step) + _planes(n[x:y]))
                out.append((p, chunk, framed(keys[lo:hi], total[lo:hi]), records))
            columns = list(zip(*out))
            none = {n: pa.nulls(len(out), t) for n, t in zip(names, [kind, *[pa.int64()] * 5, pa.string()])}
            own = {"part": pa.array(columns[0], pa.int32()), "chunk": pa.array(columns[1], pa.int64()), "pairs": pa.array(columns[2], pa.binary()), "records": pa.array(columns[3], pa.binary())}
            return pa.RecordBatch.from_arrays([(none | own)[n] for n in names], names=names)

        for block in blocks(batches, limit=1 << 21):
            kind = block.schema.field("rest").type
            counts, groups, pairs, owner = linker.of(block.column("text"))
            n = block.num_rows
            strings = pa.array([sha256(x).hexdigest() if x else "" for x in groups] if digest else [x.decode() for x in groups], pa.string())
            own = {"rest": block.column("rest"), "doc": pa.array(np.arange(seen, seen + n)), "groups": strings}
            own |= {c: pa.array(counts[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            own |= {"part": pa.nulls(n, pa.int32()), "chunk": pa.nulls(n, pa.int64()), "pairs": pa.nulls(n, pa.binary()), "records": pa.nulls(n, pa.binary())}
            yield pa.RecordBatch.from_arrays([own[x] for x in names], names=names)
            if len(pairs):
                held.append((pairs, owner + (seen - chunk)))
            seen, kept = seen + n, kept + len(pairs)
            if kept >= RECORDS:
                yield runs()
                chunk, held, kept = seen, [], 0
        if held:
            yield runs()

    return settled(rows.mapInArrow(run, schema), folder, "encoded")


def _grouped(rows: DataFrame, n: int) -> DataFrame:
    """Runs dealt to groups of about ``FAN_IN`` by a hash of their chunk; ``n`` is the most that a partition has."""
    return rows.withColumn("bunch", F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-n // FAN_IN)))).cast("int"))


def counted(runs: DataFrame, side: int, folder: str) -> DataFrame:
    """(part, pairs): one run a partition with all its keys, their counts in the whole corpus and whether that is the highest of their second id."""
    runs = runs.select("part", "chunk", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done() -> pa.RecordBatch:
            frames = b"".join(framed(k, n, top.astype(np.int64)) for k, n, top in merged(held, side))
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([frames], pa.binary())], names=["part", "chunk", "pairs"])

        for r in _in_order(batches):
            if at is not None and at != (r["part"], r["bunch"]):
                yield done()
                held = []
            at = r["part"], r["bunch"]
            held.append(r["pairs"])
        if held:
            yield done()

    while True:
        n = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        dealt = _grouped(runs, n).select("part", "bunch", "pairs").repartition("part", "bunch").sortWithinPartitions("part", "bunch")
        runs = settled(dealt.mapInArrow(run, "part int, chunk long, pairs binary"), folder, "counts")
        if n <= FAN_IN:
            return runs.select("part", "pairs")


def contributions(runs: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(doc, n_best, count_sum), some rows for each document with links: what its records of a partition add.

    Every group of runs gets its partition's counts first, and then its runs one after the other.
    """
    own = _grouped(runs.select("part", "chunk", "pairs", "records"), n)
    bunches = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // FAN_IN)) - 1)))
    first = counts.select("part", F.lit(None).cast("long").alias("chunk"), "pairs", F.lit(None).cast("binary").alias("records"), bunches.alias("bunch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _in_order(batches):
            if r["chunk"] is None:
                keys, total, top = Run(r["pairs"]).all()
                continue
            at = np.searchsorted(keys, Run(r["pairs"]).all()[0])
            size, step, n = _columns(zstandard.ZstdDecompressor().decompress(r["records"]))
            start = np.cumsum(size) - size
            along = np.cumsum(step)
            doc = along - np.repeat(along[start] - step[start], size)
            at = np.repeat(at, size)
            order = np.argsort(doc, kind="stable")
            doc, at, n = doc[order], at[order], n[order]
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            sums = (np.add.reduceat(x, begin) for x in (n * top[at], n * total[at]))
            yield pa.RecordBatch.from_arrays([pa.array(r["chunk"] + doc[begin]), *map(pa.array, sums)], names=["doc", "n_best", "count_sum"])

    dealt = own.select(first.columns).union(first).repartition("part", "bunch").sortWithinPartitions("part", "bunch", F.col("chunk").asc_nulls_first())
    return dealt.mapInArrow(run, "doc long, n_best long, count_sum long")


def _sizes(byte_model: str, piece_model: str) -> tuple[int, int]:
    import sentencepiece

    return max(Tokens(byte_model).model.get_vocab().values()) + 1, sentencepiece.SentencePieceProcessor(model_file=piece_model).vocab_size()


def aligned(docs: DataFrame, byte_model: str, piece_model: str, folder: str, text: str = "text", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables. One row per document: ``rest`` (a struct of its other columns), n_a, n_b, n_groups, n_links, n_best, count_sum and groups,
    its groups of ids as text (``digest``: the SHA-256 of that, or '' without tokens). And one row per linked pair of ids: a, b, count, best.

    A text's tokens are those of a space and the text on the byte-level side (A) and of the text on the piece side (B), whose model adds the space.
    Tokens of both sides are linked if their bytes overlap; groups lie between places where tokens of both end. A pair's count is the number of its links in the corpus,
    ``n_best`` are a document's links whose count no other pair of their B id exceeds. Null and empty texts, and texts that one side does not spell, have zeros
    and no groups. Whole texts; repeated rows and null ids are documents like any other; an empty table gives two empty ones.
    Vocabulary files must be readable by every executor.

    A task holds one buffer of ``RECORDS`` links (or those of one block), a merge the frames of ``FAN_IN`` runs, and a partition's counts, which
    the two vocabularies bound, however often a pair occurs.
    """
    n_a, n_b = _sizes(byte_model, piece_model)
    rows = encoded(docs, byte_model, piece_model, folder, text, digest)
    runs = rows.where("part is not null").select("part", "chunk", "pairs", "records")
    n = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    counts = counted(runs, n_a, folder)
    added = contributions(runs, counts, n).groupBy("doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    documents = rows.where("part is null").join(added, "doc", "left").select("rest", "n_a", "n_b", "n_groups", "n_links", *sums, "groups")
    stride = -(-n_b // PARTS) * n_a

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _in_order(batches):
            run = Run(r["pairs"])
            while run.first() is not None:
                keys, total, top = run.read()
                second, first = np.divmod(keys - r["part"] * stride, n_a)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second * PARTS + r["part"]), pa.array(total), pa.array(top > 0)], names=["a", "b", "count", "best"])

    return documents, counts.mapInArrow(spelled, "a long, b long, count long, best boolean")
