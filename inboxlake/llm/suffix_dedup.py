"""Removal of byte strings that start twice or more in a corpus, by suffix arrays of shards.

Sharding is by content, so that equal strings meet. Every window of ``size`` bytes is known by the least hash of the ``GRAM``-byte
grams in it; a run of neighbouring windows with one least hash is one string, and the hash says which shard it goes to. Runs
whose hash has one gram in the corpus hold nothing that repeats and go no further. Runs that occur whole twice are settled by counting. What is
left are different runs with one least hash: their strings are sorted by a suffix array for each shard (Larsson-Sadakane), windows
that repeat are read from its common prefixes (Kasai). A hash with too many strings for one shard is cut by a second hash, and
what is still too large into pieces with a suffix array each, which are merged by binary search, every two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, extended, packed, quoted, row_key, unpacked
from inboxlake.llm.suffix_array import Suffixes, repeated
from inboxlake.sources.tables import settled

#: Bytes of a string that counts as repeated, and of a gram. GRAM is a power of two.
SIZE, GRAM = 200, 32

#: Bytes of strings in a shard, and bytes of text that a task scans at once.
SHARD_BYTES, SCAN_BYTES = 1 << 19, 1 << 19

_B = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_B), -1, 1 << 64))
_OF_BYTE = np.random.default_rng(11).integers(1, 1 << 63, size=(3, 256), dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of the gram at every place of ``text`` that has one."""
    h, step, power = _OF_BYTE[seed][text], 1, int(_B)
    while step < GRAM:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = 2 * step, power * power % (1 << 64)
    return _mixed(h)


def _sliding(take, x: np.ndarray, wide: int) -> np.ndarray:
    """The least or greatest of every ``wide`` neighbours."""
    reach = 1
    while 2 * reach <= wide:
        x = take(x[:-reach], x[reach:])
        reach *= 2
    return x if reach == wide else take(x[: len(x) - (wide - reach)], x[wide - reach :])


def runs(texts: list[bytes], size: int = SIZE, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of windows with one least hash, of texts of ``size`` bytes or more: text number, first window, windows,
    least hash, a hash of the run's bytes, and whether two grams of the run have the least hash."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    length = np.array([len(x) for x in texts], dtype=np.int64)
    start = np.cumsum(length) - length
    windows = length - size + 1
    grams, wide = gram_hashes(data, seed), size - GRAM + 1
    every = _sliding(np.minimum, grams, wide)
    at = np.arange(windows.sum()) + np.repeat(start - (np.cumsum(windows) - windows), windows)
    least, number = every[at], np.repeat(np.arange(len(texts)), windows)
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (number[1:] != number[:-1])]))
    many = np.diff(np.append(first, len(at)))
    a, number = at[first], number[first]
    b = a + many + size - 1
    # grams that are the least of a window: those equal to the greatest of the minima around them
    edge = np.zeros(wide - 1, dtype=np.uint64)
    marks = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, every, edge]), wide) == grams)
    lo, hi = np.searchsorted(marks, a), np.searchsorted(marks, b - GRAM, side="right")
    each = np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
    run = np.repeat(np.arange(len(a)), hi - lo)
    twice = np.bincount(run, grams[marks[each]] == least[first][run], len(a)) > 1
    # sum of byte_j * B^j over the run, moved to the text's beginning
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), _B)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), _BACK)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_OF_BYTE[2][data] * power[:-1], dtype=np.uint64)])
    whole = _mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
    return number, a - start[number], many, least[first].view(np.int64), whole.view(np.int64), twice


def _parts(texts: list[tuple[int, bytes]], size: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts of ``size`` bytes or more in lots of about ``SCAN_BYTES``: keys, first bytes and parts. A longer text comes in parts
    that overlap, so that each of its windows is in one of them."""
    keys, firsts, parts, held = [], [], [], 0
    for key, text in texts:
        for first in range(0, len(text) - size + 1, SCAN_BYTES):
            part = text[first : first + SCAN_BYTES + size - 1]
            keys.append(key)
            firsts.append(first)
            parts.append(part)
            held += len(part)
            if held >= SCAN_BYTES:
                yield keys, firsts, parts
                keys, firsts, parts, held = [], [], [], 0
    if parts:
        yield keys, firsts, parts


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = zip(block.column("key").to_pylist(), block.column("text").cast(pa.binary()).to_pylist())
            for keys, firsts, parts in _parts([(k, x) for k, x in texts if x is not None], size):
                number, start, many, least, whole, twice = runs(parts, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, dtype=np.int64)[number]), pa.array(np.array(firsts, dtype=np.int64)[number] + start), pa.array(many), pa.array(least), pa.array(whole), pa.array(twice)],
                    names=["key", "start", "n", "least", "whole", "twice"],
                )

    return run


def _strings(size: int):
    """The bytes of the runs that are asked for; those of a hot least hash are cut by a second one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out: dict[str, list] = {name: [] for name in ("least", "key", "start", "alone", "string")}

            def add(least, key, start, alone, string) -> None:
                for column, value in zip(out.values(), (least, key, start, alone, string)):
                    column.append(value)

            for key, text, asked in zip(block.column("key").to_pylist(), block.column("text").cast(pa.binary()).to_pylist(), block.column("asked").to_pylist()):
                hot = [r for r in asked if r["hot"]]
                for r in asked:
                    if not r["hot"]:
                        add(r["least"], key, r["start"], r["alone"], text[r["start"] : r["start"] + r["n"] + size - 1])
                if hot:
                    number, start, many, least, _, _ = runs([text[r["start"] : r["start"] + r["n"] + size - 1] for r in hot], size, seed=1)
                    for i, a, n, second in zip(number.tolist(), start.tolist(), many.tolist(), least.tolist()):
                        r = hot[i]
                        both = (r["least"] * 0x9E3779B97F4A7C15 + second + (1 << 63)) % (1 << 64) - (1 << 63)
                        at = r["start"] + a
                        add(both, key, at, r["alone"], text[at : at + n + size - 1])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], names=list(out))

    return run


def _shard(size: int):
    """Runs of windows, of strings that occur once, that also begin elsewhere in the shard, or in its other piece."""

    def flagged(suffixes: Suffixes, places: np.ndarray, rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(places):
            return []
        places = np.sort(places)
        number = np.searchsorted(suffixes.start, places, side="right") - 1
        keep = rows.column("alone").to_numpy(zero_copy_only=False)[number]
        places, number = places[keep], number[keep]
        first = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1] + 1) | (number[1:] != number[:-1])])) if len(places) else places
        many = np.diff(np.append(first, len(places)))
        number, at = number[first], places[first]
        return [(rows.column("key").to_numpy()[number], rows.column("start").to_numpy()[number] + at - suffixes.start[number], many)]

    def run(group: pa.Table) -> pa.Table:
        pieces = [group.filter(pa.compute.equal(group.column("piece"), p)) for p in pa.compute.unique(group.column("piece")).to_pylist()]
        built = [(Suffixes(rows.column("string").to_pylist()), rows) for rows in pieces]
        own = pa.compute.any(group.column("own")).as_py()
        found = []
        if own:
            for suffixes, rows in built:
                found += flagged(suffixes, repeated(suffixes, size), rows)
        elif len(built) == 2:
            (one, one_rows), (two, two_rows) = built
            a, b = one.found(two, size)
            found += flagged(one, a, one_rows) + flagged(two, b, two_rows)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["key", "start", "n"])

    return run


def repeats(texts: DataFrame, folder: str, size: int = SIZE) -> DataFrame:
    """(key, start, n): runs of windows of ``size`` bytes, n from byte ``start`` on, that begin at another place of the corpus too.

    ``texts`` has key (a 64-bit key of a row, equal only for rows that are equal) and text. Null texts and texts of fewer than ``size`` bytes have
    none. Overlaps and places in the same text count.
    """
    texts = texts.where(F.octet_length("text") >= size)
    found = texts.mapInArrow(_scan(size), "key long, start long, n long, least long, whole long, twice boolean")
    by_least, by_whole = Window.partitionBy("least"), Window.partitionBy("least", "whole")
    counted = (
        found.repartition("least")
        .withColumn("copies", F.count("*").over(by_whole))
        .withColumn("first", F.min(F.struct("key", "start")).over(by_whole))
        .withColumn("total", F.count("*").over(by_least))
        .withColumn("fewest", F.min("copies").over(by_least))
        .where("total > 1 or twice")
    )
    # strings that a shard must see: one of each, if one of their hash is settled neither by its copies nor by being alone
    other = (F.col("total") > F.col("copies")) & (F.col("fewest") == 1)
    asked = (other | (F.col("twice") & (F.col("copies") == 1))) & (F.col("first") == F.struct("key", "start"))
    counted = settled(counted.select("key", "start", "n", "least", "copies", asked.alias("asked")), folder, "runs")

    asked = counted.where("asked").dropDuplicates(["key", "start"])
    length = F.col("n") + (size - 1)
    hot = settled(asked.groupBy("least").agg(F.sum(length).alias("bytes")).where(F.col("bytes") > SHARD_BYTES // 4).select("least", F.lit(True).alias("hot")), folder, "hot")
    marked = asked.join(hot, "least", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = marked.groupBy("key").agg(F.collect_list(F.struct("start", "n", "least", (F.col("copies") == 1).alias("alone"), "hot")).alias("asked"))
    # rows that repeat share a key: one of them is read, and their runs are handed on once
    strings = settled(texts.join(wanted, "key").dropDuplicates(["key"]).mapInArrow(_strings(size), "least long, key long, start long, alone boolean, string binary"), folder, "strings")

    total = strings.agg(F.coalesce(F.sum(F.length("string")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    large = settled(
        strings.groupBy("least").agg(F.ceil(F.sum(F.length("string")) / SHARD_BYTES).cast("long").alias("pieces")).where(F.col("pieces") > 1), folder, "large"
    )
    strings = strings.join(large, "least", "left")
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", "start"), F.col("pieces"))).cast("long")
    strings = strings.withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)))
    ordinary = F.pmod(F.xxhash64("least"), F.lit(shards))
    cell = F.xxhash64("least", F.least("piece", "other"), F.greatest("piece", "other")).bitwiseOR(F.lit(-(1 << 63)))
    strings = strings.withColumn("shard", F.when(F.col("pieces").isNull(), ordinary).otherwise(cell)).withColumn("own", F.col("piece") == F.col("other"))
    strings = strings.select("shard", "own", "piece", "key", "start", "alone", "string").dropDuplicates(["shard", "key", "start"])
    inside = strings.groupBy("shard").applyInArrow(_shard(size), "key long, start long, n long")
    return counted.where("copies > 1").select("key", "start", "n").distinct().unionByName(inside)


def _left(block: pa.RecordBatch, size: int) -> Iterator[tuple[bytes | None, list[dict], bytes]]:
    """Of each text of a block: its bytes, the spans that go and the bytes that stay."""
    for text, first, many in zip(block.column("text").cast(pa.binary()).to_pylist(), block.column("starts").to_pylist(), block.column("ns").to_pylist()):
        whole = text or b""
        mine: list[dict] = []
        for a, n in sorted(zip(first or (), many or ())):
            b = a + n + size - 1
            if mine and a <= mine[-1]["end"]:
                mine[-1]["end"] = max(mine[-1]["end"], b)
            else:
                mine.append({"start": a, "end": b})
        edges = [0, *(x for s in mine for x in (s["start"], s["end"])), len(whole)]
        yield text, mine, b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for block in blocks(batches):
            sizes, spans, kept = [], [], []
            for text, mine, left in _left(block, size):
                sizes.append(len(text or b""))
                spans.append(mine)
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [block.column("rest"), block.column("text"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["rest", "text", "n_bytes", "spans", "kept"],
            )

    return run


def _readable(size: int):
    """What stays as text, without bytes that are no UTF-8; texts without spans as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            kept = [left.decode("utf-8", "ignore").encode() if mine else text for text, mine, left in _left(block, size)]
            # a view, as a text that came with bytes that are no UTF-8 stays so
            yield pa.RecordBatch.from_arrays([block.column("rest"), pa.array(kept, pa.binary()).view(pa.string())], names=["rest", "text"])

    return run


def _with_repeats(docs: DataFrame, folder: str, key: str, text: str, size: int) -> DataFrame:
    """One row per document: ``rest``, text, starts and ns of its runs of windows that repeat (null: none)."""
    texts = docs.select(row_key(key, text).alias("key"), F.col(quoted(text)).alias("text"))
    found = repeats(texts, folder, size)
    spans = settled(found.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")), folder, "spans")
    rows = packed(docs, text)
    keyed = rows.withColumn("key", F.xxhash64(F.col("rest")[key], F.col("text")))
    short = F.coalesce(F.octet_length("text") < size, F.lit(True))
    none = F.lit(None).cast("array<bigint>")
    joined = keyed.where(~short).join(spans, "key", "left").select("rest", "text", "starts", "ns")
    return joined.union(rows.where(short).select("rest", "text", none, none))


def cut_repeats(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: ``rest`` (its other columns), text, n_bytes, spans (start, end in bytes, maximal) and kept (binary).

    Every byte goes that is covered by a string of ``size`` bytes that starts anywhere else in the corpus too, in the same text
    included; all copies go, none stays. A null text counts as empty; texts of fewer bytes stay whole; repeated rows
    are copies of each other; null ids are ids.
    """
    rows = _with_repeats(docs, folder, key, text, size)
    out = extended(rows.select("rest", "text"), "n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return rows.mapInArrow(_cut(size), out)


def without_repeats(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The documents with their repeated strings cut out; bytes of a character that was cut in two go too.

    One Python operator cuts and decodes: a second one after it would start a second worker for every task, and idle workers
    take turns in later stages, each with a memory of its own.
    """
    rows = _with_repeats(docs, folder, key, text, size)
    return unpacked(rows.mapInArrow(_readable(size), rows.select("rest", "text").schema), docs.columns, text)
