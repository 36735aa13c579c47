"""Importance resampling towards a target corpus by hashed n-gram counts, with the hashes read from position tables.

The CRC-32 of a string is the exclusive or of one number for its length and one for each byte, which depends on the byte and its
distance from the end only. A block's normalised words lie in one byte array; for every n-gram length and phase the n-grams tile it, so that one
table lookup a byte and one ``bitwise_xor.reduceat`` over the tiles give all their CRCs. N-grams longer than the table are
cut into blocks from their end, which are reduced alike and folded by the number that as many zero bytes make of a register.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, extended, packed, quoted, row_key, texts
from inboxlake.sources.tables import settled

#: Buckets of features, words of the longest feature, words that a document needs to be drawn, and the percentage that is drawn.
BUCKETS, LONGEST, WORDS, PERCENT = 10_000, 3, 20, 5

#: Bytes that the position table reaches back from the end of a feature.
REACH = 64

#: The reflected polynomial of CRC-32 (fixed value).
_POLYNOMIAL = 0xEDB88320

#: A-Z become a-z, other bytes below 0x80 than digits and letters become spaces.
_WORD = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in range(256))


class Crc:
    """CRC-32 of many spans of one byte array."""

    def __init__(self, reach: int = REACH):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1)
        self.reach = reach
        #: row d: what a byte adds whose distance from the end of its span is d, the last byte's being 1; row 0 adds nothing
        self.table = np.zeros((reach + 1, 256), dtype=np.uint32)
        self.table[1] = step
        for d in range(2, reach + 1):
            self.table[d] = (self.table[d - 1] >> 8) ^ step[self.table[d - 1] & 0xFF]
        #: by byte of a register: what it becomes when ``reach`` zero bytes follow
        self.shift = np.zeros((4, 256), dtype=np.uint32)
        for k in range(4):
            x = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            for _ in range(reach):
                x = (x >> 8) ^ step[x & 0xFF]
            self.shift[k] = x
        self.flat, self.length = self.table.ravel(), np.zeros(0, dtype=np.uint32)

    def constants(self, n: np.ndarray) -> np.ndarray:
        """The CRC of as many zero bytes, which holds the start value and the last inversion."""
        most = int(n.max(initial=0))
        if most < 4096:
            if most >= len(self.length):
                self.length = np.array([zlib.crc32(bytes(k)) for k in range(most + 1)], dtype=np.uint32)
            return self.length[n]
        kinds, place = np.unique(n, return_inverse=True)
        out, crc, at = np.zeros(len(kinds), dtype=np.uint32), 0, 0
        for k, m in enumerate(kinds.tolist()):
            while at < m:  # a piece at a time, so that a very long span needs no buffer of its size
                piece = min(m - at, 1 << 20)
                crc, at = zlib.crc32(bytes(piece), crc), at + piece
            out[k] = crc
        return out[place]

    def tiles(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of spans that follow each other with one byte between: [start, end) each, the last byte of ``data`` after the last."""
        if not len(start):
            return np.zeros(0, dtype=np.uint32)
        n = end - start
        lo, hi = int(start[0]), int(end[-1]) + 1
        back = np.repeat(end.astype(np.int32), n + 1) - np.arange(lo, hi, dtype=np.int32)
        long = n > self.reach
        if long.any():
            np.minimum(back, self.reach, out=back)
        added = self.flat[(back << 8) + data[lo:hi]]
        out = np.bitwise_xor.reduceat(added, start - lo)
        if long.any():
            out[long] = self._folded(data, start[long], end[long])
        return out ^ self.constants(n)

    def _folded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bytes' part of spans longer than the table: blocks of ``reach`` bytes from the end, the first one shorter, folded from the left."""
        n, r = end - start, self.reach
        count = -(-n // r)
        order = np.argsort(-count, kind="stable")  # spans with most blocks first, so that those still folding are the first few
        start, end, count = start[order], end[order], count[order]
        acc = np.zeros(len(n), dtype=np.uint32)
        for k in range(int(count[0]) - 1, -1, -1):
            live = int(np.searchsorted(-count, -k, side="left"))
            to = end[:live] - k * r
            at = np.maximum(start[:live], to - r)
            size = to - at
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum())) + np.repeat(at - first, size)
            back = np.repeat(to, size) - place
            block = np.bitwise_xor.reduceat(self.flat[(back << 8) + data[place]], first)
            x = acc[:live]
            acc[:live] = block ^ self.shift[0][x & 0xFF] ^ self.shift[1][(x >> 8) & 0xFF] ^ self.shift[2][(x >> 16) & 0xFF] ^ self.shift[3][x >> 24]
        out = np.empty_like(acc)
        out[order] = acc
        return out


def features(crc: Crc, some: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole texts: the number of words of each, and of every feature its text's place and its bucket.

    Features are all runs of 1 to ``longest`` words of a text, joined by one space, repeats included.
    """
    data = np.frombuffer(b" ".join([*some, b""]).translate(_WORD), dtype=np.uint8)
    solid = data != 0x20
    before = np.concatenate([[False], solid[:-1]])
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in some]), np.flatnonzero(solid & ~before), side="right")
    data = data[solid | before]  # words with one space after each
    end = np.flatnonzero(data == 0x20)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    texts_, found = [], []
    for k in range(1, longest + 1):
        for phase in range(k):
            first = np.arange(phase, len(start) - k + 1, k)
            if not len(first):
                continue
            own = owner[first] == owner[first + k - 1]
            # tiles across two texts are dropped; as tiles they only take the place between others
            hashes = crc.tiles(data, start[first], end[first + k - 1])
            texts_.append(owner[first][own])
            found.append(hashes[own] % np.uint32(buckets))
    if not found:
        return np.zeros(len(some), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.bincount(owner, minlength=len(some)), np.concatenate(texts_), np.concatenate(found).astype(np.int64)


def bucket_counts(rows: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; those without any are absent. Each task hands on ``buckets`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = Crc(), np.zeros(buckets, dtype=np.int64)
        for block in blocks(batches):
            total += np.bincount(features(crc, texts(block), longest, buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = rows.select(F.col(quoted(text)).alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of every bucket's smoothed frequency in ``target`` to that in ``docs``, floored: ``buckets`` numbers on the driver."""
    own = bucket_counts(docs, text, longest, buckets).withColumnRenamed("n", "s")
    other = bucket_counts(target, target_text, longest, buckets).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left").join(other, "bucket", "left").fillna(0)
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    part = lambda c: F.col(c).cast("double")
    ratio = (part("t") + 1) * (part("all_s") + buckets) / ((part("s") + 1) * (part("all_t") + buckets))
    found = both.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["gain"].to_numpy()
    return out


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """One row per document: ``rest`` (a struct of its other columns), n_words, n_features and weight, the sum of its features' gains.

    A null, empty or wordless text has no features and the weight 0. Nothing is shuffled.
    """
    rows = packed(docs, text)
    schema = extended(rows.select("rest"), "n_words long, n_features long, weight long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc()
        for block in blocks(batches):
            words, owner, bucket = features(crc, texts(block), longest, len(gain))
            order = np.argsort(owner, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            ends = np.cumsum(np.bincount(owner, minlength=block.num_rows))
            many = np.diff(ends, prepend=0)
            weight = sums[ends] - sums[ends - many]
            yield pa.RecordBatch.from_arrays([block.column("rest"), *(pa.array(x.astype(np.int64)) for x in (words, many, weight))], names=schema.names)

    return rows.mapInArrow(run, schema)


def ranked(
    docs: DataFrame,
    target: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = WORDS,
    seed: int = 42,
) -> DataFrame:
    """One row per document: ``rest`` (a struct of its columns but the text), n_features, weight, score and rank (null: not drawn).

    Scores are weights plus Gumbel noise from a hash of the key, so that the highest are a sample without replacement in proportion to the
    exponentials of the weights. Of the N documents with at least ``least_words`` words the floor(percent * N / 100) highest are
    drawn, ties to the smaller key and null keys first. Rows that agree in key and score are ranked in any order.
    Texts may be null, empty or of any length; empty tables give no rows or weights against an empty target.

    The order is made by ranges of (score, key); rows that agree in both are spread over ranges by their place in the written table,
    and a row's rank is its place in its range plus the sizes of the ranges before, a list as long as there are tasks.
    """
    gain = gains(docs, target, text, target_text)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("rest")[key].cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = weighted(docs, gain, text).withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words)
    rows = settled(rows, folder, "weights")
    columns = ["rest", "n_features", "weight", "score"]
    fit = rows.where("fit").select(*columns, F.monotonically_increasing_id().alias("salt"))
    order = [F.col("score").desc(), F.col("rest")[key].asc_nulls_first(), F.col("salt")]
    fit = fit.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns, F.monotonically_increasing_id().alias("place"))
    fit = settled(fit, folder, "ordered").withColumn("range", F.shiftright("place", 33))
    sizes = fit.groupBy("range").count().toPandas().sort_values("range")
    drawn = percent * int(sizes["count"].sum()) // 100
    begin = [(int(r), int(b)) for r, b in zip(sizes["range"], sizes["count"].cumsum() - sizes["count"])]
    starts = docs.sparkSession.createDataFrame(begin, "range long, begin long")
    rank = F.col("begin") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = fit.join(F.broadcast(starts), "range").withColumn("rank", F.when(rank <= drawn, rank))
    return placed.select(*columns, "rank").union(rows.where("not fit").select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, folder: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that ``ranked`` draws, with all their columns as they came, in no order. Each row is drawn or not for itself, repeated ones too."""
    others = F.struct(F.lit(0), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    own = F.struct(others.alias("row"), row_key(key, text).alias("hash"))
    keyed = docs.select(own.alias("own"), F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    drawn = ranked(keyed, target, folder, "key", "text", **options).where("rank is not null").select("rest.own.row", "rest.own.hash")
    drawn = settled(drawn, folder, "drawn")
    bodies = docs.select(row_key(key, text).alias("hash"), F.col(quoted(text)).alias("text"))
    bodies = bodies.join(drawn.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
    columns = [F.col("text").alias(c) if c == text else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]
    return drawn.join(bodies, "hash").select(*columns)
