"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by a Gray-order index.

Fingerprints are dealt to buckets by blocks of their bits, so that linked ones meet in a bucket; each task joins its
buckets with a ``GrayIndex`` and hands on one edge for each code that has a partner; components are found on Spark.
Where a Jaccard similarity is asked for, those components are only candidates: inside each, links are the pairs whose sets of
shingles, compared in full, are that similar, and the components are formed anew from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, components, extended, packed, quoted, row_key, texts
from inboxlake.llm.gray_index import GrayIndex
from inboxlake.llm.similar import candidate_sets, linked
from inboxlake.sources.tables import settled

#: Codes of a bucket that one task compares; a larger bucket is cut into pieces, and every two of them meet.
BUCKET = 50_000

#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16

#: Added to a hash before it is mixed into the next word of a long fingerprint.
_STEP = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves for word 0, an independent-looking permutation of them for the others."""
    if not k:
        return h
    x = h + np.uint64(k * _STEP & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 of a whole text's shingles, in order, ``SHINGLES`` at a time; none without words.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+, shingles of ``size`` words are joined by one space and a shorter
    text is one shingle.
    """
    found = text.lower().split()  # bytes: A-Z only
    if not found:
        return
    size = min(size, len(found))
    joined = b" ".join(found)
    length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(found) - size + 1].tolist()
    end = end[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(start), SHINGLES):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(start[lo : lo + SHINGLES], end[lo : lo + SHINGLES])], dtype=np.uint64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted XXH64 of a whole text's different shingles."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingles(text, size)]))


def _bits(parts: Iterable[np.ndarray], words: int) -> list[int]:
    sums = np.zeros((words, 64), dtype=np.int64)
    n = 0
    for h in parts:
        n += len(h)
        for k in range(words):
            bits = np.unpackbits(_mixed(h, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[k] += bits.sum(axis=0, dtype=np.int64)
    ones = 2 * sums > n
    return [sum(1 << i for i in np.flatnonzero(row).tolist()) for row in ones]


def fingerprint(text: bytes, size: int = 4, words: int = 1, seed: int = 42) -> list[int]:
    """The fingerprint of a whole text, ``words`` unsigned 64-bit words; zeros without words.

    Repeated shingles count. A bit is 1 if it is set in over half of the shingles' XXH64.
    """
    return _bits(shingles(text, size, seed), words)


def set_fingerprints(docs: DataFrame, key: str, text: str, size: int, words: int) -> DataFrame:
    """As ``fingerprints``, but of the sets of shingles, repeats counting once; also doc (``row_key``) and code (a hash of the set)."""
    rows = packed(docs, text).select("rest", "text", F.xxhash64(F.col("rest")[key], F.col("text")).alias("doc"))
    names = [f"w{k}" for k in range(words)]
    schema = extended(rows.select("rest", "doc"), ", ".join(f"{c} long" for c in ("code", *names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = []
            for x in texts(block):
                h = shingle_set(x, size)
                found.append([xxhash.xxh64_intdigest(h.tobytes()), *_bits((h[lo : lo + SHINGLES] for lo in range(0, len(h), SHINGLES)), words)])
            columns = np.array(found, dtype=np.uint64).view(np.int64).T
            yield pa.RecordBatch.from_arrays([block.column("rest"), block.column("doc"), *map(pa.array, columns)], names=["rest", "doc", "code", *names])

    return rows.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4, words: int = 1) -> DataFrame:
    """One row per document: ``rest`` (a struct of its other columns) and w0, w1, ... (the words, as signed longs).

    A null text counts as empty.
    """
    rows = packed(docs, text).select("rest", "text")
    schema = extended(rows.select("rest"), ", ".join(f"w{k} long" for k in range(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = np.array([fingerprint(x, size, words) for x in texts(block)], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("rest"), *map(pa.array, found.T)], names=["rest", *(f"w{k}" for k in range(words))])

    return rows.mapInArrow(run, schema)


def _masks(words: int, blocks_: int, picked: int, step: int = 1) -> list[list[int]]:
    """Masks, a list of words each, that cut the bits, ``step`` (odd) apart, into equal blocks and pick every ``picked`` of them."""
    bounds = [64 * words * k // blocks_ for k in range(blocks_ + 1)]
    block = [sum(1 << i * step % (64 * words) for i in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    joined = [sum(block[i] for i in some) for some in combinations(range(blocks_), picked)]
    return [[(m >> 64 * k) & (1 << 64) - 1 for k in range(words)] for m in joined]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Steps between the bits of a band, one cut of the bits into bands for each; bands of different cuts share a bit or two at most.
STEPS = (1, 37, 101, 59)


def bucket_masks(words: int, radius: int, codes: int, bands: int | None = None, cuts: int = 1) -> list[list[int]]:
    """Which bits make the bucket keys.

    Without ``bands`` the bits are cut into radius + c blocks and every c of them are a key: codes within the radius
    differ in at most ``radius`` blocks, so they agree in c others and no link is lost. c is the least for which random
    codes leave buckets of some thousands. With ``bands`` the bits are cut into that many blocks, each a key; if there are not more of them
    than ``radius``, a link is found only if one of its blocks agrees; ``cuts`` of the bits in other orders add as many blocks each.
    """
    if bands:
        return [m for step in STEPS[:cuts] for m in _masks(words, bands, 1, step)]
    c = 1
    while c < 3 and codes >> (64 * words * c // (radius + c)) > 4096:
        c += 1
    return _masks(words, radius + c, c)


def links(codes: DataFrame, words: int, radius: int, folder: str, bands: int | None = None, cuts: int = 1) -> DataFrame:
    """Edges (a, b) between codes (code: long, w0, ...) that connect every two within ``radius``; see ``bucket_masks``.

    An edge for each code and bucket at most, not one for each pair.
    """
    masks = bucket_masks(words, radius, codes.count(), bands, cuts)
    names = [f"w{k}" for k in range(words)]
    keys = [F.xxhash64(F.lit(i), *[F.col(w).bitwiseAND(F.lit(_signed(m))) for w, m in zip(names, mask)]) for i, mask in enumerate(masks)]
    rows = codes.select("code", *names, F.explode(F.array(*keys)).alias("key"))
    hot = settled(rows.groupBy("key").count().where(F.col("count") > BUCKET), folder, "hot-buckets")
    if not hot.isEmpty():
        pieces = F.ceil(F.col("count") / BUCKET).cast("long")
        own = F.pmod(F.xxhash64("code"), pieces)
        other = F.explode(F.when(F.col("count").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), pieces - 1)))
        cut = rows.join(hot, "key", "left").select("*", own.alias("own"), other.alias("other"))
        cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = cut.select("code", *names, F.when(F.col("other").isNull(), F.col("key")).otherwise(cell).alias("key"))

    def joined(batch: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batch)
        code = table.column("code").to_numpy()
        bits = np.stack([table.column(w).to_numpy() for w in names], axis=1).view(np.uint64)
        root = GrayIndex(np.ascontiguousarray(bits), table.column("key").to_numpy()).components(radius)
        apart = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(code[apart]), pa.array(code[root[apart]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole buckets, as rows come sorted by key, and the beginning of the last one
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < BUCKET:
                continue
            key = np.concatenate([x.column("key").to_numpy() for x in held])
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                whole = pa.Table.from_batches(held)
                yield joined(whole.slice(0, cut).to_batches())
                held = whole.slice(cut).to_batches()
        if held:
            yield joined(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    size: int = 4,
    words: int = 1,
    radius: int = 4,
    bands: int | None = None,
    cuts: int = 1,
    jaccard: float | None = None,
) -> DataFrame:
    """One row per document: ``rest`` (its columns but the text), w0, ... and component, the smallest key reachable.

    Documents link if their fingerprints differ in ``radius`` bits or fewer. Equal fingerprints are one node, however many
    documents have them; nulls among the keys never are the smallest, and a component of null keys only is null. Empty
    texts have the fingerprint zero and link like any other. Repeated rows stay.

    With ``jaccard`` fingerprints are those of the sets of shingles, equal sets (by a 64-bit hash) are one node, and the components of fingerprints are
    only candidates: in each, two sets link at a Jaccard similarity (of sets of 64-bit hashes) of ``jaccard``, a whole percentage, or more, see ``similar.linked``.
    """
    names = [f"w{k}" for k in range(words)]
    least = F.min(F.col("rest")[key]).alias("least")
    if jaccard is None:
        prints = settled(fingerprints(docs, text, size, words), folder, "fingerprints")
        prints = prints.withColumn("code", F.col("w0") if words == 1 else F.xxhash64(*names))
        codes = settled(prints.groupBy("code", *names).agg(least), folder, "codes")
    else:
        prints = settled(set_fingerprints(docs, key, text, size, words), folder, "fingerprints")
        codes = settled(prints.groupBy("code", *names).agg(least, F.min("doc").alias("doc")), folder, "codes")
    roots = components(links(codes, words, radius, folder, bands, cuts), folder)
    if jaccard is not None:
        members = settled(codes.join(roots, codes["code"] == roots["node"]).select("doc", "root", "code"), folder, "members")
        sets = candidate_sets(docs, members, folder, key, text, lambda x: shingle_set(x, size))
        roots = components(linked(sets, folder, round(100 * jaccard)), folder)
    placed = codes.select("code", "least").join(roots, codes["code"] == roots["node"], "left")
    placed = settled(placed.select("code", "least", F.coalesce("root", "code").alias("root")), folder, "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = settled(placed.join(smallest, "root").select("code", "component"), folder, "components")
    return prints.join(named, "code").select("rest", *names, "component")


def fingerprint_text(words: int = 1) -> Column:
    """The fingerprint as lowercase hex digits, 16 for each word."""
    return F.concat(*[F.lpad(F.lower(F.hex(f"w{k}")), 16, "0") for k in range(words)])


#: The wide form for word shingles: candidates by 256 bits, wide enough for nearly all pairs at 0.8 (see ``keep_one``), then the similarity itself.
WIDE = {"size": 5, "words": 4, "radius": 68, "bands": 22, "cuts": 4, "jaccard": 0.8}


def keep_one(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of each group of near-duplicates (``WIDE``), with all its columns as they came.

    Texts link at a Jaccard similarity J of 0.8 or more of their sets of five-word shingles; no pair below links. Candidates for that come
    from SimHash: bits of sets of equal size differ with the chance acos(2J / (1 + J)) / pi, fewer for other sizes: 39 of 256 at J = 0.8
    and 48 in sets of only four or five shingles, 128 for unrelated ones. Of 200,000
    draws of such differing bits at J = 0.8, 99.99 % were within the radius and agreed in one of the 88 bands; of small sets 99.7 %. A null key is the smallest; of several rows
    with one key that with the smallest hash of key and text stays, and one of rows that agree in both.
    """
    own = F.struct(F.col(quoted(key)).alias("key"), row_key(key, text).alias("hash"))
    keyed = docs.select(own.alias("own"), F.col(quoted(text)).alias("text"))
    groups = near_duplicates(keyed, folder, "own", "text", **WIDE)
    chosen = settled(groups.select(F.col("component.hash").alias("hash")).distinct(), folder, "chosen")
    rows = docs.select(row_key(key, text).alias("hash"), F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("row"))
    # the join leaves rows dealt and sorted by the hash, as the removal of repeats needs them
    return rows.join(chosen, "hash", "left_semi").dropDuplicates(["hash"]).select("row.*")
