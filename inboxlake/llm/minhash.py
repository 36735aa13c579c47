"""MinHash near-duplicates by tensored banding.

Two small collections of minhashes are computed, each of ``HALVES`` bands of ``ROWS`` rows. A table's key combines a band of the first collection
with one of the second, so 2 * HALVES bands give HALVES ** 2 tables, and the minhashes are about the square root of what as many separate
tables would need. A key is made only of bands that another set has too, so a text without near copies makes none. Sets that meet in a table are
candidates, which are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlake.llm.common import blocks, components, extended, packed, texts
from inboxlake.llm.similar import candidate_sets, linked
from inboxlake.llm.simhash import shingle_set
from inboxlake.sources.tables import settled

#: Bands of one collection, and minhashes of a band.
HALVES, ROWS = 12, 2

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def seeds(count: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(k).encode(), 7) for k in range(count)], dtype=np.uint64)


def bands(sets: list[np.ndarray], halves: int = HALVES, rows: int = ROWS) -> np.ndarray:
    """The bands of both collections, one row a set; sets must not be empty."""
    flat = np.concatenate(sets)
    many = np.array(list(map(len, sets)))
    start = np.cumsum(many) - many
    out = np.zeros((len(sets), 2 * halves), dtype=np.uint64)
    for k, seed in enumerate(seeds(2 * halves * rows)):
        x = (flat ^ seed) * _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX
        least = np.minimum.reduceat(x, start)
        band = k // rows
        out[:, band] = (out[:, band] ^ least) * _MIX + np.uint64(band)
        out[:, band] ^= out[:, band] >> np.uint64(29)
    return out


def signed_sets(docs: DataFrame, key: str, text: str, size: int, halves: int, rows: int) -> DataFrame:
    """``rest``, doc (``row_key``), n (of different shingles), code (a hash of the set) and bands; code and bands are null for an empty set."""
    given = packed(docs, text).select("rest", "text", F.xxhash64(F.col("rest")[key], F.col("text")).alias("doc"))
    schema = extended(given.select("rest", "doc"), "n long, code long, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = [shingle_set(x, size) for x in texts(block)]
            full = [x for x in found if len(x)]
            code = iter(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in full], dtype=np.uint64).view(np.int64).tolist())
            band = iter(bands(full, halves, rows).view(np.int64).tolist() if full else [])
            columns = [
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([next(code) if len(x) else None for x in found], pa.int64()),
                pa.array([next(band) if len(x) else None for x in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([block.column("rest"), block.column("doc"), *columns], names=["rest", "doc", "n", "code", "bands"])

    return given.mapInArrow(run, schema)


def candidates(codes: DataFrame, folder: str, halves: int = HALVES) -> DataFrame:
    """(node, root): the components of sets (code, bands) that meet in a table; sets that meet none are absent.

    A table's edges go to its least code, not between all pairs.
    """
    half = codes.select("code", F.posexplode("bands").alias("i", "band"))
    shared = half.groupBy("i", "band").count().where("count > 1").drop("count")
    kept = half.join(shared.hint("merge"), ["i", "band"]).groupBy("code").agg(F.collect_list(F.struct("i", "band")).alias("all"))  # 2 * halves at most
    first, second = F.filter("all", lambda x: x["i"] < halves), F.filter("all", lambda x: x["i"] >= halves)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["i"], x["band"], y["i"], y["band"]))))
    tables = settled(kept.select("code", F.explode(keys).alias("key")), folder, "tables")
    least = tables.groupBy("key").agg(F.min("code").alias("least"), F.count("*").alias("many")).where("many > 1").select("key", "least")
    edges = tables.join(least.hint("merge"), "key").where("code <> least").select(F.col("code").alias("a"), F.col("least").alias("b"))
    return components(edges, folder)


def near_duplicates(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    size: int = 4,
    percent: int = 80,
    halves: int = HALVES,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``rest`` (its columns but the text), n (shingles of its set) and component, the smallest key reachable.

    A document's set holds the different shingles of ``size`` words of its whole text, lower-cased A-Z; a shorter text is one shingle, a null, empty or wordless one
    has an empty set and is alone. Documents link if 100 times what their sets share is ``percent`` times their union or more, by full sets (of 64-bit
    hashes). Equal sets are one node, however many documents have them. Null keys are never the smallest; a component of null keys
    only is null. Repeated rows stay; an empty table gives no rows.

    At a similarity J two sets miss all tables with the chance 2 * (1 - J ** rows) ** halves at most: 1 in 100,000 at J = 0.8, 1 in 10 million at J = 0.87.
    """
    prints = settled(signed_sets(docs, key, text, size, halves, rows), folder, "prints")
    full = prints.where("code is not null")
    # the bands of equal sets are equal
    codes = full.groupBy("code").agg(F.min(F.col("rest")[key]).alias("least"), F.min("doc").alias("doc"), F.any_value("bands").alias("bands"))
    codes = settled(codes, folder, "codes")
    roots = candidates(codes.select("code", "bands"), folder, halves)
    members = settled(codes.select("doc", "code").join(roots, F.col("code") == F.col("node")).select("doc", "root", "code"), folder, "members")
    found = components(linked(candidate_sets(docs, members, folder, key, text, lambda x: shingle_set(x, size)), folder, percent), folder)
    placed = codes.select("code", "least").join(found, F.col("code") == F.col("node"), "left")
    placed = settled(placed.select("code", "least", F.coalesce("root", "code").alias("root")), folder, "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = settled(placed.join(smallest, "root").select("code", "component"), folder, "components")
    together = full.join(named, "code").select("rest", "n", "component")
    alone = prints.where("code is null").select("rest", "n", F.col("rest")[key].alias("component"))
    return together.union(alone)
