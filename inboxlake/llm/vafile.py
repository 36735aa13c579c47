"""Exact top-k inner products with a vector-approximation file.

The approximation of a vector is one small cell number per component. A first scan of the approximations alone gives
each query the kth best lower bound of a score; a second keeps the candidates whose upper bound reaches it. Exact vectors are
then read in the order of the bounds: first those that could be best, and of the others only those whose
bound still reaches the kth exact score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlake.llm.common import quoted
from inboxlake.sources.tables import settled

#: Bits of a cell number, and the queries and candidates of a block.
BITS, QUERY_BLOCK, CANDIDATE_BLOCK = 6, 1024, 4096


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): every vector with each component x as floor(``scale`` * x), x as double.

    Null vectors, vectors holding null, NaN or infinite components, null ids and empty vectors take no part.
    """
    x = F.col("x")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("x") > 0) & F.coalesce(sound, F.lit(False)))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def cells(whole: DataFrame, folder: str, bits: int = BITS) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The approximations (id, d, cell: binary), and for each dimension d of vectors the lower edge and width of cells.

    Cells have equal width between a component's least and greatest value, so their edges need one aggregation that
    returns a row for each component.
    """
    each = whole.select(F.size("v").alias("d"), F.posexplode("v").alias("k", "x"))
    found = each.groupBy("d", "k").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d", "k").toPandas()
    edges = {}
    for d, some in found.groupby("d"):
        low, high = ([int(x) for x in some[c]] for c in ("low", "high"))
        width = [max(1, -(-(b - a + 1) // (1 << bits))) for a, b in zip(low, high)]  # whole numbers of any size
        edges[int(d)] = (np.array(low, dtype=np.int64), np.array(width, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                low, width = edges[len(v)]
                # differences of any two longs, as unsigned numbers
                out.append(((np.array(v, dtype=np.int64).view(np.uint64) - low.view(np.uint64)) // width.view(np.uint64)).astype(np.uint8 if bits <= 8 else "<u2").tobytes())
            size = pa.array([len(v) for v in batch.column("v").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(out, pa.binary())], names=["id", "d", "cell"])

    return settled(whole.mapInArrow(run, "id long, d int, cell binary"), folder, "cells"), edges


def _blocks(rows: DataFrame, size: int, value: str, name: str) -> DataFrame:
    """Rows in blocks of about ``size`` of one dimension: (d, ``name``, ``name``_parts, ``name``_rows), one row a block.

    The list of block counts that is broadcast has one row for each length of vector.
    """
    parts = F.ceil(F.count("*") / size).cast("long")
    counts = rows.groupBy("d").agg(parts.alias("parts"))
    block = F.pmod(F.xxhash64("id", F.lit(name)), F.col("parts"))
    dealt = rows.join(F.broadcast(counts), "d").select("d", "parts", block.alias(name), F.struct("id", F.col(value).alias("value")).alias("row"))
    return dealt.groupBy("d", name).agg(F.first("parts").alias(name + "_parts"), F.collect_list("row").alias(name + "_rows"))


def _met(candidates: DataFrame, queries: DataFrame, together: int = 4) -> DataFrame:
    """Every block of queries beside every block of candidates of its dimension: blocks, not rows, are repeated.

    A join key is one block of queries and ``together`` blocks of candidates, so the pairs spread over many tasks.
    """
    n = queries.groupBy("d").agg(F.first("qb_parts").alias("qn"))
    c = candidates.join(F.broadcast(n), "d").select("d", "cb_rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qn") - 1)).alias("qb"), F.floor(F.col("cb") / together).alias("cs"))
    m = candidates.groupBy("d").agg(F.first("cb_parts").alias("cn"))
    q = queries.join(F.broadcast(m), "d").select("d", "qb", "qb_rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cn") - 1) / together))).alias("cs"))
    return c.join(q, ["d", "qb", "cs"]).select("d", "cb_rows", "qb_rows")


def top_k(vectors: DataFrame, queries: DataFrame, folder: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, bits: int = BITS) -> DataFrame:
    """The ``k`` candidates with the greatest inner product for each query: query_id, rank, vec_id, score (long).

    Queries and candidates are rows of integer vectors (see ``integers``); a query's own id is no candidate, ties go to the
    smaller id, fewer candidates give fewer rows, and vectors of another dimension are none. Of several rows with one id the
    least vector counts. Blocks of queries meet blocks of approximations; what a task emits is bounded by k for a query
    and block in the first scan. Exact, whatever the quality of the bounds, as long as products and sums fit a long; a score for which one does
    not is the sum in doubles, at most 2 ** 63 - 1 either way. Null, empty and non-finite vectors take no part, empty tables give no rows, and other columns are not read.
    """
    once = lambda rows: integers(rows, key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    whole = settled(once(vectors), folder, "vectors")
    asked = settled(once(queries).withColumn("d", F.size("v")), folder, "queries")
    approximate, edges = cells(whole, folder, bits)

    query_blocks = settled(_blocks(asked, QUERY_BLOCK, "v", "qb"), folder, "query-blocks")
    candidate_blocks = settled(_blocks(approximate, CANDIDATE_BLOCK, "cell", "cb"), folder, "candidate-blocks")
    pairs = _met(candidate_blocks, query_blocks)

    def bounds(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for d, cs, qs in zip(batch.column("d").to_pylist(), batch.column("cb_rows"), batch.column("qb_rows")):
            low, width = edges[d]
            ids = np.array([r["id"] for r in cs.as_py()], dtype=np.int64)
            cell = np.frombuffer(b"".join(r["value"] for r in cs.as_py()), dtype=np.uint8 if bits <= 8 else "<u2").reshape(-1, d)
            asked_ids = np.array([r["id"] for r in qs.as_py()], dtype=np.int64)
            q = np.array([r["value"] for r in qs.as_py()], dtype=np.float64)
            least = low + cell.astype(np.float64) * width
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            span = (width - 1).astype(np.float64)
            slack = 1e-12 * np.abs(q).sum(axis=1, keepdims=True) * (np.abs(least).max() + span.max())  # of rounding
            upper = q @ least.T + (up @ span)[:, None] + slack
            lower = q @ least.T + (down @ span)[:, None] - slack
            own = asked_ids[:, None] == ids[None, :]
            upper[own] = lower[own] = -np.inf
            yield asked_ids, ids, lower, upper

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_ids, ids, lower, _ in bounds(batch):
                n = min(k, len(ids))
                best = -np.partition(-lower, n - 1, axis=1)[:, :n]
                real = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked_ids, n)[real.ravel()]), pa.array(best[real])], names=["query_id", "low"])

    # the kth best lower bound: k lists for each query and block, merged on the map side by rank
    ranked = pairs.mapInArrow(lowest, "query_id long, low double")
    order = Window.partitionBy("query_id").orderBy(F.desc("low"))
    kth = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    least = kth.groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    least = settled(least.select("query_id", F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("least")), folder, "bounds")
    thresholds = asked.join(least, asked["id"] == least["query_id"], "left").select("id", "d", "v", "least")
    query_blocks = settled(_blocks(thresholds.select("id", "d", F.struct("v", "least").alias("v")), QUERY_BLOCK, "v", "qb"), folder, "query-blocks")
    pairs = _met(candidate_blocks, query_blocks)

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs = batch.column("qb_rows")
            plain = pa.array([[{"id": r["id"], "value": r["value"]["v"]} for r in x.as_py()] for x in qs])
            reach = [np.array([-np.inf if r["value"]["least"] is None else r["value"]["least"] for r in x.as_py()]) for x in qs]
            swapped = pa.RecordBatch.from_arrays([batch.column("d"), batch.column("cb_rows"), plain], names=["d", "cb_rows", "qb_rows"])
            for (asked_ids, ids, _, upper), floor in zip(bounds(swapped), reach):
                a, b = np.nonzero((upper >= floor[:, None]) & np.isfinite(upper))
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[a]), pa.array(ids[b]), pa.array(upper[a, b])], names=["query_id", "vec_id", "bound"])

    left = settled(pairs.mapInArrow(reaching, "query_id long, vec_id long, bound double"), folder, "survivors")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "vec_id")
    first = left.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= 2 * k).drop("r")

    def exact(some: DataFrame) -> DataFrame:
        c = whole.select(F.col("id").alias("vec_id"), F.col("v").alias("x"))
        q = asked.select(F.col("id").alias("query_id"), F.col("v").alias("y"))
        near = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, p: s + p)
        whole_ = F.aggregate(F.zip_with("x", "y", F.try_multiply), F.lit(0).cast("long"), F.try_add)
        most = F.lit((1 << 63) - 1)
        score = F.coalesce(whole_, F.when(near >= 2.0**63, most).when(near <= -(2.0**63), -most).otherwise(F.floor(near)))
        return some.join(c, "vec_id").join(q, "query_id").select("query_id", "vec_id", "bound", score.alias("score"))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    begun = settled(exact(first), folder, "first")
    sure = begun.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    rest = left.join(begun.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti").join(sure, "query_id", "left")
    rest = exact(rest.where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth"))
    out = begun.unionByName(rest).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
