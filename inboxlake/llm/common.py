"""What several operators share: bounded blocks of texts, whole rows carried along, label samples, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inboxlake.sources.tables import settled

#: Bytes that separate words, as in the pattern [^\x20\x09-\x0D]+; bytes.split() cuts at the same six.
SPACES = b" \t\n\x0b\x0c\r"

#: Bytes of text that a Python task holds in one block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: Bytes of an Arrow batch between Spark and a Python task.
BATCH_BYTES = "8m"


def bounded(spark: SparkSession) -> None:
    """Small Arrow batches for this session, so that a Python task holds a few of ``BATCH_BYTES`` whatever the rows' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in blocks of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``text`` and all other columns as one struct ``rest``, so that no name can clash with an operator's own."""
    others = [F.col(quoted(c)).alias(c) for c in rows.columns if c != text]
    filler = "_" * (1 + max(map(len, rows.columns)))  # a struct needs a field
    return rows.select(F.struct(F.lit(0).alias(filler), *others).alias("rest"), F.col(quoted(text)).alias("text"))


def unpacked(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns that ``packed`` took in, in their order."""
    return rows.select(*[F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in columns])


def extended(rows: DataFrame, fields: str) -> StructType:
    """The schema of ``rows`` with more fields, given as DDL."""
    return StructType([*rows.schema.fields, *StructType.fromDDL(fields).fields])


def row_key(key: str, text: str) -> Column:
    """A 64-bit key of a row's id and text. Rows that agree in both are alike to every operator here."""
    return F.xxhash64(F.col(quoted(key)), F.col(quoted(text)))


def label_sample(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """At most about ``limit`` labelled rows (key, y), chosen by a hash of the key; rows without key or 0/1 label are none. Of several labels of a key the least counts.

    The bound keeps what a driver-side fit collects independent of the size of the labels.
    """
    rows = (
        labels.select(F.col(quoted(key)).alias("key"), F.col(quoted(label)).cast("int").alias("y"))
        .where(F.col("key").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("key")
        .agg(F.min("y").alias("y"))
    )
    total = rows.count()
    if total <= limit:
        return rows
    share = int(limit / total * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.col("key"), F.lit("sample")), F.lit(1 << 30)) < share)


def one_each(rows: DataFrame) -> DataFrame:
    """One row for each ``key``, that with the least hash of its other columns: partly aggregated, so a key with very many rows reaches nobody whole."""
    others = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("x")).select("key", "x.*")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """The connected components of undirected ``edges`` (a, b: long): (node, root), root the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows those pointers to their ends by doubling, and goes
    on with the edges between the ends, until none is left. Every step is a join of two written tables, so hot nodes can
    be split, and nothing is collected. An empty table gives an empty result.
    """
    edges = settled(edges.select("a", "b").where("a <> b").distinct(), folder, "edges")
    nodes = settled(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), folder, "nodes")
    roots = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        hooks = settled(hooks, folder, "hooks")
        while True:  # p of p, until every pointer ends in a node that points to itself
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = settled(hooks.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), folder, "hooks")
            hooks = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        roots = settled(
            roots.join(hooks, roots["root"] == hooks["a"], "left").select("node", F.coalesce("p", "root").alias("root")),
            folder,
            "roots",
        )
        left = hooks.select("a", F.col("p").alias("x"))
        right = hooks.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = settled(
            edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            folder,
            "edges",
        )
    return roots
