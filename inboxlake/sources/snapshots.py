"""Tables kept in buckets of a key, of which an update reads and rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlake.sources.tables import settled

#: Buckets of a table. The driver sees their numbers, never rows.
BUCKETS = 64

# Dynamic overwriting leaves a partition alone for which there are no rows, so each bucket that is written has one row that is none.
_ROW = "is_row"


def bucket_of(key: list[str], buckets: int) -> Column:
    """Null keys have a bucket too."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: list[str], buckets: int, mode: str, touched: list[int] | None = None) -> None:
    spark = rows.sparkSession
    numbers = spark.range(buckets) if touched is None else spark.createDataFrame([(b,) for b in touched], "id long")
    marks = numbers.select(F.lit(False).alias(_ROW), F.col("id").cast("int").alias("bucket"))
    own = rows.select("*", F.lit(True).alias(_ROW), bucket_of(key, buckets).alias("bucket"))
    every = own.unionByName(marks, allowMissingColumns=True)
    # a bucket's rows come together by adaptive rebalancing, which splits one that is too large for a task
    every.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(path)


def create(rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Write ``rows`` as a new table whose updates go by ``key``."""
    _write(rows, path, key, buckets, "errorifexists")


def read(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The table, or the rows of some buckets: others are pruned before any file is opened."""
    rows = spark.read.schema(f"{schema}, {_ROW} boolean, bucket int").parquet(path)
    rows = rows if only is None else rows.where(F.col("bucket").isin(only))
    return rows.where(_ROW).drop(_ROW, "bucket")


def update(
    spark: SparkSession, path: str, schema: str, key: list[str], changes: DataFrame, apply: Callable[[DataFrame], DataFrame], folder: str, buckets: int = BUCKETS
) -> list[int]:
    """Replace the buckets that the keys of ``changes`` fall into by ``apply`` of their rows, and return their numbers.

    ``apply`` must keep rows in the bucket of their key, as changes by key do. What it gives is written to ``folder`` first, then over the buckets: one
    that is interrupted can be run again from there, and a repeated update of whole rows changes nothing.
    """
    touched = sorted(r["b"] for r in changes.select(bucket_of(key, buckets).alias("b")).distinct().collect())
    if touched:
        new = settled(apply(read(spark, path, schema, touched)), folder, "buckets")
        _write(new, path, key, buckets, "overwrite", touched)
    return touched
