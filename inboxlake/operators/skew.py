"""Joins and ranks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inboxlake.sources.tables import settled

HOT_ROWS = 500_000  # rows of one key from which it is split
HOT_KEYS = 1_000  # most keys that are split; bounds what is broadcast
SALTS = 256


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """The keys with at least ``hot_rows`` rows, the ``most`` largest of them, with their count ``_n``.

    Counting is partial on the map side, so a hot key costs one row per task.
    The order is total, so every use of the result sees the same keys. Keys left
    out are joined the ordinary way: the bound is on the broadcast, not on results.
    """
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.filter(F.col("_n") >= hot_rows)
    return counts.orderBy(F.col("_n").desc(), *keys).limit(most)


def _salted(df: DataFrame, hot: DataFrame, keys: Sequence[str], salt: Column) -> DataFrame:
    return df.join(F.broadcast(hot), list(keys), "left").select(*df.columns, salt.alias("_salt"))


def _spread(keys: Sequence[str], by: Sequence[str], salts: int) -> Column:
    """Salt of a row to be split. Rows without a key match nothing, so they are split too."""
    split = F.col("_hot").isNotNull()
    for key in keys:
        split = split | F.col(key).isNull()
    return F.when(split, F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(F.lit(0).cast("long"))


def _copies(salts: int) -> Column:
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    return F.explode(F.when(F.col("_hot").isNotNull(), every).otherwise(F.array(F.lit(0).cast("long"))))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    spread: Sequence[str],
    counted: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi join in which the rows of hot left keys are split over ``salts`` tasks.

    For a right side that was grouped or ranked by the same key, where adaptive
    execution cannot split the join. ``spread`` names left columns that tell the
    rows of one key apart. The few right rows of a hot key are copied to each of
    its salts; no other row is. The result is that of the plain join. ``counted``
    is a cheaper frame to find the hot keys in, such as ``left`` before its joins.
    """
    keys = list(on)
    hot = hot_keys(left if counted is None else counted, keys, hot_rows).select(*keys, F.lit(True).alias("_hot"))
    left = _salted(left, hot, keys, _spread(keys, spread, salts))
    right = _salted(right, hot, keys, _copies(salts))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


SIDE = 16  # parts of each side of a join of all pairs under few keys


def spread_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], left_by: str, right_by: str, side: int = SIDE) -> DataFrame:
    """Equi join whose few keys have many rows on both sides: the pairs of a key are dealt to ``side`` x ``side`` tasks, for which each row is copied ``side`` times.

    The number of tasks is fixed: adaptive execution would go by the few bytes that come in, not by the many pairs that are made, and join them to one or two.
    """

    def part(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(side))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long")))
    dealt = left.withColumn("_a", part(left_by)).withColumn("_b", every)
    copied = right.withColumn("_b", part(right_by)).withColumn("_a", every)
    by = [*on, "_a", "_b"]
    return dealt.repartition(side * side, *by).join(copied.repartition(side * side, *by).hint("shuffle_hash"), by).drop("_a", "_b")


BUCKET_IDS = 4_096  # neighbouring ids that are numbered in one task


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: str, ids: int = BUCKET_IDS, folder: str | None = None) -> DataFrame:
    """``place`` from 0 of each row within its key, by the columns ``order`` and then the whole number ``tie``; missing values last.

    Rows that agree in ``order`` and whose ties lie in one range of ``ids`` numbers are a bucket. They are numbered inside (key, bucket) and
    moved by the rows of the buckets before, so that a key is not sorted by one task. The rows are needed
    twice: with a ``folder`` they are written there first instead of worked out twice.
    """
    keys, order = list(keys), list(order)
    if folder is not None:
        df = settled(df, folder, "unnumbered")
    bucketed = df.withColumn("_range", F.floor(F.col(tie) / ids))
    bucket = [*order, "_range"]
    up = [F.col(c).asc_nulls_last() for c in bucket]
    sizes = bucketed.groupBy(*keys, *bucket).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy(*up).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, *bucket).orderBy(F.col(tie).asc_nulls_last()))
    left, right = bucketed.withColumn("_inside", inside).alias("l"), offsets.alias("r")
    same = F.lit(True)
    for c in [*keys, *bucket]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_inside") + F.col("_before") - 1).alias("place"))


def newest(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], k: int = 1) -> DataFrame:
    """The ``k`` newest rows per key, NULL times first, ties by the ``tie`` columns descending.

    The rank filter becomes a group limit before the shuffle: a task sends at
    most ``k`` rows of a key.
    """
    order = [F.col(time).desc_nulls_first(), *[F.col(c).desc_nulls_last() for c in tie]]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def newest_rows(df: DataFrame, keys: Sequence[str], time: str, id: str, k: int, salts: int = 64, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As ``newest``, for wide rows with a unique ``id`` that is not NULL: only keys, times and ids are ranked to find the ids that stay.

    These ranks are taken in two steps, first in each of ``salts`` parts of a key and then among the at most ``k`` rows that each leaves, so the last step
    of a key gets ``k * salts`` short rows at most, however many rows or tasks it has. ``fetch`` gives the rows of a frame of ids, by a semi join if it
    is missing; the at most ``k`` rows of each key are ranked again where they are needed, so texts that are looked up are shuffled once, by key.
    """
    order = [F.col(time).desc_nulls_first(), F.col(id).desc_nulls_last()]
    slim = df.select(*keys, time, id).withColumn("_salt", F.pmod(F.xxhash64(id), F.lit(salts)))
    first = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))
    some = slim.withColumn("_place", first).filter(F.col("_place") <= k)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    left = some.withColumn("rank", rank).filter(F.col("rank") <= k).select(id)
    rows = df.join(left, id, "left_semi") if fetch is None else fetch(left)
    return rows.withColumn("rank", rank)
