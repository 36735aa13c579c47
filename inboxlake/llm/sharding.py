"""Shards of nearly equal bytes by sampled splitters.

Documents are ordered by a hash of their text, so equal texts are neighbours. Size-weighted samples of the keys give
quantile boundaries; records are counted by range, ranges that came out too full are sampled again and cut; running sums inside
the ranges then place every document at its exact byte in the whole order, and shards are equal stretches of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlake.llm.common import quoted
from inboxlake.sources.tables import settled

#: Ranges: at least, at most, and rows aimed at in one. The driver holds the boundaries and a count for each.
RANGES, MOST_RANGES, RANGE_ROWS = 256, 20_000, 200_000

#: Samples drawn for each range that is wanted, and times the mean size from which a range is cut again.
DRAWN, OVERFULL = 16, 4

#: Share of a shard's size by which its boundary may move so as not to cut a group of equal texts.
SLACK = 0.01


def _ranges(keys: DataFrame, cuts: np.ndarray) -> DataFrame:
    """``keys`` with the range each belongs to; ``cuts`` are the first keys of all ranges but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(cuts, batch.column("k").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "range"])

    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in keys.schema.fields)
    return keys.mapInArrow(run, f"{fields}, range int")


def _drawn(keys: DataFrame, wanted: int, total: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``wanted`` keys, each drawn with a chance in proportion to its size, and the bytes each stands for."""
    each = max(1.0, total / wanted)
    draw = F.pmod(F.xxhash64("k", "id", F.lit(turn)), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = keys.where(draw < F.col("size") / F.lit(each)).select("k", F.greatest(F.col("size"), F.lit(each)).alias("w")).toPandas()
    rows = rows.sort_values(["k", "w"])
    return rows["k"].to_numpy(dtype=np.int64), rows["w"].to_numpy(dtype=float)


def _quantiles(k: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    if not len(k):
        return k
    at = np.searchsorted(np.cumsum(w), w.sum() * np.arange(1, parts) / parts)
    return np.unique(k[np.minimum(at, len(k) - 1)])


def shards_by_bytes(docs: DataFrame, folder: str, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Size is the UTF-8 bytes of the text plus one; a null text counts as empty, a null id sorts first, repeated rows each
    have a slot. The law is ``bytes``: shards are equal stretches of the order by text hash, but a boundary moves to the
    edge of a group of equal texts if that is within ``SLACK`` of a shard. A group that is larger is cut, so one hot text
    cannot fill a shard. Slots follow the same order, from 0 without gaps. An empty table gives no rows.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    h = F.xxhash64(body)
    low = (1 << 20) - 1
    keys = docs.select(
        F.col(quoted(key)).alias("id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        # equal texts share the upper 44 bits; the id and the row's place spread them over the lower 20, so that a hot one can be cut, also one of
        # rows that agree in id and text; places stay as they are once the table is written
        h.bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.col(quoted(key)), F.monotonically_increasing_id()).bitwiseAND(F.lit(low))).alias("k"),
    )
    keys = settled(keys, folder, "keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = int(min(MOST_RANGES, max(RANGES, -(-rows // RANGE_ROWS))))
    cuts = _quantiles(*_drawn(keys, DRAWN * parts, total, 0), parts)
    for turn in range(1, 6):
        ranged = _ranges(keys, cuts)
        found = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("range")
        full = found[(found["bytes"] > OVERFULL * total / parts) & (found["rows"] > 1)]
        if not len(full):
            break
        inside, more = ranged.where(F.col("range").isin(full["range"].tolist())).drop("range"), int(full["bytes"].sum() * parts / total) + 1
        finer = np.union1d(cuts, _quantiles(*_drawn(inside, DRAWN * more, int(full["bytes"].sum()), turn), more))
        if len(finer) == len(cuts):
            break
        cuts = finer
    ranged = _ranges(keys, cuts)
    found = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("range")
    starts = found.assign(first_byte=found["bytes"].cumsum() - found["bytes"], first_row=found["rows"].cumsum() - found["rows"])
    begin = docs.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in starts[["range", "first_byte", "first_row"]].to_numpy()], "range int, first_byte long, first_row long"
    )
    order = Window.partitionBy("range").orderBy("k", "id", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("to", F.sum("size").over(order)).withColumn("n", F.count("*").over(order)).join(F.broadcast(begin), "range")
    group = F.col("k").bitwiseAND(F.lit(~low))
    placed = placed.select("id", "size", "text_crc32", group.alias("same"), (F.col("first_byte") + F.col("to") - F.col("size")).alias("at"), (F.col("first_row") + F.col("n") - 1).alias("row"))
    placed = settled(placed, folder, "placed")

    # groups of equal texts that lie across an even boundary: one for each boundary at most
    share = lambda x: F.floor(x * shards / F.lit(max(1, total)))
    across = [r["same"] for r in placed.where(share(F.col("at")) < share(F.col("at") + F.col("size") - 1)).select("same").distinct().collect()]
    edge = [r["same"] for r in placed.where(F.col("at").isin([-(-total * j // shards) for j in range(1, shards)])).select("same").distinct().collect()]
    spans = placed.where(F.col("same").isin([*across, *edge])).groupBy("same").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("size")).alias("b")).collect()
    bounds = []
    for j in range(1, shards):
        t = total * j / shards
        near = [x for r in spans if r["a"] < t < r["b"] for x in (r["a"], r["b"]) if abs(x - t) <= SLACK * total / shards]
        bounds.append(min(near, key=lambda x: abs(x - t), default=t))
    shard = sum((F.when(F.col("at") >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    out = placed.withColumn("shard", shard)
    first = {r["shard"]: r["row"] for r in out.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    before = F.coalesce(*[F.when(F.col("shard") == s, F.lit(n)) for s, n in sorted(first.items())], F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - before).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
