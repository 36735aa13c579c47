import zlib

import numpy as np
import pytest

from inboxlake.llm import sharding
from inboxlake.llm.queries import QUERIES


def check(rows, docs, shards=16):
    want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in docs)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    size = np.zeros(shards)
    for r in rows:
        size[r.shard] += r.size
    return size


def test_query_sizes(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    size = check(QUERIES["op5_sampled_splitters"](spark, folder).collect(), docs)
    assert abs(size - size.mean()).max() <= 0.02 * size.mean() + max(len((t or "").encode()) for _, t in docs)


def test_hot_text_is_cut_and_others_stay_together(spark, folder):
    docs = [(i, "hot " * 50) for i in range(1500)] + [(5000 + i, f"text {i % 400} " * (1 + i % 30)) for i in range(3000)]
    rows = sharding.shards_by_bytes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), folder).collect()
    size = check(rows, docs)
    assert size.max() < 1.05 * size.mean() and size.min() > 0.95 * size.mean()
    where = {}
    for r in rows:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(x) > 1 for x in where.values()) <= 6


def test_overfull_ranges_are_cut_again(spark, folder, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 32)
    monkeypatch.setattr(sharding, "DRAWN", 1)
    monkeypatch.setattr(sharding, "OVERFULL", 1.2)
    docs = [(i, f"{i} " * (1 + i % 50)) for i in range(2000)]
    size = check(sharding.shards_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), folder).collect(), docs)
    assert size.max() < 1.05 * size.mean()


@pytest.mark.parametrize("shards", [1, 16])
def test_awkward_rows(awkward, folder, nothing, shards):
    check(sharding.shards_by_bytes(awkward, folder, shards).collect(), [(r.doc_id, r.text) for r in awkward.collect()], shards)
    assert sharding.shards_by_bytes(nothing, folder, shards).count() == 0


def test_rows_equal_in_id_and_text_are_cut(spark, folder, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 32)
    docs = [(7, "hot " * 50)] * 3000 + [(None, "hot " * 50)] * 500 + [(i, f"text {i}") for i in range(500)]
    seen = []
    ranges = sharding._ranges
    monkeypatch.setattr(sharding, "_ranges", lambda keys, cuts: seen.append(len(cuts)) or ranges(keys, cuts))
    size = check(sharding.shards_by_bytes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), folder).collect(), docs)
    assert size.max() < 1.05 * size.mean() and seen[-1] > 20
