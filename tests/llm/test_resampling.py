import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from inboxlake.llm import resampling
from inboxlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in found]


def naive(docs, target, percent=5, least=20):
    """(key, n_features, weight, score, rank) of documents given as (key, text)."""
    ours = [buckets_of(t) for _, t in docs]
    s, t = np.zeros(10_000, dtype=int), np.zeros(10_000, dtype=int)
    for _, found in ours:
        np.add.at(s, found, 1)
    for x in target:
        np.add.at(t, buckets_of(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1.0) * (s.sum() + 10000.0) / ((a + 1.0) * (t.sum() + 10000.0)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for (key, _), (words, found) in zip(docs, ours):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = percent * len(fit) // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)] + [(*r[:4], None) for r in rows if not r[4]]


@pytest.mark.parametrize("reach", [2, 7, 64])
def test_hashes_of_all_features(reach):
    draw = random.Random(reach)
    parts = ["ab", "C", "é", "日本", "  ", "-", "x9", " ", "\n", "q" * 40, "y" * 70, "z" * 500, "\x00", "😀", "İ"]
    some = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(200)] + ["", "   ", "a", "w" * 30_000 + " b"]
    words, owner, bucket = resampling.features(resampling.Crc(reach), [x.encode() for x in some])
    for i, x in enumerate(some):
        n, found = buckets_of(x)
        assert words[i] == n and sorted(bucket[owner == i].tolist()) == sorted(found)


def test_no_words_at_all():
    words, owner, bucket = resampling.features(resampling.Crc(), [b"", b" - "])
    assert words.tolist() == [0, 0] and not len(owner) and not len(bucket)


def test_query_against_the_naive_form(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(map(str, map(tuple, QUERIES["op13_importance_resampling"](spark, folder).collect()))) == sorted(map(str, naive(docs, target)))


def test_ties_and_hot_rows(spark, folder):
    draw = random.Random(2)
    docs = [(5, "the same words " * 9)] * 300 + [(i, " ".join(draw.choice("abcdef") for _ in range(draw.randint(10, 40)))) for i in range(400)]
    target = ["a b c", None, ""]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    found = resampling.ranked(rows, spark.createDataFrame([(x,) for x in target], "text string"), folder, percent=60)
    assert sorted(map(str, ((r.rest.doc_id, *r[1:]) for r in found.collect()))) == sorted(map(str, naive(docs, target, 60)))


def test_awkward_rows(awkward, nothing, folder):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    target = awkward.where("doc_id = 4").select("text")
    found = resampling.ranked(awkward, target, folder, percent=50).collect()
    assert sorted(map(str, ((r["rest"].doc_id, *r[1:]) for r in found))) == sorted(map(str, naive(docs, [r.text for r in target.collect()], 50)))
    drawn = resampling.resampled(awkward, target, folder, percent=50)
    assert drawn.columns == awkward.columns and drawn.count() == sum(r["rank"] is not None for r in found)
    assert sorted(map(str, drawn.select("doc_id").collect())) == sorted(f"Row(doc_id={r['rest'].doc_id})" for r in found if r["rank"] is not None)
    assert drawn.exceptAll(awkward).isEmpty()
    assert resampling.ranked(nothing, target, folder).count() == 0 and resampling.resampled(nothing, target, folder).count() == 0
    assert {r.weight for r in resampling.weighted(awkward.where("text is null or text = ''"), np.ones(10_000, dtype=np.int64)).collect()} == {0}
