import math
import random

import pytest

from inboxlake.llm import vafile
from inboxlake.llm.queries import QUERIES


def plain(rows, asked, k):
    sound = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
    whole = {}
    for i, v in rows:
        if i is not None and sound(v):
            v = [math.floor(256 * x) for x in v]
            whole[i] = min(v, whole.get(i, v))
    out = []
    for q in sorted({i for i, _ in asked if i in whole}):
        scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def answers(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("bits", [2, 6])
def test_against_all_scores(spark, folder, bits, monkeypatch):
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vafile, "CANDIDATE_BLOCK", 20)
    draw = random.Random(bits)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(5)]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]  # ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).cache()
    exact = [(r.vec_id, r.embedding) for r in vectors.collect()]
    asked = [r for r in exact if r[0] % 10 == 0]
    assert answers(vafile.top_k(vectors, vectors.where("vec_id % 10 = 0"), folder, bits=bits)) == plain(exact, asked, 5)


def test_rows_that_take_no_part(spark, folder):
    rows = [(1, [0.5, 0.25]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, float("inf")]), (None, [1.0, 1.0]), (6, []), (7, [1.0]), (8, [-0.001, 0.0]), (8, [-0.001, 0.0]), (9, [0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, id string, d int")
    assert answers(vafile.top_k(vectors, vectors, folder)) == plain(rows, rows, 5)


def test_empty(spark, folder):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(none, none, folder).count() == 0
    one = spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")
    assert vafile.top_k(one, none, folder).count() == 0 and vafile.top_k(one, one, folder).count() == 0


def test_query_has_five_for_each_of_ten(spark):
    assert len(answers(QUERIES["op4_vector_file"](spark, "/root/testdata/sf0.001"))) == 50


def test_huge_components_do_not_overflow(spark, folder):
    rows = [(0, [1e17, 1.0]), (1, [-1e17, 2.0]), (2, [3.0, 1e300]), (3, [1.0, 1.0]), (4, [2.0, -5e16])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vafile.top_k(vectors, vectors, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all(sorted(x)[k][0] == k + 1 for x in got.values() for k in range(4)) and len(got) == 5
    assert all(-(1 << 63) < s < 1 << 63 for x in got.values() for _, _, s in x)
    assert sorted(got[3])[0][1:] == (0, (1 << 63) - 1)  # a tie at the end of the range goes to the smaller id
