import hashlib
import random
import re
from collections import Counter

import pytest

from inboxlake.llm import suffix_dedup
from inboxlake.llm.queries import QUERIES
from inboxlake.llm.suffix_array import Suffixes, repeated


def plain(texts, size):
    """Of each text (bytes): bytes, bytes removed, spans and what is kept, by counting all windows."""
    seen = Counter(x[i : i + size] for x in texts for i in range(len(x) - size + 1))
    out = []
    for x in texts:
        gone = [False] * len(x)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), len(x) - len(kept), spans, kept))
    return out


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "\0ab", "ÿa"])
def test_suffix_array_and_prefixes(alphabet):
    draw = random.Random(alphabet)
    for _ in range(60):
        some = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))).encode("latin-1") for _ in range(draw.randint(1, 5))]
        some += some[:1] * draw.randint(0, 2)
        s = Suffixes(some)
        order = sorted(((tuple(c + 1 for c in x[j:]) + (0,), int(a) + j) for x, a in zip(some, s.start) for j in range(len(x) + 1)))
        assert [p for _, p in order] == s.sa.tolist()
        common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)) - 1) for (a, _), (b, _) in zip(order, order[1:])]
        assert s.lcp.tolist()[1:] == common
        size = draw.randint(1, 8)
        windows = Counter(x[j : j + size] for x in some for j in range(len(x) - size + 1))
        assert sorted(repeated(s, size).tolist()) == sorted(int(a) + j for x, a in zip(some, s.start) for j in range(len(x) - size + 1) if windows[x[j : j + size]] > 1)


def test_merging_by_binary_search():
    draw = random.Random(8)
    for _ in range(60):
        one, two = (["".join(draw.choice("ab") for _ in range(draw.randint(0, 30))).encode() for _ in range(3)] for _ in range(2))
        size = draw.randint(1, 9)
        a, b = Suffixes(one), Suffixes(two)
        in_one, in_two = ({x[j : j + size] for x in some for j in range(len(x) - size + 1)} for some in (one, two))
        mine, theirs = a.found(b, size)
        for s, some, other, got in ((a, one, in_two, mine), (b, two, in_one, theirs)):
            assert sorted(got.tolist()) == sorted(int(at) + j for x, at in zip(some, s.start) for j in range(len(x) - size + 1) if x[j : j + size] in other)


def results(df):
    return sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in df.collect())


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def passages(seed, hot=0):
    """Texts that share passages, lines and whole copies, some with edits and some that repeat themselves."""
    draw = random.Random(seed)
    letters = lambda n: "".join(draw.choices("abcdefghij é", k=n))
    shared = [letters(n) for n in (199, 200, 201, 350, 900)]
    out = [letters(draw.randint(0, 600)) + draw.choice(shared) + letters(draw.randint(0, 300)) for _ in range(40)]
    out += [out[0], out[0], out[1][:150] + "#" + out[1][151:], "xy" * 400, "z" * 250, shared[3] + shared[3], "", "q" * 200, "q" * 199]
    line = letters(90)
    out += [letters(250) + line + letters(250) for _ in range(hot)]
    return out


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_against_all_windows(spark, folder, shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    texts = passages(3, hot=40)
    got = results(suffix_dedup.cut_repeats(docs_of(spark, texts), folder))
    assert got == sorted(plain([t.encode() for t in texts], 200))


def test_long_texts_are_scanned_in_parts(spark, folder, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 700)
    texts = passages(4)
    assert results(suffix_dedup.cut_repeats(docs_of(spark, texts), folder)) == sorted(plain([t.encode() for t in texts], 200))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {d.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in zip(docs, plain([(d.text or "").encode() for d in docs], 200))}
    rows = QUERIES["op8_suffix_arrays"](spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_awkward_rows(awkward, nothing, folder):
    docs = awkward.collect()
    assert results(suffix_dedup.cut_repeats(awkward, folder)) == sorted(plain([(d.text or "").encode() for d in docs], 200))
    left = suffix_dedup.without_repeats(awkward, folder)
    assert left.columns == awkward.columns and left.count() == len(docs)
    assert {r.doc_id: r.text for r in left.collect()}[0] is None
    assert suffix_dedup.cut_repeats(nothing, folder).count() == 0


def test_many_repeated_rows_hand_on_their_runs_once(spark, folder):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = [(1, passage + " one")] * 200 + [(None, "other " + passage)] * 200 + [(3, "alone " * 5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = suffix_dedup.repeats(rows.select(suffix_dedup.row_key("doc_id", "text").alias("key"), "text"), folder)
    assert found.count() == found.distinct().count() < 400
    got = {(r.rest.doc_id, bytes(r.kept)) for r in suffix_dedup.cut_repeats(rows, folder).collect()}
    assert got == {(1, b""), (None, b""), (3, ("alone " * 5).encode())}


def test_texts_are_cut_and_decoded_by_one_python_operator(spark, folder):
    """A second one in the same tasks would double the Python workers, which then share out the tasks of later stages."""
    passage = "é" * 150
    texts = ["a" + passage + "b", passage[:120] + "c" + passage[:90] + "x", "short", "", None, "one of its kind " * 3, "日" + "é" * 100 + "本"]
    left = suffix_dedup.without_repeats(docs_of(spark, texts), folder)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow|EvalPython", plan)) == 1
    want = [None if t is None else k[3].decode("utf-8", "ignore") for t, k in zip(texts, plain([(t or "").encode() for t in texts], 200))]
    assert [r.text for r in left.orderBy("doc_id").collect()] == want
