import random
import re

import numpy as np
import pytest

from inboxlake.llm import minhash, similar
from inboxlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + min(size, len(words))]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def linked(x, y, percent=80):
    both = len(x & y)
    return both and 100 * both >= percent * (len(x) + len(y) - both)


def naive(docs, percent=80):
    """The smallest key reachable of every row, over all pairs."""
    sets = {}
    for key, text in docs:
        sets.setdefault(shingles(text), []).append(key)
    names = list(sets)
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(names):
        for j in range(i):
            if linked(x, names[j], percent):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(names):
        keys = [k for k in sets[x] if k is not None]
        least.setdefault(find(i), []).extend(keys)
    out = []
    for key, text in docs:
        x = shingles(text)
        out.append((key, len(x), (min(least[find(names.index(x))], default=None) if x else key)))
    return out


def prose(draw, n):
    return [draw.choice(["an", "ber", "cho", "du", "es", "fi", "gra"]) + str(draw.randint(0, 99)) for _ in range(n)]


def planted(draw, count, words=60):
    """Texts around some bases, at all similarities."""
    out = []
    for _ in range(count):
        base = prose(draw, words)
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 6)):
            copy = list(base)
            for _ in range(draw.randint(1, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(["new", "other", "x" + str(draw.randint(0, 9))])
            out.append(" ".join(copy))
    return out


def compare(found, docs, percent=80):
    assert sorted(map(str, ((r.rest.doc_id, r.n, r.component) for r in found.collect()))) == sorted(map(str, naive(docs, percent)))


def test_planted_copies(spark, folder):
    draw = random.Random(3)
    docs = list(enumerate(planted(draw, 120)))
    compare(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), folder), docs)


def test_large_groups_by_pivots_and_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(similar, "GROUP", 12)
    monkeypatch.setattr(similar, "PIVOTS", 2)
    draw = random.Random(4)
    chain = prose(draw, 80)
    docs = []
    for k in range(70):  # each like the one before, the ends unlike
        chain = list(chain)
        chain[draw.randrange(80)] = f"c{k}"
        docs.append((k, " ".join(chain)))
    docs += [(1000 + k, x) for k, x in enumerate(planted(draw, 12, 40))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    compare(minhash.near_duplicates(frame, folder), docs)
    # one group of everything, so that pivots and blocks must tell apart
    every = minhash.signed_sets(frame, "doc_id", "text", 4, 2, 2).selectExpr("doc", "1L as root", "code").dropDuplicates(["code"])
    sets = similar.candidate_sets(frame, every, folder, "doc_id", "text", lambda x: minhash.shingle_set(x, 4))
    for rounds in (0, 1, 3):
        monkeypatch.setattr(similar, "ROUNDS", rounds)
        got = {r.code: r.root for r in minhash.components(similar.linked(sets, folder), folder).selectExpr("node as code", "root").collect()}
        code = {r.rest.doc_id: r.code for r in minhash.signed_sets(frame, "doc_id", "text", 4, 2, 2).collect()}
        groups, want = {}, {}
        for key, _, component in naive(docs):
            want.setdefault(component, set()).add(key)
            groups.setdefault(got.get(code[key], code[key]), set()).add(key)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_search_and_lookup_agree_with_all_pairs():
    draw = random.Random(9)
    texts = planted(draw, 15, 30) + ["", "one", "one two three four"]
    sets = [minhash.shingle_set(x.encode(), 4) for x in texts]
    pairs = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i != j and linked(shingles(x), shingles(y))}
    found = similar.Lookup(np.arange(len(sets)), sets).linked(sets, 80)
    assert {(i, j) for i, j in zip(*(x.tolist() for x in found)) if i != j} == pairs
    a, b = similar.search(sets, 80)
    assert {(i, j) for i, j in zip(a, b)} <= pairs


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_chance_of_a_miss(similarity):
    draw = np.random.default_rng(1)
    misses = 0
    for _ in range(400):
        both, other = round(200 * similarity), round(200 * (1 - similarity))
        x = draw.integers(0, 1 << 63, both + other, dtype=np.uint64)
        bands = minhash.bands([np.sort(x[: both + other // 2]), np.sort(np.concatenate([x[:both], x[both + other // 2 :]]))]).reshape(2, 2, -1)
        misses += not all((bands[0, k] == bands[1, k]).any() for k in (0, 1))
    assert misses == 0


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op11_minhash"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(naive(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_awkward_rows(awkward, nothing, folder):
    compare(minhash.near_duplicates(awkward, folder), [(r.doc_id, r.text) for r in awkward.collect()])
    assert minhash.near_duplicates(nothing, folder).count() == 0
