import random

import numpy as np
import pytest
import xxhash

from inboxlake.llm import similar, simhash
from inboxlake.llm.common import components
from inboxlake.llm.gray_index import GrayIndex, gray_rank
from inboxlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(codes, radius, keys):
    """Smallest key reachable, by comparing all pairs."""
    n = len(codes)
    out = list(keys)
    near = [[j for j in range(n) if (codes[i] ^ codes[j]).bit_count() <= radius] for i in range(n)]
    while True:
        new = [min((out[j] for j in near[i] if out[j] is not None), default=None) for i in range(n)]
        if new == out:
            return out
        out = new


def test_gray_rank_counts_the_gray_sequence():
    codes = np.array([[k ^ (k >> 1)] for k in range(200)], dtype=np.uint64)
    assert gray_rank(codes)[:, 0].tolist() == list(range(200))
    two = np.array([[a ^ (a >> 1), b ^ (b >> 1) ^ ((a & 1) << 63)] for a in range(3) for b in range(3)], dtype=np.uint64)
    assert gray_rank(two).tolist() == [[a, b] for a in range(3) for b in range(3)]


@pytest.mark.parametrize("words", [1, 2])
@pytest.mark.parametrize("radius", [0, 3, 9])
def test_index_against_all_pairs(words, radius):
    draw = np.random.default_rng(radius)
    codes = np.repeat(draw.integers(0, 2**64, size=(15, words), dtype=np.uint64), 12, axis=0)
    for _ in range(3):
        codes[:, 0] ^= np.uint64(1) << draw.integers(0, 64, len(codes)).astype(np.uint64)
    buckets = draw.integers(0, 3, len(codes))
    got = GrayIndex(codes, buckets).components(radius)
    whole = [((1 << 40) - 1) << (200 + 40 * int(b)) | sum(int(w) << 64 * k for k, w in enumerate(c)) for c, b in zip(codes, buckets)]
    want = grouped(whole, radius, list(range(len(codes))))
    named = {}
    assert all(named.setdefault(w, g) == g for w, g in zip(want, got.tolist())) and len(set(want)) == len(set(got.tolist()))


def test_index_of_none_and_one():
    assert len(GrayIndex(np.zeros((0, 1), dtype=np.uint64), np.zeros(0)).components(4)) == 0
    assert GrayIndex(np.zeros((1, 1), dtype=np.uint64), np.zeros(1)).components(4).tolist() == [0]


def test_components_of_a_chain_and_a_star(spark, folder):
    chain = [(k, k + 1) for k in range(1, 60)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (2, 1)], "a long, b long")
    got = {r.node: r.root for r in components(edges, folder).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{1000 + k: 1000 for k in range(200)}}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    want = grouped(prints, 4, [d.doc_id for d in docs])
    rows = {r.doc_id: r for r in QUERIES["op3_simhash"](spark, FOLDER).collect()}
    assert {d.doc_id: (f"{p:016x}", c) for d, p, c in zip(docs, prints, want)} == {i: (r.fingerprint, r.component_id) for i, r in rows.items()}


def test_awkward_rows(awkward, nothing, folder):
    rows = simhash.near_duplicates(awkward, folder).collect()
    docs = awkward.collect()
    assert len(rows) == len(docs)
    want = grouped([plain_fingerprint(d.text) for d in docs], 4, [d.doc_id for d in docs])
    assert sorted(map(str, ((d.doc_id, c) for d, c in zip(docs, want)))) == sorted(str((r.rest.doc_id, r.component)) for r in rows)
    assert simhash.near_duplicates(nothing, folder).count() == 0


def test_large_buckets_are_cut_and_lose_no_link(spark, folder, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 40)
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    codes = {centre} | {centre ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(300)} | {draw.getrandbits(64) for _ in range(50)}
    signed = [(c - (1 << 64) if c >> 63 else c,) * 2 for c in codes]
    edges = simhash.links(spark.createDataFrame(signed, "code long, w0 long"), 1, 4, folder)
    roots = {r.node: r.root for r in components(edges, folder).collect()}
    want = grouped([c & (1 << 64) - 1 for c, _ in signed], 4, [c for c, _ in signed])
    assert {c: w for (c, _), w in zip(signed, want)} == {c: roots.get(c, c) for c, _ in signed}


@pytest.mark.parametrize("codes", [100, 1 << 26, 1 << 40])
def test_keys_lose_no_link_at_any_size(codes):
    draw = random.Random(codes)
    masks = simhash.bucket_masks(1, 4, codes)
    for _ in range(200):
        a = draw.getrandbits(64)
        b = a
        for k in draw.sample(range(64), 4):
            b ^= 1 << k
        assert any(a & m[0] == b & m[0] for m in masks)


def test_one_of_each_group_stays(spark, awkward, folder):
    draw = random.Random(9)
    base = [" ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(300)) for _ in range(30)]
    near = []
    for text in base[:15]:
        words = text.split()
        words[draw.randrange(300)] = "changed"
        near.append(" ".join(words))
    rows = [(i, t, "x") for i, t in enumerate(base + near + base[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    kept = simhash.keep_one(docs, folder)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    left = simhash.keep_one(awkward, folder).collect()
    assert [r.doc_id for r in left].count(4) <= 1 and {r.doc_id for r in left} >= {3, 5, 7}


def pair(draw, jaccard, n):
    """Two texts of about ``n`` different words whose sets of five-word shingles have nearly the similarity given, and that."""
    words = ["".join(draw.choices("abcdefghij", k=8)) for _ in range(n)]
    other = [*words[: round((n - 4) * 2 * jaccard / (1 + jaccard)) + 4]]
    other += ["".join(draw.choices("klmnopqrst", k=8)) for _ in range(n - len(other))]
    a, b = ({tuple(x[k : k + 5]) for k in range(n - 4)} for x in (words, other))
    return " ".join(words), " ".join(other), len(a & b) / len(a | b)


def test_similar_pairs_link_and_others_do_not(spark, folder):
    """Pairs at 0.8 to 0.85 lie around the old radius, those at 0.75 to 0.79 too; repeats don't count."""
    draw = random.Random(31)
    pairs = [pair(draw, j, n) for j in (0.7, 0.75, 0.78, 0.805, 0.82, 0.85, 0.9) for n in [150, 400, 900] for _ in range(20)]
    line = " ".join(draw.choices("uvwxyz", k=12))
    pairs += [(a, f"{a} {' '.join([line] * 200)}", 400 / 416) for a in (pair(draw, 0.5, 404)[0] for _ in range(5))]
    pairs += [(f"{a} {' '.join([line + str(i)] * 300)}", f"{b} {' '.join([line + str(i)] * 300)}", 0.3) for i, (a, b, _) in enumerate(pair(draw, 0.2, 60) for _ in range(5))]
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(docs, folder).collect()}
    assert kept == {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, p in enumerate(pairs) if p[2] < 0.8}


def test_a_link_left_out_stands_on_compared_ones(spark, folder, monkeypatch):
    """A chain of steps at 0.9 is one group; its ends are not alike; a neighbour at 0.78 of every member stays apart, in pieces too."""
    draw = random.Random(32)
    words = ["".join(draw.choices("abcdefghij", k=8)) for _ in range(1000)]
    chain = [" ".join(words[20 * k : 20 * k + 400]) for k in range(20)]
    apart = " ".join(words[:352] + ["".join(draw.choices("klmnopqrst", k=8)) for _ in range(48)])
    docs = spark.createDataFrame([*enumerate(chain), (50, apart)], "doc_id long, text string")
    want = {**{k: 0 for k in range(20)}, 50: 50}
    assert {r.rest.doc_id: r.component for r in simhash.near_duplicates(docs, folder, **simhash.WIDE).collect()} == want
    monkeypatch.setattr(similar, "GROUP", 4)
    monkeypatch.setattr(similar, "GROUP_SHINGLES", 900)
    assert {r.rest.doc_id: r.component for r in simhash.near_duplicates(docs, folder, **simhash.WIDE).collect()} == want
