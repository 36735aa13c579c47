import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inboxlake.llm import alignment
from inboxlake.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def naive():
    """groups and links of one text, token by token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = {c: bytes([x]) for c, x in alignment.byte_letters().items()}

    def of(text):
        if not text:
            return [], []
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xa = [b"".join(letter[c] for c in a.id_to_token(i)) for i in ia]
        xb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
            return [], []
        sa, sb = (list(zip(np.cumsum([0, *map(len, x)]).tolist(), np.cumsum(list(map(len, x))).tolist())) for x in (xa, xb))
        links = [(i, j) for i, (p, q) in zip(ia, sa) for j, (r, s) in zip(ib, sb) if p < s and r < q]
        cuts = sorted({q for _, q in sa} & {q for _, q in sb})
        groups = [([i for i, (p, q) in zip(ia, sa) if lo <= p and q <= hi], [j for j, (p, q) in zip(ib, sb) if lo <= p and q <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        return groups, links

    def corpus(texts):
        each = [of(x) for x in texts]
        count = Counter(x for _, links in each for x in links)
        most = defaultdict(int)
        for (_, j), n in count.items():
            most[j] = max(most[j], n)
        out = []
        for groups, links in each:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), text))
        return out, count, most

    return corpus


def texts_of(seed):
    draw = random.Random(seed)
    parts = ["a", "the", "tion", " ", " ", " ", "  ", "\n", "\n", " \n", "\t", "é", "日本", "1", "'s", "!", " ", "▁", "<s>", "<|endoftext|>", "x" * 90, "Éa", "😀", "\x00"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(250)] + [None, "", " ", "a", " a", "a ", "▁", "<unk>", "\n", "\na", "w" * 900]


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_against_the_naive_form(naive, seed):
    texts = texts_of(seed)
    linker = alignment.Linker(A, B)
    linker.memo.memory = 40 if seed == 2 else 10**6
    want, count, _ = naive(texts)
    found = Counter()
    for lo in range(0, len(texts), 60):
        some = texts[lo : lo + 60]
        counts, groups, pairs, owner = linker.of(pa.array(some, pa.string()))
        for i in range(len(some)):
            assert (*counts[i].tolist(), groups[i].decode()) == (*want[lo + i][:4], want[lo + i][6]), some[i]
            assert (owner == i).sum() == want[lo + i][3]
        found.update((p % linker.n_a, p // linker.n_a) for p in pairs.tolist())
    assert found == count


def test_query_against_the_naive_form(spark, naive, folder):
    given = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{given}/documents.parquet").where("length(text) < 4000").collect()]
    want, _, _ = naive([t for _, t in docs])
    rows, _ = alignment.aligned(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), A, B, folder)
    assert sorted((r.rest.doc_id, *r[1:]) for r in rows.collect()) == sorted((i, *w) for (i, _), w in zip(docs, want))
    whole = {r.doc_id: r for r in QUERIES["op12_alignment"](spark, given).collect()}
    assert len(whole) == 200
    for (i, _), w in zip(docs, want):
        assert (whole[i].n_a, whole[i].n_b, whole[i].n_groups, whole[i].n_links) == w[:4]
        assert whole[i].groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_small_buffers_and_many_merges(spark, naive, folder, monkeypatch):
    monkeypatch.setattr(alignment, "RECORDS", 200)
    monkeypatch.setattr(alignment, "FRAME", 3)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "PARTS", 4)
    draw = random.Random(8)
    words = ["under", "standing", "tion", "house", "été", "ing", "zzz", "qu"]
    texts = [" ".join("".join(draw.choice(words) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(0, 40))) for _ in range(60)] + ["the hot text"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, count, most = naive(texts)
    rows, pairs = alignment.aligned(docs, A, B, folder)
    assert sorted((r.rest.doc_id, *r[1:]) for r in rows.collect()) == [(i, *w) for i, w in enumerate(want)]
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b, n, n == most[b]) for (a, b), n in count.items())


def test_merge_of_runs():
    draw = np.random.default_rng(3)
    runs = [np.unique(draw.integers(0, 4000, draw.integers(0, 900)), return_counts=True) for _ in range(30)]
    want = Counter()
    for k, n in runs:
        want.update(dict(zip(k.tolist(), n.tolist())))
    most = defaultdict(int)
    for k, n in want.items():
        most[k // 50] = max(most[k // 50], n)
    got = [x for part in alignment.merged([alignment.framed(k, n) for k, n in runs], 50) for x in zip(*(y.tolist() for y in part))]
    assert got == [(k, n, n == most[k // 50]) for k, n in sorted(want.items())]


def test_awkward_rows(awkward, nothing, naive, folder):
    texts = [r.text for r in awkward.collect()]
    want, _, _ = naive([x if x is None or len(x) < 5000 else "" for x in texts])
    rows, pairs = alignment.aligned(awkward, A, B, folder)
    got = sorted((str(r["rest"].doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) for r in rows.collect())
    short = {str((str(r.doc_id), *w[:4], w[6])) for r, w in zip(awkward.collect(), want) if r.text is None or len(r.text) < 5000}
    assert short <= set(map(str, got)) and len(got) == len(texts)
    rows, pairs = alignment.aligned(nothing, A, B, folder)
    assert rows.count() == 0 and pairs.count() == 0
