import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inboxlake.llm import packing
from inboxlake.llm.packing import Packer, Tokens, pack
from inboxlake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def whole(rows):
    """Every document's ids from its pieces, after the checks that hold for any packing."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 > 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048  # no padding
    return docs, sequences


def test_words_encoded_alone_give_the_ids_of_the_text(model):
    draw = random.Random(1)
    alphabet = ["a", "the", " ", "  ", "\n", " \n", "\t", "é", "日", "1", "'s", "!", "\u00a0", "\x1c", "\u2003", "<|endoftext|>", "x" * 100]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(3000)] + ["", " ", "  ", " a", "a "]
    tokens = Tokens(PATH)
    got = [np.frombuffer(x, dtype="<u4").tolist() for lo in range(0, len(texts), 500) for x in tokens.of(texts[lo : lo + 500])]
    assert got == [model.encode(x, add_special_tokens=False).ids for x in texts]


def test_forgetting_words_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 3)
    monkeypatch.setattr(packing, "LONGEST", 4)
    tokens, texts = Tokens(PATH), ["some longer words here", "some other words", "words words here again"]
    for _ in range(2):
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in tokens.of(texts)]
        assert got == [model.encode(x, add_special_tokens=False).ids for x in texts]


def test_choice_is_the_least_sum_of_squares():
    draw = random.Random(4)
    packer = Packer(window=12)
    for k in range(400):
        size = draw.randint(1, 11)
        h = packer.choose(size)

        def squares(to):
            level = packer.level.copy()
            if to:
                level[to] -= 1
            if to + size < 12:
                level[to + size] += 1
            return int((level[1:12] ** 2).sum())

        options = [x for x in range(12 - size + 1) if not x or packer.level[x]]
        assert h in options and squares(h) == min(map(squares, options))
        list(packer.place(k, b"\0\0\0\0" * size))


def test_query_against_the_library(spark, model):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pieces, _ = whole(pack(spark.read.parquet(f"{folder}/documents.parquet"), PATH).collect())
    want = {i: np.array([*model.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for i, t in docs.items()}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == want
    for r in QUERIES["op7_sum_of_squares"](spark, folder).collect():
        ids = want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.ids_crc32 == zlib.crc32(ids) and r.doc_tokens == len(want[r.doc_id]) // 4


def test_full_memory_cuts_what_is_open(spark, monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 3)
    docs = spark.createDataFrame([(i, "word " * (1100 + i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    pieces, sequences = whole(pack(docs, PATH).collect())
    assert len(pieces) == 40


def test_awkward_rows(awkward, nothing, model):
    rows = pack(awkward, PATH).collect()
    whole([r for r in rows])
    want = sum(len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in awkward.collect())
    assert sum(r.length for r in rows) == want and pack(nothing, PATH).count() == 0


def test_arrow_lets_go_of_the_ids_of_a_block():
    block = bytearray(4 * 100)
    packer = Packer(window=12)
    pieces = [*packer.place("a", memoryview(block)), *packer.close()]
    assert sum(len(ids) for _, _, ids, _, _ in pieces) == 400
    pa.array([ids for _, _, ids, _, _ in pieces], pa.binary())
    del pieces
    block.append(0)  # fails as long as anything holds a view of it
