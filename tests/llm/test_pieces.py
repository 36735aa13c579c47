import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from inboxlake.llm import pieces
from inboxlake.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def texts_of(library, seed):
    draw = random.Random(seed)
    names = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    out = ["".join(draw.choice(names) for _ in range(draw.randint(0, 15))).replace("▁", draw.choice([" ", "▁", ""])) for _ in range(600)]
    out += ["".join(draw.choice("aeinrst  \n.0é=") for _ in range(draw.randint(0, 80))) for _ in range(600)]
    return out + ["", " ", "  a  b ", "▁a", "\n x\x00y", "a\u200bb", "日本語 😀 ἄ", "<s> </s> <unk> <0x41>", "a" * 3000, " " * 70 + "x", "ab" * 999 + "aab"]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_library(library, model, seed):
    texts = texts_of(library, seed)
    ids = [x.tolist() for x in model.encode(texts)]
    assert ids == library.encode(texts, num_threads=1)
    assert [model.decode(x) for x in ids] == [library.decode(x) for x in ids]


def test_forgetting_words_changes_nothing(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 10)
    monkeypatch.setattr(pieces, "LONGEST", 3)
    texts = texts_of(library, 3)
    got = [x.tolist() for lo in range(0, len(texts), 100) for x in model.encode(texts[lo : lo + 100])]
    assert got == library.encode(texts, num_threads=1)


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t in docs.items():
        ids = library.encode(t)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    rows = QUERIES["op9_pieces"](spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_awkward_rows(awkward, nothing, library):
    rows = pieces.encoded(awkward, PATH).collect()
    want = sorted((str(d.doc_id), library.encode(d.text or "")) for d in awkward.collect())
    assert sorted((str(r.rest.doc_id), r.ids) for r in rows) == want
    assert pieces.encoded(nothing, PATH).count() == 0
