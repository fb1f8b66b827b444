import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import pieces
from tessera.llm.queries import op12_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def whole(text):
    return LIB.encode(text or "", add_bos=True, add_eos=True)


def test_ids_are_those_of_the_library(model):
    rng = random.Random(1)
    names = [LIB.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    mixed = [*"abcdefgstr ing  ...==--**12é日本\n\t▁\x00😀", "the", "ing", "tion", "  ", "    "]
    texts = ["", " ", "a  b", "a" * 25, "=" * 57, "-" * 1000, " " * 333, "ab" * 500, "\x85﻿x", "<s>", "́", "é", "ẞß", "नमस्ते दुनिया"]
    for _ in range(1500):
        few = rng.choice(["ab", "=-", "* ", "aei", "._/", "  x", "ninga"])
        texts += ["".join(rng.choice(mixed) for _ in range(rng.randrange(40))), "".join(rng.choice(names) for _ in range(rng.randrange(20))),
                  "".join(rng.choice(few) for _ in range(rng.randrange(80)))]
    got = model.encode(texts)
    assert [g.tolist() for g in got] == [whole(t) for t in texts]
    assert model.decode(got) == [LIB.decode(whole(t)) for t in texts]


def test_ids_of_any_order_decode_as_in_the_library(model):
    rng = random.Random(2)
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 259 + rng.randrange(300)]) for _ in range(rng.randrange(9))]
             for _ in range(2000)]
    assert model.decode([np.array(x, np.int64) for x in lists]) == [LIB.decode(x) for x in lists]
    assert model.decode([]) == [] and model.decode([np.array([], np.int64)]) == [""]


def test_words_without_spaces_and_memo(model, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(pieces, "MEMO", 50)
    monkeypatch.setattr(pieces, "ROUND_CHARS", 400)
    texts = ["".join(rng.choice(["the", "ver", "ung", "x"]) for _ in range(9000)), *(" ".join(f"w{rng.randrange(300)}" for _ in range(30)) for _ in range(60))]
    assert [g.tolist() for g in model.encode(texts)] == [whole(t) for t in texts]
    assert len(model.memo) <= 150 and len(model.older) <= 150


def test_pieces_that_hold_inner_spaces_have_no_words():
    assert pieces._word_pattern({("a", "b"), ("b", "▁")}) is None
    words = pieces._word_pattern({("▁", "a"), ("a", "b"), ("'", "a"), (".", ",")})
    assert words.findall(" ab'a., b  .b") == [" ab'a", ".,", " b", "  .", "b"]


def test_columns_and_odd_rows(spark, docs):
    rows = [(1, "two  words\n"), (2, None), (3, ""), (1, "two  words\n"), (None, "no id"), (5, "long text, " * 30_000)]
    frame = docs(rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "_c1")
    coded = pieces.encode_pieces(frame, PATH)
    assert coded.columns == ["doc_id", "text", "_c1", "n_chars", "ids"]
    read = pieces.decode_pieces(coded, PATH, out="text").collect()
    assert sorted((r["text"], r["ids"]) for r in read) == sorted((t or "", whole(t)) for _, t in rows)
    packed = pieces.decode_pieces(pieces.encode_pieces(frame, PATH, packed=True), PATH)
    assert {(r["text"] or "", r["decoded"], bytes(r["ids"])) for r in packed.collect()} == {(t or "", t or "", np.array(whole(t), "<u4").tobytes()) for _, t in rows}
    assert pieces.encode_pieces(docs([]), PATH).count() == 0
    missing = spark.createDataFrame([(None,), ([1, 264, 2],)], "ids array<int>")
    assert {r["decoded"] for r in pieces.decode_pieces(missing, PATH).collect()} == {None, "a"}


def test_query_against_the_library(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(whole(t)), sha(np.array(whole(t), "<u4").tobytes()), sha(LIB.decode(whole(t)).encode())) for i, t in texts.items()}
    assert {tuple(r) for r in op12_sentencepiece(spark, sf).collect()} == want
