import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def plain(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(4)
    parts = [".", "!?", ":;", "é", "x.", "\u0301", "\x00",
             "the", "Haus", "ñ", "it's", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "12", "!?", "日本", "'ll", "\r\n", "<|endoftext|>", "a" * 300, "\u180e", "\ufeff", "\x85", "😀"]
    encoder = token_files.Encoder(PATH)
    assert encoder.by_word
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += [" ".join(rng.choices(["a", "the", "Haus.", "Haus", "Haus.,", "e\u0301.", "it's.", "12.", "...", "x\ny", "x.\ny!", "日本.", "日本", "é!"], k=rng.randrange(1, 9))) for _ in range(500)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == plain(text), repr(text)


def test_calls_do_not_depend_on_each_other():
    encoder = token_files.Encoder(PATH)
    for i in range(30):
        text = " ".join(f"w{j}" for j in range(i, i + 8)) + "\nend"
        assert encoder.encode([text])[0].tolist() == plain(text)
    held = {k: v for k, v in vars(encoder).items() if isinstance(v, (dict, list, set))}
    assert all(len(v) < 10 for v in held.values())


def test_slices_of_a_column(monkeypatch):
    import pyarrow as pa

    texts = ["a" * n for n in (3, 900, 0, 50, 50, 5000, 1)] + [None]
    monkeypatch.setattr(token_files, "SLICE", 100)
    cut = list(token_files._slices(pa.array(texts, pa.string())))
    assert [a for a, _ in cut] == [0, 1, 2, 5, 6] and sum(n for _, n in cut) == 8
    assert list(token_files._slices(pa.array([], pa.string()))) == []


def test_columns_of_many_texts_and_another_tokenizer():
    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Haus.", "the", "é!", "x,y", "12.", "it's", "\n", "\t", "naïve;", "日本.", "a\nb", "", "...", "<|endoftext|>", "\x00", "ſ.", "ɐ,"], k=rng.randrange(7))) for _ in range(4000)]
    ids, sizes = token_files.Encoder(PATH).encode_column(pa.array(texts))
    ends = np.cumsum(sizes)
    for t, i, j in zip(texts, ends - sizes, ends):
        assert ids[i:j].tolist() == plain(t), repr(t)
    other = public_tokenizers.path("word_bpe_49k.json")
    encoder, lib = token_files.Encoder(other), Tokenizer.from_file(other)
    assert not encoder.by_word
    for t, got in zip(texts[:300], encoder.encode(texts[:300])):
        assert got.tolist() == lib.encode(t, add_special_tokens=False).ids


def check(spark, frame, rows, folder):
    token_files.write_tokens(frame, folder, PATH)
    read = {(r["doc_id"], r["start"]): r["tokens"] for r in token_files.read_tokens(spark, folder).collect()}
    assert sorted(map(tuple, read.values())) == sorted((*plain(t), 0) for _, t in rows)
    got = [tuple(r) for r in token_files.token_digest(spark, folder).orderBy("start").collect()]
    want, at = [], 0
    texts = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [r[0] for r in texts]
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
    want = sorted((zlib.crc32(np.array([*plain(t), 0], "<u4")), len(plain(t)) + 1) for _, t in rows)
    assert sorted((c, n) for _, _, n, c in got) == want


def test_round_trip(spark, docs, folder):
    rows = [(5, "b c"), (1, None), (3, ""), (2, "x  y\n z"), (5, "b c"), (5, "other"), (-4, "neg"), (None, "no id"), (9, "long text " * 40_000)]
    frame = docs(rows).withColumn("part", F.lit("p")).withColumn("tokens", F.lit(1)).withColumn("_h", F.lit(2))
    check(spark, frame, rows, folder("a"))
    check(spark, frame.repartition(5), rows, folder("b"))


def test_empty(spark, docs, folder):
    token_files.write_tokens(docs([]), folder("e"), PATH)
    assert token_files.token_digest(spark, folder("e")).count() == 0


def test_files_are_encoded_as_stated(docs, folder, tmp_path):
    token_files.write_tokens(docs([(i, f"text {i % 7}") for i in range(5000)]), folder("f"), PATH, page_rows=100)
    files = list((tmp_path / "f").glob("*.parquet"))
    group = pq.ParquetFile(files[0]).metadata.row_group(0)
    codings = {group.column(i).path_in_schema.split(".")[0]: group.column(i).encodings for i in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in codings["tokens"]) and "DELTA_BINARY_PACKED" in codings["doc_id"]
    assert all(group.column(i).has_offset_index for i in range(group.num_columns))
