import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import infill

ALPHABET = ["word", " ", "é", "\n", "longerword" * 9, "a" * 40, "😀", "x1", "<P", "P>", "<"]


def brute(doc_id, text):
    text = text or ""
    tokens = infill.TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_cuts_of_chunks_are_those_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(infill, "BITS", 4)
    monkeypatch.setattr(infill, "MEMO", 300)
    rng, counts = random.Random(2), infill.ChunkCounts()
    for k in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(120))) * (9 if k % 40 == 0 else 1)
        h1, h2 = rng.randrange(2**32), rng.randrange(2**32)
        tokens = infill.TOKEN.findall(text)
        a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        assert counts.cuts(text, h1, h2) == (len(tokens), len("".join(tokens[:a])), len("".join(tokens[:b])))
        ends = infill.chunk_ends(text)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(text)
    assert len(counts.memo) <= 301 and len(counts.older) <= 301


def test_a_shared_passage_is_cut_alike_and_counted_once():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    cut = [{t[i:j] for i, j in zip([0, *infill.chunk_ends(t)], infill.chunk_ends(t))} for t in ("x" * 77 + passage, "other start " + passage)]
    assert len(cut[0] & cut[1]) > 0.8 * len(cut[0]) > 8
    counts = infill.ChunkCounts()
    counts.cuts("x" * 77 + passage, 1, 2)
    known = len(counts.memo)
    counts.cuts("other start " + passage, 1, 2)
    assert len(counts.memo) - known <= 3


def test_forms_and_round_trip(spark, docs):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(200)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "has <S> inside"), (None, "no id"), (7, "again"), (7, "again"), (1003, "<"), (1004, "ab"), (1005, "very long " * 60_000), (-3, "<<P"),
             (1006, "a" * 50_000), (1007, "<P" * 30)]
    frame = docs(rows).withColumn("n", F.lit("x")).withColumn("h1", F.lit(1)).withColumn("output", F.lit("o"))
    made = infill.fill_in_middle(frame.repartition(3)).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made), key=key) == sorted(((i, *brute(i, t)) for i, t in rows), key=key)
    assert sorted(r["back"] for r in made) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs([])).count() == 0
