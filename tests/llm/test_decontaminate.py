import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as d


def corpus(seed, items=40, docs=150):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "is", "to"], [f"w{i}" for i in range(900)]
    draw = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    made = [(i, draw(rng.choice([1, 3, 6, 12, 30, 60]))) for i in range(items)]
    texts = []
    for i in range(docs):
        words = draw(rng.choice([0, 3, 40, 400]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            own = list(rng.choice(made)[1])
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = rng.choice(rare)
            own = own[: rng.choice([len(own), len(own), len(own) * 9 // 10, len(own) // 2])]
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        texts.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return [(i, " ".join(w)) for i, w in made], texts


def bm25(index, item, passage):
    return sum(x for t, x in index.impacts[item].items() if t in {index.term.get(w) for w in passage})


@pytest.mark.parametrize("seed", range(6))
def test_search_returns_all_above_threshold(seed, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 3)
    items, texts = corpus(seed)
    index = d.ItemIndex([(i, t, None) for i, t in items])
    for _, text in texts:
        words = d.words_of(text)[:130]
        terms = sorted({index.term[w] for w in words if w in index.term})
        want = {i for i in range(len(items)) if bm25(index, i, words) >= index.need[i]}
        got = dict(index.search(terms))
        assert set(got) == want
        assert all(abs(s - bm25(index, i, words)) < 1e-9 for i, s in got.items())


@pytest.mark.parametrize("seed", range(6))
def test_matches_are_those_of_a_full_comparison(seed):
    items, texts = corpus(seed)
    index = d.ItemIndex([(i, t, None) for i, t in items])
    step = max(64, index.longest)
    some = 0
    for _, text in texts:
        words, want = d.words_of(text), set()
        for at in range(0, max(1, len(words)), step):
            passage = words[at:at + 2 * step]
            for i, (item, t) in enumerate(items):
                own = d.words_of(t)
                tail = set(own[-max(1, len(own) // 4):])
                runs = d.shingles(own, 5)
                share = len(runs & d.shingles(passage, min(5, len(own)))) / len(runs)
                if share >= 0.8 and len(tail.intersection(passage)) / len(tail) >= 0.5:
                    want.add(item)
        assert {m[0] for m in index.matches(text)} == want
        some += len(want)
    assert some > 20


def test_table_form_and_odd_rows(spark, docs):
    items, texts = corpus(9)
    items += [(100, None), (101, ""), (None, "alpha beta gamma"), (102, "Ünï çode words stand here now")]
    rows = texts + [(500, None), (501, ""), (None, items[5][1]), (502, "x " * 200_000 + items[5][1]), (503, "ÜNÏ ÇODE, words stand here now"), (0, texts[0][1])]
    frame = docs(rows).withColumn("matches", F.lit(1)).withColumn("_text", F.lit("no")).withColumn("item_id", F.lit(7))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    index = d.ItemIndex([(i, t or "", None) for i, t in items if i is not None])
    scores = {}
    for per_index in (20_000, 9):
        got = d.with_matches(frame, table, items_per_index=per_index)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "item_id", "matches"]
        found = sorted(((r["doc_id"], r["text"], sorted(m["item_id"] for m in r["matches"])) for r in got.collect()), key=repr)
        scores[per_index] = sorted((str(r["doc_id"]), m["item_id"], round(m["score"], 9)) for r in got.collect() for m in r["matches"])
        assert found == sorted(((i, t, sorted(m[0] for m in index.matches(t))) for i, t in rows), key=repr)


    assert scores[9] == scores[20_000]


def test_answers_are_checked(spark, docs):
    question = "what is the name of the tall red tower"
    table = spark.createDataFrame([(1, question, "it is called grandview spire")], "item_id bigint, q string, a string")
    rows = [(1, question + " it is called grandview spire"), (2, question + " nobody knows what they may have meant")]
    got = d.with_matches(docs(rows), table, question_col="q", answer_col="a")
    assert {r["doc_id"]: len(r["matches"]) for r in got.collect()} == {1: 1, 2: 0}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.with_matches(docs([(1, "a b c")]), none).collect()[0]["matches"] == []
    assert d.with_matches(docs([]), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0


def test_items_with_one_id_and_question(spark, docs):
    question = "what is the name of the tall red tower"
    table = spark.createDataFrame([(1, question, None), (1, question, "grandview spire of the north"), (1, None, "grandview spire of the north"), (1, None, None)],
                                  "item_id bigint, q string, a string")
    got = d.with_matches(docs([(1, question)]), table, question_col="q", answer_col="a").collect()
    assert [m["item_id"] for m in got[0]["matches"]] == [1]
