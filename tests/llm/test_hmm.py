import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hmm


def slow_likelihood(model, seq):
    """Sum over all state paths."""
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        total += p
    return math.log10(total)


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    model = hmm.Hmm.random(3, rng.random(5) + 0.1, 2)
    texts = [rng.integers(0, 5, n) for n in (4, 1, 6, 2, 6)]
    assert np.allclose(model.log10_likelihood(texts), [slow_likelihood(model, t) for t in texts])


@pytest.mark.parametrize("wave", [1, 2, 3, 64])
def test_expected_counts_match_path_sums(wave, monkeypatch):
    rng = np.random.default_rng(3)
    model = hmm.Hmm.random(2, rng.random(4) + 0.1, 5)
    texts = [rng.integers(0, 4, n) for n in (5, 3, 1)]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for seq in texts:
        paths = {}
        for path in itertools.product(range(2), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
            paths[path] = p
        whole = sum(paths.values())
        for path, p in paths.items():
            start[path[0]] += p / whole
            for t, s in enumerate(path):
                emit[seq[t], s] += p / whole
                if t:
                    move[path[t - 1], s] += p / whole
    sizes = np.array([len(t) for t in texts])
    monkeypatch.setattr(hmm, "WAVE", wave)
    got = model.counts(np.concatenate(texts[::-1]), np.array([4, 1, 0]), sizes)
    assert np.allclose(got[0], start) and np.allclose(got[1], move) and np.allclose(got[2], emit)
    assert np.isclose(got[3], sum(slow_likelihood(model, t) for t in texts))


def slow_round(model, texts):
    """One round of Baum-Welch over whole texts, step by step, with the floors of the training."""
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    for seq in texts:
        a = [model.start * model.emit[seq[0]]]
        for s in seq[1:]:
            a.append((a[-1] / a[-1].sum() @ model.move) * model.emit[s])
        a = [x / x.sum() for x in a]
        b = [np.ones(k)]
        for s in seq[:0:-1]:
            x = model.move @ (model.emit[s] * b[0])
            b.insert(0, x / x.sum())
        for t, s in enumerate(seq):
            g = a[t] * b[t]
            emit[s] += g / g.sum()
            if t:
                x = a[t - 1][:, None] * model.move * model.emit[s] * b[t]
                move += x / x.sum()
            else:
                start += g / g.sum()
    start, move, emit = start + 0.1, move + 0.1, emit + 0.01
    return hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


@pytest.mark.parametrize("sizes", [{"own_words": 5, "classes": 3}, {"own_words": 20_000, "classes": 2}])
def test_scores_of_the_trained_model_against_a_plain_one(docs, sizes, monkeypatch):
    """The whole way: symbols, word classes, training over whole texts longer than a stretch, and the score of each text."""
    monkeypatch.setattr(hmm, "SIDE_TOKENS", 300)
    own, classes = sizes["own_words"], sizes["classes"]
    rows = [(i, " ".join(random.Random(i).choices(["the", "cat", "Dog", "sat", "on", "mat."] + [f"r{i % 9}{j}" for j in range(4)], k=[3, 40, 200][i % 3]))) for i in range(40)]
    kept = train_rows(rows)
    counts = Counter(w for _, t in kept for w in words(t))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    first, kind = {w: n for n, w in enumerate(order[:own])}, lambda w: zlib.crc32(w[-3:]) % classes
    own = len(first)
    inside = [[counts[w] for w in order[own:] if kind(w) == c] for c in range(classes)]
    symbol = lambda w: first.get(w, own + kind(w))
    seq = lambda t: [*map(symbol, words(t)), own + classes]
    texts = [seq(t) for _, t in kept]
    unigram = np.bincount(np.concatenate(texts), minlength=own + classes + 1) + 0.1
    model = hmm.Hmm.random(2, unigram / unigram.sum())
    for _ in range(3):
        model = slow_round(model, texts)
    got = {r["doc_id"]: r["score"] for r in scored(docs, rows, states=2, rounds=3, **sizes)}
    for i, t in rows:
        want = model.log10_likelihood([np.array(seq(t))])[0]
        want += sum(math.log10((counts[w] + 1) / (sum(inside[kind(w)]) + len(inside[kind(w)]) + 1)) for w in words(t) if w not in first)
        assert abs(got[i] - want) < 1e-6 * abs(want)


ROWS = [(i, " ".join(random.Random(i).choices(["the", "cat", "Dog", "sat", "on", "É", "mat."] + [f"r{i % 9}{j}" for j in range(4)], k=i % 23))) for i in range(90)]
ROWS += [(200, None), (201, ""), (202, " \n"), (None, "the cat"), (203, "new words " * 30_000), (5, ROWS[5][1]), (204, "w" * 500 + " the"), (206, "w" * 500 + " the")]


def train_rows(rows):
    return [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]


def words(t):
    return (t or "").encode().lower().split()


def scored(docs, rows, **more):
    frame = docs(rows).withColumn("row", F.lit("x")).withColumn("train", F.lit(3)).withColumn("word", F.lit(1))
    return hmm.score_texts(frame, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True)), **more).collect()


@pytest.mark.parametrize("sizes", [{}, {"own_words": 4, "sent_words": 6, "classes": 3}, {"own_words": 0, "sent_words": 0, "classes": 2}])
def test_counts_and_base_score(docs, sizes):
    counts = Counter(w for _, t in train_rows(ROWS) for w in words(t))
    counts["END"] = len(train_rows(ROWS))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in ROWS:
        tokens = [*words(t), "END"]
        want.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored(docs, ROWS, states=2, rounds=1, **sizes)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_score_is_a_distribution(docs):
    """Over the words of a closed vocabulary and the end, the probabilities of all texts of up to two words add up with the rest."""
    rows = [(i, " ".join(random.Random(i).choices(["aa", "bb", "cc", "dd"], k=3))) for i in range(40)]
    vocabulary = ["aa", "bb", "cc", "dd", "zz"]
    asked = [(1000 + n, " ".join(w)) for n, w in enumerate(w for k in range(3) for w in itertools.product(vocabulary, repeat=k))]
    frame = docs(rows + asked)
    got = hmm.score_texts(frame, F.col("doc_id") < 1000, own_words=2, sent_words=3, classes=1, states=2, rounds=2).where("doc_id >= 1000").collect()
    mass = Counter()
    for r in got:
        mass[r["n_tokens"]] += 10 ** r["score"]
    assert 0 < mass[1] < 1 and 0 < sum(mass.values()) < 1.0001


def test_training_beats_the_unigram_on_held_out_text(spark, docs):
    rng = random.Random(8)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(rng.choice([a, b]), k=40))) for i in range(400)]
    got = scored(docs, rows, states=3, rounds=6)
    held = [r for r in got if not r["is_training"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.9


def test_nothing_to_learn_and_empty(docs):
    got = hmm.score_texts(docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert hmm.score_texts(docs([]), F.lit(True)).count() == 0
