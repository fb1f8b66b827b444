import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

DDL = "vec_id bigint, embedding array<float>, label int"
ASK = F.col("vec_id") % 10 == 0


def brute(rows, every=10):
    used = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256.0 * float(np.float32(x))) for x in v])
        used[i] = min(used.get(i, row), row)
    out = []
    for a, (label, x) in used.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, own) for i, (own, y) in used.items() if i != a and len(y) == len(x))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            inside = [(t, i) for t, i, own in scored if own != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside)]
    return sorted(out)


def check(spark, rows, monkeypatch, parts=3, block=64):
    monkeypatch.setattr(negatives, "BLOCK", block)
    frame = spark.createDataFrame(rows, DDL).withColumn("x", F.lit("x")).withColumn("score", F.lit(1)).repartition(parts)
    found = negatives.hard_negatives(frame, ASK)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == brute(rows)


@pytest.mark.parametrize("dim", [1, 2, 8])
def test_against_all_pairs(spark, monkeypatch, dim):
    rng = np.random.default_rng(dim)
    middles = rng.normal(size=(6, dim))
    rows = [(i, (middles[i % 6] + 0.2 * rng.normal(size=dim)).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    check(spark, rows, monkeypatch)


def test_ties_and_odd_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.25, -0.25, 0.5]) for _ in range(3)], rng.randrange(2)) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.0], i % 3) for i in range(120)]
    rows += [(None, [0.5, 0.5, 0.0], 1), (2000, None, 1), (2010, [0.5, None, 0.1], 1), (2020, [float("nan"), 0.0, 1.0], 0), (2030, [float("inf"), 0.0, 1.0], 0),
             (2040, [0.1, 0.2, 0.3], None), (2050, [], 1), (2051, [], 0), (2052, [], 1), (2060, [0.5, 0.5], 1), (2061, [0.5, 0.4], 1), (2062, [0.5, 0.45], 0), (2070, [0.0, 0.0, 0.0], 1)]
    rows += [rows[10], rows[10], (20, [0.5, 0.5, 0.5], 1)]
    check(spark, rows, monkeypatch)


def test_one_group_of_copies(spark, monkeypatch):
    check(spark, [(i, [0.3, -0.2], i % 4) for i in range(500)], monkeypatch, block=32)


def test_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 600)
    rng = np.random.default_rng(9)
    check(spark, [(i, rng.normal(size=4).tolist(), int(rng.integers(0, 3))) for i in range(150)], monkeypatch)


def test_empty_and_lone(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], DDL), ASK).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (10, [1.0], 2)], DDL), ASK).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**20 + 1, 3.0], 1), (1, [2.0**20 + 2, 1.0], 2), (2, [2.0**20 + 1, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = negatives.hard_negatives(frame, F.col("vec_id") == 0, relabel=1000).collect()  # the anchor's label becomes 2
    a = (2**20 + 1) * 256
    positive = a * (2**20 + 2) * 256 + 768 * 256
    negative = a * a + 768 * 512
    assert [(r["positive_score"], r["negative_score"]) for r in got] == [(positive, negative)]


def test_lists_stop_before_the_end():
    rng = np.random.default_rng(3)
    values = np.floor(256 * rng.normal(size=(4000, 3)))
    lists = negatives.SortedLists(np.arange(4000), np.zeros(4000, np.int64), values)
    anchor = np.array([300.0, -200.0, 10.0])
    rows, scores = lists.search(anchor, lists.bounds(anchor[None])[0], lambda f, s, most: len(s) >= 5 and most < np.sort(s)[-5])
    assert len(rows) < 1500
    assert sorted(scores, reverse=True)[:5] == sorted((values @ anchor).astype(int), reverse=True)[:5]
