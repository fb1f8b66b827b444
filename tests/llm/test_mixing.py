import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.floats(0.001, 10), min_size=1, max_size=12), st.integers(24, 200))
def test_frames_stay_within_one_block(weights, frame):
    share = mixing.quotas(weights, frame)
    places = mixing.schedule(share)
    assert sum(share.values()) == frame and sorted(p for ps in places.values() for p in ps) == list(range(frame))
    for s, ps in places.items():
        for t in range(frame + 1):
            assert abs(sum(p < t for p in ps) - Fraction(share[s] * t, frame)) < 1


@pytest.mark.parametrize("block", [1, 3])
def test_order_is_whole_and_follows_the_weights(docs, block):
    rng = random.Random(block)
    rows = [(i, "t", None, rng.choice(["a"] * 6 + ["b", "c", None, "other"])) for i in range(800)]
    weights, rest = {"a": 0.25, "b": 0.25, "c": 0.3, "missing": 0.1}, 0.1
    frame = docs(rows).withColumn("mix_slot", F.lit("old")).withColumn("_p", F.lit(0)) if block == 3 else docs(rows)
    got = mixing.mix(frame.drop("_p"), weights, rest, block=block, frame=60, classes=8).select("doc_id", "source", "mix_slot", "mix_position").collect()
    assert sorted(r["mix_position"] for r in got) == list(range(800)) and len({r["doc_id"] for r in got}) == 800
    got.sort(key=lambda r: r["mix_position"])
    assert [r["mix_slot"] for r in got] == sorted(r["mix_slot"] for r in got)
    name = lambda s: s if s in weights else "rest"
    assert all(n <= block for n in Counter(r["mix_slot"] for r in got).values())
    of = {r["mix_slot"]: name(r["source"]) for r in got}
    assert len({(r["mix_slot"], name(r["source"])) for r in got}) == len(of)
    # while the same sources have rows left, each stays within one block of its share
    left = Counter(of.values())
    shares, start, seen = {**weights, "rest": rest}, 0, Counter()
    active = {s: shares[s] for s in left}
    ids = {s: i for i, s in enumerate(sorted(weights))} | {"rest": len(weights)}
    quota = mixing.quotas({ids[s]: w for s, w in active.items()}, 60)
    for t in range(len(of)):
        seen[of[t]] += 1
        left[of[t]] -= 1
        for s in active:
            assert abs(seen[s] - Fraction(quota[ids[s]] * (t + 1 - start), sum(quota.values()))) < 1
        if not left[of[t]]:
            active, start, seen = {s: w for s, w in active.items() if left[s]}, t + 1, Counter()
            quota = mixing.quotas({ids[s]: w for s, w in active.items()}, 60) if active else {}


def test_nulls_ties_and_empty(docs):
    assert mixing.mix(docs([]), {"a": 1.0}, 1.0).count() == 0
    rows = [(None, None, None, "a"), (None, None, None, None), (1, "x", None, "a"), (1, "x", None, "a"), (1, "x", None, "b")]
    got = mixing.mix(docs(rows), {"a": 1.0}, 1.0, block=2).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(5))
    assert sorted([(r["doc_id"], r["source"]) for r in got], key=repr) == sorted([(r[0], r[3]) for r in rows], key=repr)
    with pytest.raises(ValueError):
        mixing.mix(docs(rows), {"a": 0.0}, 1.0)
