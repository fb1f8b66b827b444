"""Properties of chunking, numbering, percentiles and masking on generated input."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.chunks import recursive_split
from tessera.operators import aggregates, documents, ranking
from tessera.operators import pii as ops

TEXT = st.text(alphabet="ab c\n", max_size=200)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(2, 30), st.integers(0, 10))
def test_chunks_fit_cover_and_keep_order(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = recursive_split(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for c in chunks:
        start = text.find(c, max(0, at - 1 - overlap))
        assert start >= 0
        at = max(at, start)
    left = list("".join(text.split()))
    joined = "".join("".join(c.split()) for c in chunks)
    if overlap == 0:
        assert list(joined) == left
    else:
        assert len(joined) >= len(left)


def test_chunk_of_one_long_word():
    assert recursive_split("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert recursive_split("a b c d e f", 5, 2) == ["a b c", "c d", "d e", "e f"]
    assert recursive_split("p one\n\np two\nx", 8, 0) == ["p one", "p two", "x"]


def test_window_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, "one"), (3, "")], "id int, text string")
    rows = [(r["id"], r["chunk"]) for r in documents.window_chunk(df, "id", "text", 4, 1).orderBy("id", "chunk_no").collect()]
    assert rows == [(1, "0 1 2 3"), (1, "3 4 5 6"), (1, "6 7 8 9"), (2, "one"), (3, "")]


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_running_values_equal_a_plain_loop(spark, partitions):
    rng = random.Random(5)
    data = [(i, rng.choice([7, 7, 7, rng.randint(0, 50)]), rng.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, k int, x int").repartition(6)
    out = ranking.global_running(df, [F.col("k"), F.col("id")], {"total": F.col("x")}, "n", {"top": F.col("x")}, partitions)
    got = {r["id"]: (r["n"], r["total"], r["top"]) for r in out.collect()}
    total, top = 0, -99
    for n, (i, _, x) in enumerate(sorted(data, key=lambda r: (r[1], r[0])), 1):
        total, top = total + x, max(top, x)
        assert got[i] == (n, total, top)


def test_running_values_of_other_types_and_nulls(spark):
    import datetime as dt
    from decimal import Decimal

    rng = random.Random(8)
    day = dt.datetime(2024, 1, 1)
    data = [(i, rng.choice([None, rng.random()]) if i > 40 else None, rng.choice([None, Decimal(rng.randrange(1000)) / 100]),
             rng.choice([None, day + dt.timedelta(minutes=rng.randrange(9999))]), rng.choice([None, rng.choice("abcdef")])) for i in range(200)]
    df = spark.createDataFrame(data, "id int, x double, d decimal(9,2), t timestamp, `a b` string").repartition(5)
    for frame in (df, df.select("id", "x", "d", F.col("t").cast("timestamp_ntz").alias("t"), "a b")):
        out = ranking.global_running(frame, [F.col("id")], {"sx": F.col("x"), "sd": F.col("d")}, None, {"mt": F.col("t"), "ms": F.col("a b")}, 7)
        total = lambda a, b: a if b is None else b if a is None else a + b
        most = lambda a, b: a if b is None else b if a is None else max(a, b)
        state = [None] * 4
        for r, (i, x, d, t, s) in zip(out.orderBy("id").collect(), data):
            state = [total(state[0], x), total(state[1], d), most(state[2], t), most(state[3], s)]
            assert (r["sx"] is None) == (state[0] is None) and abs((r["sx"] or 0) - (state[0] or 0)) < 1e-9
            assert (r["sd"], r["mt"], r["ms"], r["a b"]) == (*state[1:], s)
    assert ranking.global_running(df.limit(0), [F.col("id")], {"sx": F.col("x")}, "n").count() == 0


@pytest.mark.parametrize("kind", ["linear", "nearest"])
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_percentiles_are_exact(spark, kind, accuracy):
    """With a coarse sketch the band path does the work; one value holds a third of the hot group."""
    rng = np.random.default_rng(1)
    hot = np.concatenate([np.full(1000, 5.0), rng.normal(5, 3, 2000).round(2)])
    groups = {"hot": hot, "small": np.array([3.0, 1.0, 2.0]), "one": np.array([4.0]), "mid": rng.random(301)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    ps = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    rows = aggregates.exact_percentiles(df, ["g"], ["v"], ps, kind, accuracy).collect()
    assert len(rows) == len(groups) * len(ps)
    for r in rows:
        s = sorted(groups[r["g"]])
        at = r["p"] * (len(s) - 1)
        want = np.quantile(s, r["p"]) if kind == "linear" else s[max(0, min(len(s) - 1, int(round(at))))]
        assert r["value"] == pytest.approx(want, abs=1e-9)


def test_sketch_is_near_the_exact_percentile(spark):
    df = spark.range(50_000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    got = aggregates.approx_latency_percentiles(df, ["g"], ["v"], [0.5, 0.99]).first()
    assert abs(got["v_p50"] - 25_000) <= 10 and abs(got["v_p99"] - 49_500) <= 10


def test_carry_forward_across_blocks(spark):
    rows = [(d, i, f"h{i}" if i % 37 == 5 else None) for d in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc int, pos int, header string")
    out = ranking.section_carry_forward(df, "doc", "pos", "header", block=10).collect()
    for r in out:
        heads = [i for i in range(r["pos"] + 1) if i % 37 == 5]
        assert r["section"] == (f"h{heads[-1]}" if heads else None)


def test_masked_text_holds_no_detected_value(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from tessera.functions import pii

    found = ops.pii_salt(ops.pii_detect(docs, "text")).withColumn("masked", pii.mask(F.col("text"), F.col("entities")))
    left = found.where(F.exists("entities", lambda e: F.contains(F.col("masked"), e["original_value"])))
    assert left.count() == 0 and found.where("size(entities) > 0").count() > 0


def test_micro_is_the_pooled_count(spark):
    df = spark.createDataFrame([(3, 1, 0, 0.75, 1.0, 0.857), (0, 2, 4, 0.0, 0.0, 0.0)],
                               "tp int, fp int, fn int, precision double, recall double, f1 double")
    got = aggregates.micro_macro_prf(df).first()
    assert got["micro_precision"] == 0.5 and got["micro_recall"] == pytest.approx(3 / 7)
    assert got["macro_precision"] == 0.375


def test_typed_agg_kinds(spark):
    rows = [("b", True, None, None), ("b", False, None, None), ("n", None, 1.0, None), ("n", None, 2.0, None), ("t", None, None, "1"),
            ("t", None, None, "x"), ("s", None, None, "z"), ("s", None, None, "y"), ("empty", None, None, None)]
    df = spark.createDataFrame(rows, "name string, bool_value boolean, num_value double, str_value string")
    assert {r["name"]: r["value"] for r in aggregates.typed_agg(df).collect()} == {
        "b": "0.5000", "n": "1.5000", "t": "1.0000", "s": "y"}


def test_agreement_with_a_missing_side(spark):
    full = spark.createDataFrame([(0.5, 4.0)], "accuracy double, docs_per_s double")
    none = full.where("accuracy > 1")
    both = lambda a, b: tuple(aggregates.agreement_ratio(a, b).first())
    assert both(full, none) == (-0.5, 0.0) and both(none, full) == (0.5, 4.0)


def test_stratified_sample_needs_enough_rows(spark):
    df = spark.createDataFrame([(i, "ab"[i > 2]) for i in range(12)], "id int, label string")
    assert ranking.stratified_sample(df, "label", "id", 3).groupBy("label").count().where("count = 3").count() == 2
    with pytest.raises(ValueError):
        ranking.stratified_sample(df, "label", "id", 4)


def pooled(pred, gold):
    """The matching rule as a plain loop."""
    plain = lambda v: v.lower().strip().replace("-", "").replace(" ", "")
    free, tp = list(range(len(gold))), 0
    for kind, value in pred:
        hit = next((j for j in free if (gold[j][0] in (kind, "OTHER"))
                    and (plain(value) in plain(gold[j][1]) or plain(gold[j][1]) in plain(value))), None)
        if hit is not None:
            free.remove(hit)
            tp += 1
    return tp, len(pred) - tp, len(free)


def test_match_equals_a_plain_loop(spark):
    from tessera.functions import pii

    rng = random.Random(11)
    entity = lambda: (rng.choice(["PERSON", "EMAIL", "OTHER"]), "".join(rng.choice("ab -") for _ in range(rng.randint(0, 4))))
    rows = [(i, [entity() for _ in range(rng.randint(0, 6))], [entity() for _ in range(rng.randint(0, 6))]) for i in range(400)]
    ddl = "array<struct<type string, value string>>"
    df = spark.createDataFrame(rows, f"id int, p {ddl}, g {ddl}")
    got = {r["id"]: tuple(r["m"]) for r in df.select("id", pii.match(F.col("p"), F.col("g")).alias("m")).collect()}
    assert got == {i: pooled(p, g) for i, p, g in rows}


def test_mask_equals_a_plain_loop(spark):
    from tessera.functions import pii

    rng = random.Random(12)
    rows = []
    for i in range(300):
        text = "".join(rng.choice("ab01 _") for _ in range(40))
        values = [text[s:s + rng.randint(1, 5)] for s in (rng.randint(0, 35) for _ in range(4))] + ["001"]
        rows.append((i, text, [(rng.choice(["A", "B"]), v, f"X_{n:03d}") for n, v in enumerate(values)]))
    df = spark.createDataFrame(rows, "id int, text string, es array<struct<entity_type string, original_value string, salt_id string>>")
    got = {r["id"]: r["m"] for r in df.select("id", pii.mask(F.col("text"), F.col("es")).alias("m")).collect()}
    for i, text, es in rows:
        for _, v, s in sorted(es, key=lambda e: -len(e[1])):
            text = text.replace(v, s)
        assert got[i] == text
