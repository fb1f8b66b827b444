"""Subsets by scale, splits per label, and searches with text keys."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking, retrieval


def test_scales_take_the_first_rows_by_id(spark):
    ids = random.Random(1).sample(range(10_000), 700)
    frame = spark.createDataFrame([(i, f"x{i}") for i in ids], "id bigint, scale_of string").repartition(7)
    got = ranking.scale_subsets(frame, "id", [5, 100, 5000]).collect()
    for n in (5, 100, 5000):
        assert sorted(r["id"] for r in got if r["scale"] == n) == sorted(ids)[:n]
    assert ranking.scale_subsets(frame.limit(0), "id", [5]).count() == 0


def test_splits_do_not_overlap_and_miss_no_label(spark):
    frame = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)] + [(1000, None)], "id bigint, label string")
    got = ranking.stratified_split(frame, "label", "id", 4, 7).collect()
    assert len({r["id"] for r in got}) == len(got) == 33
    assert {(x, s): sum(r["label"] == x and r["split"] == s for r in got) for x in "abc" for s in ("train", "test")} == {
        **{(x, "train"): 4 for x in "abc"}, **{(x, "test"): 7 for x in "abc"}}
    again = ranking.stratified_split(frame.repartition(5), "label", "id", 4, 7).collect()
    other = ranking.stratified_split(frame, "label", "id", 4, 7, seed=2).collect()
    assert set(again) == set(got) != set(other)
    with pytest.raises(ValueError, match="d"):
        ranking.stratified_split(frame, "label", "id", 4, 7, labels=["a", "d"])
    with pytest.raises(ValueError, match="a, b, c"):
        ranking.stratified_split(frame, "label", "id", 20, 20)


@pytest.mark.parametrize("exclude", [False, True])
def test_text_keys_give_the_result_of_numbers(spark, exclude):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(120)]
    plain = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    text = plain.withColumn("id", F.format_string("k%05d", "id"))
    ask = lambda df, keys: df.where(F.col("id").isin(keys)).withColumnRenamed("id", "query_id")
    want = [(f"k{r['query_id']:05d}", f"k{r['id']:05d}", r["score"], r["rank"]) for r in
            retrieval.knn_join(ask(plain, [5, 50]), plain, 7, exclude_self=exclude).collect()]
    got = [tuple(r) for r in retrieval.knn_join(ask(text, ["k00005", "k00050"]), text, 7, exclude_self=exclude).collect()]
    assert sorted(got) == sorted(want)
    mixed = retrieval.knn_join(ask(plain, [5, 50]), text, 7).collect()
    assert len(mixed) == 14 and {type(r["query_id"]) for r in mixed} == {int}
