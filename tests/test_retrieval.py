"""Retrieval against brute force on small vectors and texts."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.inference.models import HashedEmbedder
from tessera.operators import retrieval


def clustered(n=600, dim=32, clusters=12, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, dim))
    v = centers[rng.integers(0, clusters, n)] + 0.25 * rng.standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, vectors, key="id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<double>")


def brute(queries, corpus, k, exclude_self=False):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(queries) @ unit(corpus).T, 12) + 0.0
    out = set()
    for q, row in enumerate(scores):
        order = sorted((i for i in range(len(corpus)) if not (exclude_self and i == q)), key=lambda i: (-row[i], i))[:k]
        out |= {(q, i, round(row[i], 6), r + 1) for r, i in enumerate(order)}
    return out


def got(df):
    return {(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("path", ["queries", "corpus", "blocks"])
def test_all_paths_equal_brute_force(spark, monkeypatch, path):
    v = clustered(300)
    v[17] = v[18] = v[250]
    q, c = frame(spark, v, "query_id"), frame(spark, v)
    if path == "corpus":
        monkeypatch.setattr(retrieval, "_fits", lambda df: "id" in df.columns)
    if path == "blocks":
        out = retrieval.knn_join_blocked(q, c, 7, block_rows=70, exclude_self=True)
    else:
        out = retrieval.knn_join(q, c, 7, exclude_self=True)
    assert got(out) == brute(v, v, 7, True)


def test_copies_of_one_vector_tie_by_id(spark):
    v = np.vstack([np.tile(clustered(1), (200, 1)), clustered(100)])
    out = retrieval.knn_join_blocked(frame(spark, v[:1], "query_id"), frame(spark, v), 5, block_rows=40)
    assert [r["id"] for r in out.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_fewer_rows_than_k(spark):
    v = clustered(3)
    assert got(retrieval.knn_join(frame(spark, v, "query_id"), frame(spark, v), 10)) == brute(v, v, 10)


def test_zero_and_null_vectors_score_zero(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id bigint, embedding array<double>")
    out = retrieval.vector_topk(rows, [1.0, 0.0], 3).collect()
    assert [(r["id"], r["score"]) for r in out] == [(3, 1.0), (1, 0.0), (2, 0.0)]
    assert [r["score"] for r in retrieval.vector_topk(rows, [0.0, 0.0], 3).collect()] == [0.0] * 3


def test_wrong_dimension_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id bigint, embedding array<double>")
    with pytest.raises(Exception, match="length"):
        retrieval.vector_topk(rows, [1.0, 0.0], 3).collect()


def test_query_without_text_or_model_is_an_error(spark):
    rows = frame(spark, clustered(5))
    with pytest.raises(ValueError):
        retrieval.text_topk(rows, None, 3, HashedEmbedder(32))
    with pytest.raises(ValueError):
        retrieval.text_topk(rows, "words", 3, None)
    assert retrieval.text_topk(rows, "", 3, HashedEmbedder(32)).count() == 3


def test_filters_before_and_after(spark):
    v = clustered(200)
    rows = frame(spark, v).withColumn("email", F.concat(F.lit("p"), F.col("id"), F.lit("@x")))
    one = F.col("email") == "p150@x"
    probe = [float(x) for x in v[0]]
    assert [r["id"] for r in retrieval.vector_topk_prefilter(rows, probe, 10, one, columns=["email"]).collect()] == [150]
    assert retrieval.vector_topk_postfilter(rows, probe, 1, one, columns=["email"]).count() == 0


def test_ann_recall_on_clusters(spark):
    v = clustered(600)
    q, c = frame(spark, v[:60], "query_id"), frame(spark, v)
    exact = retrieval.knn_join(q, c, 10)
    approximate = retrieval.ann_topk(q, c, 10, bits=5, tables=10, block_rows=50)
    recall = retrieval.recall_at_k(approximate, exact, 10).agg(F.avg("recall")).first()[0]
    share = approximate.select("query_id", "candidates").distinct().agg(F.avg("candidates")).first()[0] / (10 * 600)
    assert recall >= 0.8 and share < 0.5


def test_ann_hot_bucket_is_split_and_stays_whole(spark):
    v = np.vstack([np.tile(clustered(1), (300, 1)), clustered(300)])
    out = retrieval.ann_topk(frame(spark, v[:2], "query_id"), frame(spark, v), 4, bits=3, tables=3, block_rows=25)
    assert [r["id"] for r in out.where("query_id = 0").orderBy("rank").collect()] == [0, 1, 2, 3]


def test_ann_leaves_no_query_incomplete(spark):
    v = np.random.default_rng(3).normal(size=(330, 16))
    q, c = frame(spark, v[:30], "query_id"), frame(spark, v[30:])
    out = retrieval.ann_topk(q, c, 10, bits=12, tables=2)
    assert {r["query_id"]: r["n"] for r in out.groupBy("query_id").agg(F.count("id").alias("n")).collect()} == {i: 10 for i in range(30)}
    exact = {(r["query_id"], r["id"]) for r in retrieval.knn_join(q, c, 10).collect()}
    searched = [(r["query_id"], r["id"]) for r in out.where("candidates = 300").collect()]
    assert len(searched) > 200 and exact.issuperset(searched)
    few = retrieval.ann_topk(q, c.limit(4), 10, bits=4, tables=2)
    assert few.count() == 30 * 4


def bm25(texts, terms, k1=1.2, b=0.75):
    docs = [t.lower().split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        s = 0.0
        for t in terms:
            df = sum(t in x for x in docs)
            tf = d.count(t)
            s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
        if any(t in d for t in terms):
            out[i] = round(s, 12)
    return out


TEXTS = ["red fox runs", "blue fox sleeps all day long", "no animal here", "fox fox fox", "Red sky", "", "sky sky red red"]


def test_keyword_scores(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    rows = retrieval.keyword_topk(df, "red FOX red", 10).collect()
    want = bm25(TEXTS, ["red", "fox"])
    assert {r["id"]: r["score"] for r in rows} == pytest.approx(want, abs=1e-11) and rows[0]["total"] == len(want)
    assert retrieval.keyword_topk(df, "zebra", 3).count() == 0
    assert retrieval.keyword_topk(df, "?!", 3).count() == 0


def test_hybrid_rank_fusion(spark):
    model = HashedEmbedder(16)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    rows = retrieval.embed_text(df, "text", model)
    out = retrieval.hybrid_topk(rows, "red fox", 7, model).collect()
    near = {r["id"]: r["score"] for r in retrieval.text_topk(rows, "red fox", 7, model).collect()}
    words = bm25(TEXTS, ["red", "fox"])
    rank = lambda d: {i: n + 1 for n, (i, _) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0])))}
    rn, rw = rank(near), rank(words)
    want = {i: round(1 / (60 + rn[i]) + (1 / (60 + rw[i]) if i in rw else 0), 12) for i in near}
    assert {r["id"]: r["score"] for r in out} == pytest.approx(want, abs=1e-11)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fusion_equals_full_ranking(spark, seed):
    """Many ties and one row that is good in one list and far down in the other."""
    rng = np.random.default_rng(seed)
    rows = [(i, float(round(rng.random(), 2)), None if rng.random() < 0.4 else float(round(rng.random(), 1))) for i in range(400)]
    rows[399] = (399, 2.0, -5.0)
    df = spark.createDataFrame(rows, "id bigint, a double, b double").repartition(5)
    rank = lambda n: {r[0]: p + 1 for p, r in enumerate(sorted((r for r in rows if r[n] is not None), key=lambda r: (-r[n], r[0])))}
    ra, rb = rank(1), rank(2)
    full = {r[0]: round(1 / (5 + ra[r[0]]) + (1 / (5 + rb[r[0]]) if r[0] in rb else 0), 12) for r in rows}
    want = sorted(full.items(), key=lambda x: (-x[1], x[0]))[:8]
    got = retrieval.reciprocal_rank_fusion(df, "id", ["a", "b"], 8, rrf_k=5).collect()
    assert [(r["id"], r["score"]) for r in got] == want


def test_index_checks(spark, folder):
    rows = frame(spark, clustered(20))
    retrieval.index_build(rows, "id", "embedding", 32, folder("index"))
    assert spark.read.parquet(folder("index")).where("abs(norm - 1) < 1e-9").count() == 20
    with pytest.raises(ValueError, match="repeated"):
        retrieval.index_build(rows.unionByName(rows), "id", "embedding", 32, folder("twice"))
    with pytest.raises(ValueError, match="length"):
        retrieval.index_build(rows, "id", "embedding", 31, folder("short"))
    counts, missing = retrieval.index_freshness(rows, rows.where("id > 2"), "id")
    assert not counts.first()["ready"] and {r["id"] for r in missing.collect()} == {0, 1, 2}


def test_ranking_tells_scores_apart_below_the_digits_of_a_report(spark):
    rows = spark.createDataFrame([(1, [1.0, 1e-4]), (2, [1.0, 0.0])], "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [r["id"] for r in retrieval.vector_topk(rows, [1.0, 0.0], 1).collect()] == [2]
    assert [r["id"] for r in retrieval.knn_join(asked, rows, 1).collect()] == [2]
    assert [r["id"] for r in retrieval.knn_join_blocked(asked, rows, 1).collect()] == [2]


def test_blocked_join_sends_a_row_to_a_bounded_number_of_groups(spark, monkeypatch):
    def sizes(*_):
        return lambda left, right: pa.table({"query_id": pa.array([left.num_rows]), "id": pa.array([right.num_rows]), "score": [0.0]})

    monkeypatch.setattr(retrieval, "_block_kernel", sizes)
    monkeypatch.setattr(retrieval, "_final", lambda matches, k: matches)
    v = np.ones((600, 4))
    met = retrieval.knn_join_blocked(frame(spark, v, "query_id"), frame(spark, v), 3, block_rows=5).collect()
    assert sum(r["query_id"] for r in met) + sum(r["id"] for r in met) <= 2 * 600 * retrieval.SIDE_GROUPS
    # beyond that, a group has a bounded number of numbers
    assert retrieval._group_rows(10 ** 9, 64, 1000) * 64 <= retrieval.GROUP_CELLS


def test_blocked_join_of_groups_of_several_tiles(spark):
    v = np.random.default_rng(5).normal(size=(300, 6))
    rows = frame(spark, v).unionByName(spark.createDataFrame([(900 + i, None) for i in range(40)], "id bigint, embedding array<double>"))
    asked = rows.withColumnRenamed("id", "query_id")
    few, many = (sorted(map(tuple, retrieval.knn_join_blocked(asked, rows, 4, block_rows=n, exclude_self=True).collect())) for n in (3, 1000))
    assert few == many and len(few) == 340 * 4
