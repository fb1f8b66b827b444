import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import forest
from tessera.llm.queries import op2_nearest

ASK = F.col("vec_id") % 20 == 0


def exact(rows, k, ask=lambda i: i % 20 == 0):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in good if ask(i)}:
        best = {}
        for qi, qv in good:
            for i, v in good if qi == q else ():
                if i != q and len(v) == len(qv):
                    best[i] = max(best.get(i, -np.inf), float(v @ qv))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def test_recall_and_scores_against_brute_force(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/../sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in op2_nearest(spark, f"{sf}/../sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([i for i, _ in rows])
    vecs = np.array([v for _, v in rows], float)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        scores = vecs @ vecs[np.flatnonzero(ids == q)[0]]
        of = dict(zip(ids.tolist(), scores))
        assert all(abs(of[v] - s) < 1e-12 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        true = sorted((i for i in of if i != q), key=lambda i: (-of[i], i))[:20]
        hits += len({f[1] for f in found} & set(true))
    assert len(got) == sum(i % 20 == 0 for i in ids) and hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("share", [1.0])
def test_whole_search_is_exact_with_odd_rows(spark, share, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_ROWS", 16)
    monkeypatch.setattr(forest, "LEAF_QUERIES", 5)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(90)] + [(None, [1.0, 1.0, 1.0]), (2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [1.0, None, 0.0]),
             (2060, [float("nan"), 1.0, 0.0]), (2080, [float("inf"), 0.0, 0.0]), (2100, [1.0]), (2120, []), (40, rows[40][1]), (60, [3.0, 3.0, 3.0])]
    rows = [r for r in rows]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("x")).withColumn("vec", F.lit(1)).withColumn("leaf", F.lit(2))
    got = {}
    for r in forest.nearest_neighbours(frame, ASK, k=7, trees=3, depth=3, share=share + 1).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact([r for r in rows if r[1] is None or len(r[1]) == 3], 7)
    assert {q: [(-s, i) for s, i in w] for q, w in want.items()} == {q: [(s, i) for _, i, s in sorted(f)] for q, f in got.items()}


def test_empty_and_few(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert forest.nearest_neighbours(frame, ASK).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [2.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in forest.nearest_neighbours(few, ASK).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0)]


def test_ties_of_many_vectors_go_to_the_smaller_ids(spark):
    """Far more different vectors than 2 (k + 1) have the same product with the query."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(i * 7919 % 401), float(i * 31 % 17 - 8)]) for i in range(1, 400)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = forest.nearest_neighbours(table, F.col("vec_id") == 0, k=5, trees=2, depth=1, share=1.0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1.0) for i in range(1, 6)]


def test_vectors_meet_those_of_their_length(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=(3, 3, 3, 2)[i % 4]).tolist()) for i in range(200)] + [(40, [0.5, 0.25]), (1, [1.0, 2.0])]
    got = {}
    for r in forest.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), ASK, k=6, trees=2, depth=1, share=2.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    # an id with vectors of both lengths is a query with each
    want = exact(rows, 6)
    assert {q: [(n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(w)] for q, w in want.items()} == {q: sorted(f) for q, f in got.items()}
