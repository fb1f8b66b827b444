import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, retrieval


def unit(x):
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def clustered(rng, n, dim, groups):
    middles = rng.normal(size=(groups, dim))
    return middles[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dim))


def brute(rows, queries, k, itself=False):
    ids, x = [r[0] for r in rows], unit(np.array([r[1] or [0.0] * len(rows[0][1]) for r in rows]))
    out = {}
    for q, v in queries:
        scores = np.round(x @ unit(np.array([v or [0.0] * x.shape[1]]))[0], 12) + 0.0
        out[q] = [i for _, i in sorted((-s, i) for s, i in zip(scores, ids) if not (itself and i == q))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def table(spark, rows, key="bigint", name="id"):
    return spark.createDataFrame(rows, f"{name} {key}, embedding array<double>")


@pytest.mark.parametrize("kind", ["clustered", "even", "grid"])
def test_certain_search_is_exact(spark, folder, kind, monkeypatch):
    monkeypatch.setattr(cells, "GROUP_ROWS", 40)
    monkeypatch.setattr(cells, "GROUP_QUERIES", 7)
    rng = np.random.default_rng(len(kind))
    x = {"clustered": lambda: clustered(rng, 900, 12, 15), "even": lambda: rng.normal(size=(500, 8)), "grid": lambda: rng.integers(-1, 2, (600, 4)).astype(float)}[kind]()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * x.shape[1]), (5001, None)]
    asked = [(i, rows[i][1]) for i in range(0, 400, 9)] + [(10_000, [0.0] * x.shape[1]), (10_001, (x[3] + 0.1).tolist())]
    index = cells.build_cells(table(spark, rows).repartition(3), "id", "embedding", folder("c"), rounds=3, codes=16)
    queries = table(spark, asked, name="query_id")
    assert found(cells.cells_topk(index, queries, 6)) == brute(rows, asked, 6)
    own = [a for a in asked if a[0] < 5000]
    assert found(cells.cells_topk(index, table(spark, own, name="query_id"), 6, exclude_self=True)) == brute(rows, own, 6, itself=True)


def test_share_of_the_rows_on_clustered_vectors(spark, folder):
    rng = np.random.default_rng(4)
    x = clustered(rng, 6000, 32, 60)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = rows[::60]
    index = cells.build_cells(table(spark, rows), "id", "embedding", folder("c"))
    queries = table(spark, asked, name="query_id")
    exact = retrieval.knn_join(queries, table(spark, rows), 10)
    for share in (0.05, None):
        got = cells.cells_topk(index, queries, 10, share=share)
        recall = retrieval.recall_at_k(got, exact, 10).agg(F.avg("recall")).first()[0]
        compared = got.select("query_id", "compared").distinct().agg(F.avg("compared")).first()[0] / len(rows)
        assert recall >= (0.9 if share else 1.0) and compared < 0.1


def test_text_keys(spark, folder):
    rng = np.random.default_rng(5)
    rows = [(f"doc-{i:03}", v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (200, 3)).astype(float))]
    index = cells.build_cells(table(spark, rows, "string"), "id", "embedding", folder("c"), cells=9)
    asked = rows[::20]
    assert found(cells.cells_topk(index, table(spark, asked, "string", "query_id"), 5, exclude_self=True)) == brute(rows, asked, 5, itself=True)


def test_same_table_same_index(spark, folder):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(300, 6)))]
    a, b = (cells.build_cells(table(spark, rows).repartition(n), "id", "embedding", folder(str(n))) for n in (2, 5))
    assert np.array_equal(a.cells[2], b.cells[2]) and np.array_equal(a.books, b.books)


def test_few_rows_and_empty_tables(spark, folder):
    index = cells.build_cells(table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), "id", "embedding", folder("a"))
    queries = table(spark, [(7, [1.0, 0.2]), (1, [1.0, 0.0])], name="query_id")
    assert found(cells.cells_topk(index, queries, 5)) == {7: [1, 2], 1: [1, 2]}
    assert found(cells.cells_topk(index, queries, 5, exclude_self=True)) == {7: [1, 2], 1: [2]}
    assert cells.cells_topk(index, queries.limit(0), 5).count() == 0
    empty = cells.build_cells(table(spark, []), "id", "embedding", folder("b"))
    assert cells.cells_topk(empty, queries, 5).count() == 0


def test_nearest_centres_go_tile_by_tile(monkeypatch):
    rng = np.random.default_rng(2)
    rows, centres = rng.normal(size=(500, 6)), rng.normal(size=(40, 6))
    whole = np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
    monkeypatch.setattr(cells, "TILE", 100)
    assert (cells._nearest(rows, centres) == whole).all() and len(cells._nearest(rows[:0], centres)) == 0
