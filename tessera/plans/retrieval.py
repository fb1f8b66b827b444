"""Queries over vector, keyword and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import SCORE_DIGITS
from tessera.inference.models import HashedEmbedder
from tessera.operators import answering, cells, ranking, retrieval
from tessera.plans import sqltext
from tessera.plans.registry import query
from tessera.session import pin, scratch_path
from tessera.sources.readers import heavy_table, load_table

DIM = 64
# A fixed query vector that any engine can build: 1, -1, 2, -2, ...
QUERY = [float((i // 2 + 1) * (1 if i % 2 == 0 else -1)) for i in range(DIM)]
QUERY_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
QUESTION = "the reshen onthe und der"
VECTORS_SQL = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def shown(df, **digits):
    """Scores rounded for the report."""
    return df.withColumns({c: F.round(c, n) for c, n in (digits or {"score": SCORE_DIGITS}).items()})


def vectors(spark, sf):
    return load_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")


def label_means(spark, sf):
    """One query vector per label: the mean of its vectors, summed position by position."""
    cells = vectors(spark, sf).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    # One row per (label, position) here: 64 numbers per label.
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    return rows.select(F.col("label").cast("bigint").alias("query_id"), F.col("c.m").alias("embedding"))


MEANS_SQL = f"""{VECTORS_SQL},
 x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
 q AS (SELECT query_id, list(m ORDER BY pos) AS v FROM (
     SELECT CAST(label AS BIGINT) AS query_id, pos, round(avg(x), 9) AS m FROM x GROUP BY 1, 2) GROUP BY 1)"""

TOPK_SQL = f"""WITH {VECTORS_SQL}
SELECT id, label, {sqltext.cosine('v', QUERY_SQL)} AS score FROM e"""


@query("vector_topk", sqltext.shown(f"{TOPK_SQL} ORDER BY score DESC, id LIMIT 10", score=6))
def q_vector_topk(spark, sf):
    return shown(retrieval.vector_topk(vectors(spark, sf), QUERY, 10, columns=["label"]))


@query("vector_topk_prefilter", sqltext.shown(f"{TOPK_SQL} WHERE label = 3 ORDER BY score DESC, id LIMIT 10", score=6))
def q_prefilter(spark, sf):
    return shown(retrieval.vector_topk_prefilter(vectors(spark, sf), QUERY, 10, F.col("label") == 3, columns=["label"]))


@query("vector_topk_postfilter", sqltext.shown(f"SELECT * FROM ({TOPK_SQL} ORDER BY score DESC, id LIMIT 10) WHERE label = 3", score=6))
def q_postfilter(spark, sf):
    return shown(retrieval.vector_topk_postfilter(vectors(spark, sf), QUERY, 10, F.col("label") == 3, columns=["label"]))


@query("zero_vector_rule", "SELECT vec_id AS id, 0.0::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT 10")
def q_zero_vector(spark, sf):
    return shown(retrieval.vector_topk(vectors(spark, sf), [0.0] * DIM, 10))


@query("embed_text", f"""
WITH {sqltext.embed('d', 'documents', 'doc_id', 'text')}
SELECT key AS doc_id, CAST(len(v) AS INTEGER) AS dim, round(sqrt(list_dot_product(v, v)), 6) AS norm,
       round(list_dot_product(v, {QUERY_SQL}), 6) AS probe FROM d""")
def q_embed_text(spark, sf):
    from tessera.functions.vectors import dot, norm

    out = retrieval.embed_text(heavy_table(spark, sf, "documents").select("doc_id", "text"), "text", dim=DIM)
    probe = dot(F.col("embedding"), F.array(*[F.lit(x) for x in QUERY]))
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("norm"),
                      F.round(probe, 6).alias("probe"))


@query("text_topk", sqltext.shown(f"""
WITH {sqltext.embed('d', 'documents', 'doc_id', 'text')},
 {sqltext.embed('q', f"(SELECT 0 AS qid, '{QUESTION}' AS text)", 'qid', 'text')}
SELECT d.key AS doc_id, source, {sqltext.cosine('d.v', 'q.v')} AS score
FROM d JOIN documents ON doc_id = d.key, q WHERE lang <> 'fr' ORDER BY score DESC, doc_id LIMIT 10""", score=6))
def q_text_topk(spark, sf):
    docs = heavy_table(spark, sf, "documents").where("lang <> 'fr'")
    corpus = retrieval.embed_text(docs, "text", HashedEmbedder(DIM))
    return shown(retrieval.text_topk(corpus, QUESTION, 10, HashedEmbedder(DIM), id_col="doc_id", columns=["source"]))


@query("scan_all", "SELECT vec_id AS id, label FROM embeddings")
def q_scan_all(spark, sf):
    return retrieval.scan_all(vectors(spark, sf).select("id", "label"))


@query("keyword_topk", sqltext.shown(f"""
WITH {sqltext.bm25('b', 'documents', 'doc_id', 'text', QUESTION.split())}
SELECT key AS doc_id, score, (SELECT count(*) FROM b) AS total FROM b ORDER BY score DESC, key LIMIT 6""", score=6))
def q_keyword_topk(spark, sf):
    return shown(retrieval.keyword_topk(heavy_table(spark, sf, "documents"), QUESTION, 6, "doc_id"))


@query("hybrid_topk", sqltext.shown(f"""
WITH {sqltext.embed('d', 'documents', 'doc_id', 'text')},
 {sqltext.embed('q', f"(SELECT 0 AS qid, '{QUESTION}' AS text)", 'qid', 'text')},
 {sqltext.bm25('b', 'documents', 'doc_id', 'text', QUESTION.split())},
 s AS (SELECT d.key, {sqltext.cosine('d.v', 'q.v')} AS score FROM d, q),
 sr AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS r FROM s),
 br AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS r FROM b)
SELECT sr.key AS doc_id, sr.score AS vector_score, br.score AS keyword_score,
       round(1.0 / (60 + sr.r) + coalesce(1.0 / (60 + br.r), 0), 12) AS score
FROM sr LEFT JOIN br USING (key) ORDER BY 4 DESC, 1 LIMIT 10""", vector_score=6, keyword_score=6, score=9))
def q_hybrid(spark, sf):
    corpus = retrieval.embed_text(heavy_table(spark, sf, "documents").select("doc_id", "text"), "text", HashedEmbedder(DIM))
    return shown(retrieval.hybrid_topk(corpus, QUESTION, 10, HashedEmbedder(DIM), id_col="doc_id"), vector_score=6, keyword_score=6, score=9)


@query("knn_join", sqltext.shown(f"""
WITH {MEANS_SQL}
SELECT query_id, e.id, {sqltext.cosine('q.v', 'e.v')} AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY {sqltext.cosine('q.v', 'e.v')} DESC, e.id) AS INTEGER) AS rank
FROM q, e QUALIFY rank <= 10""", score=6))
def q_knn_join(spark, sf):
    return shown(retrieval.knn_join(label_means(spark, sf), vectors(spark, sf), 10))


@query("knn_join_text_keys", sqltext.shown(f"""
WITH {VECTORS_SQL}, k AS (SELECT 'v' || id AS id, v FROM e)
SELECT q.id AS query_id, k.id, {sqltext.cosine('q.v', 'k.v')} AS score,
       CAST(row_number() OVER (PARTITION BY q.id ORDER BY {sqltext.cosine('q.v', 'k.v')} DESC, k.id) AS INTEGER) AS rank
FROM k q JOIN k ON q.id <> k.id AND q.id LIKE '%00' QUALIFY rank <= 10""", score=6))
def q_knn_text_keys(spark, sf):
    """Keys as an index of documents stores them."""
    rows = vectors(spark, sf).select(F.concat(F.lit("v"), "id").alias("id"), "embedding")
    queries = rows.where("id like '%00'").select(F.col("id").alias("query_id"), "embedding")
    return shown(retrieval.knn_join(queries, rows, 10, exclude_self=True))


@query("knn_join_blocked", sqltext.shown(f"""
WITH {VECTORS_SQL}
SELECT q.id AS query_id, e.id, {sqltext.cosine('q.v', 'e.v')} AS score,
       CAST(row_number() OVER (PARTITION BY q.id ORDER BY {sqltext.cosine('q.v', 'e.v')} DESC, e.id) AS INTEGER) AS rank
FROM e q JOIN e ON q.id <> e.id QUALIFY rank <= 10""", score=6))
def q_knn_blocked(spark, sf):
    rows = vectors(spark, sf)
    queries = rows.select(F.col("id").alias("query_id"), "embedding")
    return shown(retrieval.knn_join_blocked(queries, rows, 10, exclude_self=True, block_rows=1000))


@query("ann_topk", sqltext.shown(f"""
WITH {VECTORS_SQL},
 pl AS (SELECT t, b, list(CASE WHEN substr(md5('7-' || t || '-' || b || '-' || d), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS p
        FROM range(8) x(t), range(4) y(b), range(64) z(d) GROUP BY 1, 2),
 h AS (SELECT id, t, sum(CASE WHEN list_dot_product(v, p) > 0 THEN 1 << b ELSE 0 END) AS code FROM e, pl GROUP BY 1, 2),
 n AS (SELECT t, code, count(*) AS n FROM h GROUP BY 1, 2),
 cand AS (SELECT h.id AS query_id, CAST(sum(n) AS BIGINT) AS candidates FROM h JOIN n USING (t, code) GROUP BY 1),
 pr AS (SELECT DISTINCT a.id AS query_id, b.id FROM h a JOIN h b ON a.t = b.t AND a.code = b.code AND a.id <> b.id)
SELECT query_id, id, {sqltext.cosine('q.v', 'r.v')} AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY {sqltext.cosine('q.v', 'r.v')} DESC, id) AS INTEGER) AS rank, candidates
FROM (SELECT pr.query_id, pr.id, candidates FROM pr JOIN cand USING (query_id)) JOIN e r USING (id) JOIN (SELECT id AS query_id, v FROM e) q USING (query_id)
QUALIFY rank <= 10""", score=6))
def q_ann(spark, sf):
    rows = vectors(spark, sf)
    queries = rows.select(F.col("id").alias("query_id"), "embedding")
    return shown(retrieval.ann_topk(queries, rows, 10, bits=4, tables=8, exclude_self=True))


@query("ann_cells", sqltext.shown(f"""
WITH {VECTORS_SQL}
SELECT q.id AS query_id, e.id, {sqltext.cosine('q.v', 'e.v')} AS score,
       CAST(row_number() OVER (PARTITION BY q.id ORDER BY {sqltext.cosine('q.v', 'e.v')} DESC, e.id) AS INTEGER) AS rank
FROM e q JOIN e ON q.id <> e.id AND q.id % 100 = 0 QUALIFY rank <= 10""", score=6))
def q_ann_cells(spark, sf):
    """The index of cells searched until its bounds say that the result is exact."""
    rows = vectors(spark, sf)
    index = cells.build_cells(rows, "id", "embedding", scratch_path(spark, "cells"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return shown(cells.cells_topk(index, queries, 10, exclude_self=True).drop("compared"))


@query("ann_cells_recall")
def q_ann_cells_recall(spark, sf):
    """Recall of the nearest cells with a tenth of the documents, and the part of the documents that is compared, per query."""
    docs = heavy_table(spark, sf, "documents").select("doc_id", "text")
    known = pin(retrieval.embed_text(docs, "text", dim=DIM).select(F.col("doc_id").alias("id"), "embedding"))
    queries = known.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = cells.build_cells(known, "id", "embedding", scratch_path(spark, "cells"))
    near = pin(cells.cells_topk(index, queries, 10, share=0.1))
    compared = near.select("query_id", "compared").distinct()
    recall = retrieval.recall_at_k(near, retrieval.knn_join(queries, known, 10), 10)
    return recall.join(compared, "query_id").select(
        "query_id", "recall", (F.col("compared") / F.lit(known.count())).alias("share"))


def signs(column):
    """Vectors reduced to the sign of each number."""
    return F.transform(column, lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0)))


@query("recall_at_k", f"""
WITH {MEANS_SQL},
 b AS (SELECT id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM e),
 p AS (SELECT query_id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM q),
 ex AS (SELECT query_id, e.id FROM q, e
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {sqltext.cosine('q.v', 'e.v')} DESC, e.id) <= 10),
 ap AS (SELECT query_id, b.id FROM p, b
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {sqltext.cosine('p.v', 'b.v')} DESC, b.id) <= 10)
SELECT ex.query_id, count(ap.id) / 10 AS recall FROM ex LEFT JOIN ap USING (query_id, id) GROUP BY 1""")
def q_recall(spark, sf):
    queries, rows = label_means(spark, sf), vectors(spark, sf)
    exact = retrieval.knn_join(queries, rows, 10)
    coarse = lambda df: df.withColumn("embedding", signs(F.col("embedding")))
    return retrieval.recall_at_k(retrieval.knn_join(coarse(queries), coarse(rows), 10), exact, 10)


@query("label_by_examples", f"""
WITH {VECTORS_SQL},
 ex AS (SELECT id, label, v FROM e
        QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('1-' || CAST(id AS VARCHAR)), id) <= 3),
 n AS (SELECT q.id, ex.label FROM e q JOIN ex ON q.id <> ex.id
       QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {sqltext.cosine('q.v', 'ex.v')} DESC, ex.id) <= 5),
 c AS (SELECT id, label, count(*) AS votes FROM n GROUP BY 1, 2)
SELECT id, label, CAST(votes AS BIGINT) AS votes FROM c
QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) = 1""")
def q_label_by_examples(spark, sf):
    rows = vectors(spark, sf)
    examples = ranking.stratified_sample(rows, "label", "id", 3, seed=1)
    return answering.label_by_examples(rows, examples, 5)


@query("index_build", f"""
WITH {VECTORS_SQL} SELECT id, label, round(sqrt(list_dot_product(v, v)), {SCORE_DIGITS}) AS norm FROM e""")
def q_index_build(spark, sf):
    path = scratch_path(spark, "index")
    retrieval.index_build(vectors(spark, sf), "id", "embedding", DIM, path)
    return spark.read.parquet(path).select("id", "label", F.round("norm", SCORE_DIGITS).alias("norm"))


@query("index_freshness", """
SELECT 'missing' AS part, vec_id AS id FROM embeddings WHERE label = 0
UNION ALL SELECT 'indexed', count(*) FROM embeddings WHERE label <> 0
UNION ALL SELECT 'expected', count(*) FROM embeddings
UNION ALL SELECT 'ready', CAST(count(*) FILTER (label = 0) = 0 AS BIGINT) FROM embeddings""")
def q_index_freshness(spark, sf):
    source = vectors(spark, sf)
    counts, missing = retrieval.index_freshness(source, source.where("label <> 0"), "id")
    facts = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("part"), F.col(c).cast("bigint").alias("id")) for c in ("indexed", "expected", "ready")]))
        .alias("f")).select("f.*")
    return missing.select(F.lit("missing").alias("part"), "id").unionByName(facts)


@query("document_index_load", """
SELECT CAST(doc_id AS VARCHAR) AS id, source AS url, md5(text) AS digest, 64 AS dim FROM documents""")
def q_document_index(spark, sf):
    path = scratch_path(spark, "document-index")
    retrieval.document_index_load(heavy_table(spark, sf, "documents"),
                                  {"id": "doc_id", "url": "source", "content": "text"}, "text", path)
    return spark.read.parquet(path).select("id", "url", F.md5("content").alias("digest"), F.size("vector").alias("dim"))
