"""Queries over the stored word index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import tokenize_words
from tessera.inference import models
from tessera.operators import answering, postings, reranking, retrieval
from tessera.plans import sqltext
from tessera.plans.inference import SUM_SQL, TEMPLATE
from tessera.plans.registry import query
from tessera.plans.retrieval import DIM, shown
from tessera.session import scratch_path
from tessera.sources.readers import heavy_table, load_table


def text_index(spark, sf):
    return postings.build_text_index(heavy_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", scratch_path(spark, "text-index"))


def items(spark, sf):
    return load_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


INDEX_SQL = f"""
t AS (SELECT doc_id AS key, coalesce(regexp_extract_all(lower(text), {sqltext.WORDS}), []) AS ws FROM documents),
stat AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t),
pos AS (SELECT key, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM t),
tf AS (SELECT key, w, count(*) AS tf FROM pos GROUP BY 1, 2),
dl AS (SELECT key, len(ws) AS dl FROM t),
item AS (SELECT item_id, regexp_extract_all(lower(text), {sqltext.WORDS}) AS ws FROM benchmark)"""

#: From hit(qid, clause, sign, weight, key, tf) and clauses(qid, clause, sign, weight) to score(qid, key, score).
SCORE_SQL = """
cdf AS (SELECT qid, clause, count(*) AS df FROM hit GROUP BY 1, 2),
must AS (SELECT qid, count(*) FILTER (sign = '+') AS must FROM clauses GROUP BY 1),
part AS (SELECT qid, key, sign, weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS s
  FROM hit JOIN cdf USING (qid, clause) JOIN dl USING (key), stat),
score AS (SELECT qid, key, round(sum(s) FILTER (sign <> '-'), 12) AS score FROM part JOIN must USING (qid) GROUP BY qid, key, must
  HAVING count(*) FILTER (sign = '-') = 0 AND count(*) FILTER (sign = '+') = must AND sum(s) FILTER (sign <> '-') IS NOT NULL)"""

WORD_HITS = "SELECT qid, clause, sign, weight, key, tf FROM clauses JOIN tf ON w = words[1] WHERE kind = 'word'"
BEST_SQL = "SELECT qid AS query_id, key AS id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS INTEGER) AS rank"

PLAIN_SQL = f"""
clauses AS (SELECT item_id AS qid, w AS clause, '' AS sign, 'word' AS kind, [w] AS words, 0 AS slack, 1.0::DOUBLE AS weight
  FROM (SELECT DISTINCT item_id, unnest(ws) AS w FROM item)),
hit AS ({WORD_HITS})"""


@query("keyword_join", sqltext.shown(f"""
WITH {INDEX_SQL}, {PLAIN_SQL}, {SCORE_SQL}
{BEST_SQL}, count(*) OVER (PARTITION BY qid) AS total FROM score QUALIFY rank <= 8""", score=6))
def q_keyword_join(spark, sf):
    return shown(postings.keyword_join(text_index(spark, sf), items(spark, sf), 8, totals=True))


@query("keyword_join_blocks", sqltext.shown(f"""
WITH {INDEX_SQL}, {PLAIN_SQL}, {SCORE_SQL}
{BEST_SQL} FROM score QUALIFY rank <= 3""", score=6))
def q_keyword_blocks(spark, sf):
    """The same search with the blocks that cannot matter left out."""
    docs = heavy_table(spark, sf, "documents").select("doc_id", "text")
    index = postings.build_text_index(docs, "doc_id", "text", scratch_path(spark, "text-index"), block_docs=64)
    return shown(postings.keyword_join(index, items(spark, sf), 3))


#: Letters of the test data beyond ASCII, made single bytes for an edit distance that counts bytes.
PLAIN_LETTERS = "translate({}, 'éèêàâçôîûüöäßñáíóúï', 'ABCDEFGHIJKLMNOPQRS')"


@query("keyword_syntax", sqltext.shown(f"""
WITH {INDEX_SQL},
 made AS (
  SELECT item_id * 10 AS qid, '' AS sign, 'phrase' AS kind, ws[1:2] AS words, 0 AS slack FROM item WHERE len(ws) >= 6
  UNION ALL SELECT item_id * 10, '', 'word', [ws[3]], 0 FROM item WHERE len(ws) >= 6
  UNION ALL SELECT item_id * 10 + 1, '', 'near', [ws[6], ws[4]], 2 FROM item WHERE len(ws) >= 6
  UNION ALL SELECT item_id * 10 + 1, '+', 'word', [ws[5]], 0 FROM item WHERE len(ws) >= 6
  UNION ALL SELECT item_id * 10 + 2, '', 'prefix', [left(ws[3], 3)], 0 FROM item WHERE len(ws) >= 6
  UNION ALL SELECT item_id * 10 + 2, '-', 'word', [ws[1]], 0 FROM item WHERE len(ws) >= 6
  UNION ALL SELECT item_id * 10 + 3, '', 'fuzzy', [ws[2]], 1 FROM item WHERE len(ws) >= 6
  UNION ALL SELECT item_id * 10 + 3, '', 'fuzzy', [ws[4]], 2 FROM item WHERE len(ws) >= 6),
 clauses AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sign, kind, words, slack) AS clause, 1.0::DOUBLE AS weight FROM made),
 vocab AS (SELECT DISTINCT w FROM tf),
 alike AS (SELECT qid, clause, sign, weight, w FROM clauses JOIN vocab ON kind = 'prefix' AND starts_with(w, words[1])
  UNION ALL SELECT qid, clause, sign, weight, w FROM clauses JOIN vocab ON kind = 'fuzzy' AND abs(length(w) - length(words[1])) <= slack
    AND levenshtein({PLAIN_LETTERS.format('w')}, {PLAIN_LETTERS.format('words[1]')}) <= slack),
 pairs AS (SELECT qid, clause, sign, weight, kind, slack, a.key, a.p AS pa, b.p AS pb FROM clauses JOIN pos a ON a.w = words[1] JOIN pos b ON b.key = a.key AND b.w = words[2]
  WHERE kind IN ('phrase', 'near') AND abs(a.p - b.p) < 2 + slack),
 hit AS ({WORD_HITS}
  UNION ALL SELECT qid, clause, sign, weight, key, sum(tf) FROM alike JOIN tf USING (w) GROUP BY ALL
  UNION ALL SELECT qid, clause, sign, weight, key, count(DISTINCT pa) FROM pairs WHERE kind = 'phrase' AND pb = pa + 1 GROUP BY ALL
  UNION ALL SELECT qid, clause, sign, weight, key, count(DISTINCT least(pa, pb)) FROM pairs WHERE kind = 'near' GROUP BY ALL),
 {SCORE_SQL}
{BEST_SQL}, count(*) OVER (PARTITION BY qid) AS total FROM score QUALIFY rank <= 6""", score=6))
def q_keyword_syntax(spark, sf):
    """Four questions of each benchmark item: phrase, words near each other, prefix, and words of similar spelling."""
    rows = items(spark, sf).select("query_id", tokenize_words(F.col("question")).alias("w")).where(F.size("w") >= 6)
    w = lambda i: F.col("w")[i - 1]
    asked = F.array(F.format_string('"%s %s" %s', w(1), w(2), w(3)), F.format_string('"%s %s"~2 +%s', w(6), w(4), w(5)),
                    F.format_string("%s* -%s", F.left(w(3), F.lit(3)), w(1)), F.format_string("%s~1 %s~2", w(2), w(4)))
    questions = rows.select("query_id", F.posexplode(asked).alias("n", "question")).select((F.col("query_id") * 10 + F.col("n")).alias("query_id"), "question")
    return shown(postings.keyword_join(text_index(spark, sf), questions, 6, totals=True))


EXPANDED_SQL = f"""
{PLAIN_SQL}, {SCORE_SQL},
first AS (SELECT qid, key, score FROM score QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) <= 5),
vote AS (SELECT qid, w, sum(score / alls * tf.tf / dl) AS v FROM first JOIN (SELECT qid, sum(score) AS alls FROM first GROUP BY 1) USING (qid)
  JOIN tf USING (key) JOIN dl USING (key) GROUP BY 1, 2),
vdf AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
rated AS (SELECT qid, w, round(v * ln(1 + (n - df + 0.5) / (df + 0.5)), 12) AS v FROM vote JOIN vdf USING (w), stat),
strong AS (SELECT * FROM rated WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC, w) <= 10),
clauses2 AS (SELECT qid, words[1] AS w, CASE WHEN qid IN (SELECT qid FROM strong) THEN 0.5 / count(*) OVER (PARTITION BY qid) ELSE 1.0 END AS weight FROM clauses
  UNION ALL SELECT qid, w, 0.5 * v / sum(v) OVER (PARTITION BY qid) FROM strong),
part2 AS (SELECT qid, key, weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS s
  FROM clauses2 JOIN tf USING (w) JOIN vdf USING (w) JOIN dl USING (key), stat),
score2 AS (SELECT qid, key, round(sum(s), 12) AS score FROM part2 GROUP BY 1, 2)"""


@query("keyword_expanded", sqltext.shown(f"""
WITH {INDEX_SQL}, {EXPANDED_SQL}
{BEST_SQL} FROM score2 QUALIFY rank <= 8""", score=6))
def q_keyword_expanded(spark, sf):
    return shown(postings.expanded_join(text_index(spark, sf), items(spark, sf), 8))


@query("hybrid_join", sqltext.shown(f"""
WITH {INDEX_SQL}, {PLAIN_SQL}, {SCORE_SQL},
 {sqltext.embed('d', 'documents', 'doc_id', 'text')}, {sqltext.embed('q', 'benchmark', 'item_id', 'text')},
 vec AS (SELECT q.key AS qid, d.key, row_number() OVER (PARTITION BY q.key ORDER BY {sqltext.cosine('q.v', 'd.v')} DESC, d.key) AS r FROM q, d QUALIFY r <= 100),
 word AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS r FROM score QUALIFY r <= 100),
 fused AS (SELECT qid, key, round(coalesce(1.0::DOUBLE / (60 + word.r), 0) + coalesce(1.0::DOUBLE / (60 + vec.r), 0), 12) AS score
   FROM word FULL JOIN vec USING (qid, key))
{BEST_SQL} FROM fused QUALIFY rank <= 10""", score=9))
def q_hybrid_join(spark, sf):
    docs = heavy_table(spark, sf, "documents").select("doc_id", "text")
    asked = retrieval.embed_text(items(spark, sf), "question", dim=DIM)
    known = retrieval.embed_text(docs, "text", dim=DIM).select(F.col("doc_id").alias("id"), "embedding")
    near = retrieval.knn_join(asked, known, 100)
    return shown(postings.hybrid_join(text_index(spark, sf), items(spark, sf), near, 10), score=9)


@query("rag_answer_expanded", f"""
WITH {INDEX_SQL}, {EXPANDED_SQL},
 r AS (SELECT qid AS item_id, key AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM score2 QUALIFY rank <= 4),
 c AS (SELECT item_id, string_agg('[' || rank || '] Id: ' || doc_id || chr(10) || 'Content: ' || text || chr(10),
           chr(10) || '---' || chr(10) ORDER BY rank) AS context, string_agg(doc_id, ',' ORDER BY rank) AS ids
       FROM r JOIN documents USING (doc_id) GROUP BY 1),
 p AS (SELECT item_id, ids, 'Answer from the context.' || chr(10) || context || chr(10) || 'Question: ' || text AS prompt
       FROM c JOIN benchmark USING (item_id))
SELECT item_id, ids, {SUM_SQL.format(t='prompt')} AS answer FROM p""")
def q_rag_expanded(spark, sf):
    """Questions expanded by words of what they find, searched again, and answered from the documents."""
    docs = heavy_table(spark, sf, "documents").select("doc_id", "text")
    near = postings.expanded_join(text_index(spark, sf), items(spark, sf), 4)
    questions = load_table(spark, sf, "benchmark").withColumnRenamed("text", "question")
    return answering.rag_answer(questions, docs, 4, TEMPLATE, models.HashedEmbedder(64), models.Checksum(), near=near).select("item_id", "ids", "answer")


@query("semantic_rerank", sqltext.shown(f"""
WITH {INDEX_SQL}, {PLAIN_SQL}, {SCORE_SQL},
 found AS (SELECT qid, key AS id FROM score QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) <= 8),
 sents AS (SELECT id * 100000 + n AS sid, id, s FROM (SELECT id, unnest(p) AS s, generate_subscripts(p, 1) AS n FROM (
     SELECT doc_id AS id, regexp_split_to_array(text, '[.!?]+[ \n]+|\n+') AS p FROM documents WHERE doc_id IN (SELECT id FROM found)))
   WHERE len(regexp_extract_all(lower(s), {sqltext.WORDS})) > 0),
 term AS (SELECT qid, words[1] AS w, row_number() OVER (ORDER BY qid, words[1]) AS wid FROM clauses),
 {sqltext.embed('sv', 'sents', 'sid', 's')}, {sqltext.embed('wv', 'term', 'wid', 'w')},
 best AS (SELECT f.qid, f.id, t.wid, max(list_cosine_similarity(sv.v, wv.v)) AS c FROM found f JOIN term t ON t.qid = f.qid JOIN wv ON wv.key = t.wid
   JOIN sents p ON p.id = f.id JOIN sv ON sv.key = p.sid GROUP BY ALL),
 near AS (SELECT qid, id, round(avg(c), 12) AS score FROM best GROUP BY ALL)
SELECT qid AS query_id, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank,
  CAST(1 + floor(least(score, 0.4) * 10 + 1e-9) AS INTEGER) AS level FROM near""", score=6))
def q_semantic_rerank(spark, sf):
    """Passages found by words, ranked again by their sentences, with the highest strictness level that each passes."""
    found = postings.keyword_join(text_index(spark, sf), items(spark, sf), 8)
    docs = heavy_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ranked = reranking.semantic_rerank(found, docs, items(spark, sf), models.HashedEmbedder(DIM), 1)
    level = sum((F.col("score") >= least).cast("int") for least in reranking.STRICTNESS.values())
    return shown(ranked.withColumn("level", level))
