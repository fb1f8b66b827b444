"""Queries over batch model runs and rule-based models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import language
from tessera.functions.text import tokenize_words
from tessera.inference import models, runner
from tessera.operators import answering
from tessera.operators.relational import replicate_rows
from tessera.operators.valence import ValenceRules, text_valence
from tessera.plans import sqltext
from tessera.plans.registry import query
from tessera.session import pin
from tessera.sources.readers import heavy_table, load_table

SUM_SQL = "length({t}) || ':' || md5({t})"


def docs(spark, sf):
    return heavy_table(spark, sf, "documents").select("doc_id", "lang", "text")


@query("ai_query", f"SELECT doc_id, lang, 'm1 ' || {SUM_SQL.format(t='text')} AS response FROM documents")
def q_ai_query(spark, sf):
    return runner.ai_query(docs(spark, sf), "text", models.Checksum("m1 ")).drop("text")


@query("ai_query_schema", r"""
SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), '') AS email,
       CAST(len(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}')) AS INTEGER) AS hosts FROM documents""")
def q_ai_query_schema(spark, sf):
    model = models.PatternExtractor({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
                                     "hosts": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"}, many=("hosts",))
    out = runner.ai_query(docs(spark, sf), "text", model, "record", ddl="email string, hosts array<string>")
    return out.select("doc_id", "record.email", F.size("record.hosts").alias("hosts"))


@query("positional_attach", """
SELECT conv_id, turn, role, CAST(length(text) AS VARCHAR) || ':' || md5(text) AS response FROM conversations""")
def q_positional_attach(spark, sf):
    return runner.ai_query(load_table(spark, sf, "conversations"), "text", models.Checksum()).drop("text")


@query("infer_with_errors", f"""
SELECT doc_id, CASE WHEN strpos(text, '@') = 0 THEN {SUM_SQL.format(t='text')} END AS response,
       CASE WHEN strpos(text, '@') > 0 THEN 'ValueError: refused input' END AS error,
       CASE WHEN strpos(text, '@') = 0 THEN {SUM_SQL.format(t='text')} ELSE 'ERROR' END AS marked FROM documents""")
def q_infer_with_errors(spark, sf):
    model = models.Flaky(models.Checksum(), poison="@")
    both = runner.ai_query(docs(spark, sf), "text", model, "response", on_error="column", batch=10)
    return runner.ai_query(both, "text", model, "marked", on_error="mark", batch=10).select(
        "doc_id", "response", "error", "marked")


@query("infer_timed", f"SELECT doc_id, {SUM_SQL.format(t='text')} AS response, true AS timed FROM documents")
def q_infer_timed(spark, sf):
    out = runner.ai_query(docs(spark, sf), "text", models.Checksum(), timed=True)
    return out.select("doc_id", "response", (F.col("latency_s") >= 0).alias("timed"))


@query("infer_parallelism", "SELECT CAST(24 AS BIGINT) AS slots, count(*) AS rows FROM documents")
def q_infer_parallelism(spark, sf):
    out = runner.ai_query(docs(spark, sf), "text", models.Checksum(), slots=24)
    # The answer is part of the sum, so the model is called on every row.
    return out.select(F.spark_partition_id().alias("slot"), "response").agg(
        F.count_distinct("slot").alias("slots"), F.count("response").alias("rows"))


@query("infer_micro_batches", "SELECT CAST(10 AS INTEGER) AS largest, count(*) AS rows FROM conversations")
def q_infer_micro_batches(spark, sf):
    out = runner.ai_query(load_table(spark, sf, "conversations"), "text", models.BatchSize(), batch=10)
    return out.agg(F.max(F.col("response").cast("int")).alias("largest"), F.count("response").alias("rows"))


@query("infer_retry", f"""
SELECT conv_id, turn, {SUM_SQL.format(t='text')} AS response, CAST(3 AS INTEGER) AS attempts FROM conversations""")
def q_infer_retry(spark, sf):
    model = models.Flaky(models.Checksum(), fails=2)
    out = runner.ai_query(load_table(spark, sf, "conversations"), "text", model, attempts=True, batch=1, retries=5)
    return out.select("conv_id", "turn", "response", "attempts")


@query("infer_chain", f"""
WITH a AS (SELECT conv_id, turn, {SUM_SQL.format(t='text')} AS summary FROM conversations)
SELECT conv_id, turn, summary, {SUM_SQL.format(t="('Classify: ' || summary)")} AS label FROM a""")
def q_infer_chain(spark, sf):
    out = runner.infer_chain(load_table(spark, sf, "conversations"), "text", [
        ("summary", models.Checksum(), None), ("label", models.Checksum(), "Classify: {answer}")])
    return out.select("conv_id", "turn", "summary", "label")


@query("model_sweep", f"""
SELECT conv_id, turn, model_id, model_id || {SUM_SQL.format(t='text')} AS response
FROM conversations, (VALUES ('small'), ('medium'), ('large')) m(model_id)""")
def q_model_sweep(spark, sf):
    sweep = {m: models.Checksum(m) for m in ("small", "medium", "large")}
    return runner.model_sweep(load_table(spark, sf, "conversations"), "text", sweep).select(
        "conv_id", "turn", "model_id", "response")


# Words of the test texts with invented strengths.
LEXICON = {"the": 0.5, "and": 1.5, "der": -1.0, "le": -2.0, "la": 2.0, "que": -0.5, "est": -2.0}
LEXICON_SQL = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items())


@query("sentiment_score", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {sqltext.WORDS})) AS w FROM documents),
 s AS (SELECT doc_id, sum(coalesce(v, 0)) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p,
              sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS n, count(*) FILTER (v IS NULL) AS u
       FROM t LEFT JOIN (VALUES {LEXICON_SQL}) l(w, v) USING (w) GROUP BY 1)
SELECT doc_id, round(n / (p + n + u), 3) AS neg, round(u / (p + n + u), 3) AS neu, round(p / (p + n + u), 3) AS pos,
       round(s / sqrt(s * s + 15), 4) AS compound FROM s""")
def q_sentiment(spark, sf):
    return docs(spark, sf).select("doc_id", language.sentiment(F.col("text"), LEXICON).alias("s")).select("doc_id", "s.*")


#: Rules over frequent words of the test texts, and a lexicon of an eighth of all words with a polarity drawn from their hash.
VALENCE = ValenceRules(negations=("of", "der"), degrees={"the": 0.293, "de": 0.293, "is": -0.293, "die": -0.293}, contrasts=("and", "und", "que"))


@query("text_valence", f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, {sqltext.WORDS}) AS ws FROM documents),
 tok AS (SELECT doc_id, w, lower(w) AS l, i, upper(w) = w AND lower(w) <> w AS caps FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d)),
 lex AS (SELECT l AS word, (CAST('0x' || substr(md5(l), 2, 1) AS INTEGER) - 7.5) / 3 AS valence FROM (SELECT DISTINCT l FROM tok) WHERE substr(md5(l), 1, 1) < '2'),
 about AS (SELECT doc_id, max(i) FILTER (l IN ('and', 'und', 'que')) AS last, bool_or(NOT caps) AS mixed FROM tok GROUP BY 1),
 near AS (SELECT *, lag(l, 1) OVER o AS p1, lag(l, 2) OVER o AS p2, lag(l, 3) OVER o AS p3 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 deg(w, x) AS (VALUES ('the', 0.293::DOUBLE), ('de', 0.293), ('is', -0.293), ('die', -0.293)),
 v1 AS (SELECT n.doc_id, i, last, p1, p2, p3, valence::DOUBLE AS v0, valence::DOUBLE + CASE WHEN caps AND mixed THEN sign(valence) * 0.733 ELSE 0 END
    + sign(valence) * coalesce(a.x, 0) * 1.0 + sign(valence) * coalesce(b.x, 0) * 0.95 + sign(valence) * coalesce(c.x, 0) * 0.9 AS v
   FROM near n JOIN lex ON l = word JOIN about USING (doc_id) LEFT JOIN deg a ON a.w = p1 LEFT JOIN deg b ON b.w = p2 LEFT JOIN deg c ON c.w = p3),
 v2 AS (SELECT doc_id, round(v * CASE WHEN coalesce(p1 IN ('of', 'der'), false) OR coalesce(p2 IN ('of', 'der'), false) OR coalesce(p3 IN ('of', 'der'), false) THEN -0.74 ELSE 1 END
    * CASE WHEN last IS NULL THEN 1 WHEN i < last THEN 0.5 WHEN i > last THEN 1.5 ELSE 1 END, 9) AS v FROM v1),
 sums AS (SELECT doc_id, sum(v) AS s, sum(v + 1) FILTER (v > 0) AS p, sum(1 - v) FILTER (v < 0) AS n, count(*) FILTER (v <> 0) AS k FROM v2 GROUP BY 1),
 marks AS (SELECT doc_id, coalesce(len(ws), 0) AS al, least(length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')), 4) * 0.292::DOUBLE
    + CASE WHEN length(regexp_replace(coalesce(text, ''), '[^?]', '', 'g')) > 3 THEN 0.96::DOUBLE WHEN length(regexp_replace(coalesce(text, ''), '[^?]', '', 'g')) > 1
      THEN length(regexp_replace(coalesce(text, ''), '[^?]', '', 'g')) * 0.18::DOUBLE ELSE 0 END AS m FROM d),
 j AS (SELECT doc_id, m, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n, al - coalesce(k, 0) AS u FROM marks LEFT JOIN sums USING (doc_id)),
 z AS (SELECT doc_id, round(s + sign(s) * m, 9) AS s, p + CASE WHEN p > n THEN m ELSE 0 END AS p, n + CASE WHEN n > p THEN m ELSE 0 END AS n, u FROM j)
SELECT doc_id, CASE WHEN p + n + u = 0 THEN 0.0 ELSE round(n / (p + n + u), 3) END AS neg, CASE WHEN p + n + u = 0 THEN 0.0 ELSE round(u / (p + n + u), 3) END AS neu,
  CASE WHEN p + n + u = 0 THEN 0.0 ELSE round(p / (p + n + u), 3) END AS pos, round(s / sqrt(s * s + 15), 4) AS compound FROM z""")
def q_text_valence(spark, sf):
    """A lexicon of thousands of words, as a table."""
    rows = docs(spark, sf).select("doc_id", "text")
    word = rows.select(F.explode(tokenize_words(F.col("text"))).alias("word")).distinct()
    digit = F.conv(F.substring(F.md5("word"), 2, 1), 16, 10).cast("int")
    lexicon = pin(word.where(F.substring(F.md5("word"), 1, 1) < "2").select("word", ((digit - 7.5) / 3).alias("valence")))
    return text_valence(rows, "doc_id", "text", lexicon, VALENCE)


@query("sentiment_x30", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {sqltext.WORDS})) AS w FROM documents),
 s AS (SELECT doc_id, sum(coalesce(v, 0)) AS s FROM t LEFT JOIN (VALUES {LEXICON_SQL}) l(w, v) USING (w) GROUP BY 1)
SELECT copy_no, count(*) AS docs, round(sum(round(s / sqrt(s * s + 15), 4)), 4) AS compound
FROM s, (SELECT CAST(range AS INTEGER) AS copy_no FROM range(30)) GROUP BY copy_no""")
def q_sentiment_x30(spark, sf):
    """The load test of the sentiment run: every document thirty times, each copy scored."""
    copies = replicate_rows(docs(spark, sf), 30)
    read = copies.select("copy_no", language.sentiment(F.col("text"), LEXICON).alias("s"))
    return read.groupBy("copy_no").agg(F.count("s.compound").alias("docs"), F.round(F.sum("s.compound"), 4).alias("compound"))


@query("judge_rule", """
WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l, text FROM conversations)
SELECT conv_id, turn, CASE WHEN len(list_distinct(list_filter(l, lambda s: s <> ''))) = len(list_filter(l, lambda s: s <> ''))
       THEN 'Yes' ELSE 'No' END AS unique_items,
       CASE WHEN len(list_filter(l, lambda s: regexp_matches(s, '^[ \\t]*(?:[-*]|[0-9]+[.)])[ \\t]+'))) > 0
       THEN 'Yes' ELSE 'No' END AS is_list,
       CASE WHEN regexp_matches(text, '(?i)\\[arxiv:') THEN 'Yes' ELSE 'No' END AS cites FROM t""")
def q_judge_rule(spark, sf):
    verdicts = [language.verdict(language.RULES[r](F.col("text"))).alias(r) for r in ("unique_items", "is_list", "cites")]
    return load_table(spark, sf, "conversations").select("conv_id", "turn", *verdicts)


@query("extract_fields", r"""
SELECT page_id, nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '') AS title,
       CAST(len(regexp_extract_all(html, '<b>(.*?)</b>', 1)) AS INTEGER) AS bold,
       array_to_string(list_transform(list_zip(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1),
           regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)), lambda x: x[1] || '=' || x[2]), ';') AS links,
       regexp_matches(html, 'class="ad"') AS has_ad FROM pages""")
def q_extract_fields(spark, sf):
    fields = [language.FieldPattern("title", "<title>(.*?)</title>"),
              language.FieldPattern("bold", "<b>(.*?)</b>", "list", placeholders=()),
              language.FieldPattern("links", '<a href="([^"]*)">([^<]*)</a>', "records", members=("path", "label")),
              language.FieldPattern("has_ad", 'class="ad"', "checked")]
    out = load_table(spark, sf, "pages").select("page_id", language.extract_fields(F.col("html"), fields).alias("r"))
    links = F.transform("r.links", lambda x: F.concat_ws("=", x["path"], x["label"]))
    return out.select("page_id", "r.title", F.size("r.bold").alias("bold"), F.array_join(links, ";").alias("links"),
                      "r.has_ad")


TEMPLATE = "Answer from the context.\n{context}\nQuestion: {question}"


@query("rag_answer", f"""
WITH {sqltext.embed('d', 'documents', 'doc_id', 'text')}, {sqltext.embed('q', 'benchmark', 'item_id', 'text')},
 r AS (SELECT q.key AS item_id, d.key AS doc_id, row_number() OVER (
           PARTITION BY q.key ORDER BY {sqltext.cosine('q.v', 'd.v')} DESC, d.key) AS rank FROM q, d QUALIFY rank <= 4),
 c AS (SELECT item_id, string_agg('[' || rank || '] Id: ' || doc_id || chr(10) || 'Content: ' || text || chr(10),
           chr(10) || '---' || chr(10) ORDER BY rank) AS context, string_agg(doc_id, ',' ORDER BY rank) AS ids
       FROM r JOIN documents USING (doc_id) GROUP BY 1),
 p AS (SELECT item_id, ids, 'Answer from the context.' || chr(10) || context || chr(10) || 'Question: ' || text AS prompt
       FROM c JOIN benchmark USING (item_id))
SELECT item_id, ids, {SUM_SQL.format(t='prompt')} AS answer FROM p""")
def q_rag_answer(spark, sf):
    questions = load_table(spark, sf, "benchmark").withColumnRenamed("text", "question")
    return answering.rag_answer(questions, heavy_table(spark, sf, "documents").select("doc_id", "text"), 4, TEMPLATE,
                      models.HashedEmbedder(64), models.Checksum()).select("item_id", "ids", "answer")


@query("route_with_default", f"""
WITH t AS (SELECT u.conv_id, u.turn, list_distinct(regexp_extract_all(lower(u.text), {sqltext.WORDS})) AS asked,
       CASE WHEN a.text IS NOT NULL THEN regexp_extract_all(lower(a.text), {sqltext.WORDS}) END AS known
   FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 WHERE u.role = 'user'),
 c AS (SELECT conv_id, turn, CASE WHEN known IS NOT NULL THEN len(list_intersect(asked, known)) / len(asked) END AS cover FROM t)
SELECT conv_id, turn, coalesce(cover < 0.6, true) AS need_retrieval, CASE WHEN cover IS NULL THEN '{language.UNSURE}'
       WHEN cover < 0.6 THEN 'Question asks for words not seen before.'
       ELSE 'Question is covered by the conversation.' END AS reasoning FROM c""")
def q_route(spark, sf):
    turns = load_table(spark, sf, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("history"))
    asked = turns.where("role = 'user'").join(before, ["conv_id", "turn"], "left")
    routed = language.route_with_default(F.col("text"), F.col("history"), F.lit(None).cast("string"))
    return asked.select("conv_id", "turn", routed.alias("r")).select("conv_id", "turn", "r.*")


@query("run_throughput", """
SELECT count(*) AS rows, round(sum(value), 4) AS seconds, round(count(*) / sum(value), 6) AS rows_per_s,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens,
       round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) / sum(value), 6) AS tokens_per_s FROM events""")
def q_run_throughput(spark, sf):
    timed = load_table(spark, sf, "events").select(
        F.col("value").alias("latency_s"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    out = runner.run_throughput(timed, F.col("tokens"))
    return out.select("rows", F.round("seconds", 4).alias("seconds"), F.round("rows_per_s", 6).alias("rows_per_s"),
                      "tokens", F.round("tokens_per_s", 6).alias("tokens_per_s"))
