"""Queries over evaluation of extractions, answers and traces, and over prompt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import language
from tessera.operators import evaluation as ev
from tessera.operators import registry
from tessera.plans import sqltext
from tessera.plans.registry import query
from tessera.plans.relational import PROMPT_SQL, prompt_versions
from tessera.plans.scalar import norm_sql
from tessera.sources.readers import load_table

FIELDS = {"name": "text", "segment": "text", "opened": "date", "tags": "list"}

# Golden records of the customers, and answers of a careful and of a careless extractor.
GOLDEN_SQL = """g AS (SELECT c_custkey AS file, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_custkey % 5 <> 0 THEN printf('%02d/%02d/%d', 1 + c_custkey % 12, 1 + c_custkey % 28, 2000 + c_custkey % 20) END AS opened,
  [c_mktsegment, 'nation ' || c_nationkey] AS tags FROM customer)"""
EXTRACT_SQL = """x AS (SELECT c_custkey AS file, c_custkey % 11 = 0 AS broken,
  CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'Commercial ' || upper(c_name) ELSE c_name || ' Inc' END AS name,
  CASE WHEN c_custkey % 14 = 0 THEN 'null' ELSE c_mktsegment END AS segment,
  printf('%d-%d-%02d', 1 + c_custkey % 12, 1 + c_custkey % 28, c_custkey % 20) AS opened,
  CASE c_custkey % 4 WHEN 0 THEN ['nation ' || c_nationkey] WHEN 1 THEN ['a', 'b', c_mktsegment, 'c']
      WHEN 2 THEN [] ELSE [lower(c_mktsegment), 'Nation ' || c_nationkey] END AS tags FROM customer)"""
SCORE_SQL = f"""{GOLDEN_SQL}, {EXTRACT_SQL},
 j AS (SELECT file, {norm_sql('g.name')} AS en, {norm_sql('x.name')} AS xn, g.segment AS es, x.segment AS xs,
      {norm_sql('g.segment')} AS esn, {norm_sql('x.segment')} AS xsn, g.opened AS eo, x.opened AS xo,
      list_transform(g.tags, lambda t: {norm_sql('t')}) AS et, list_transform(x.tags, lambda t: {norm_sql('t')}) AS xt
   FROM g JOIN x USING (file) WHERE NOT broken),
 h AS (SELECT *, len(list_filter(et, lambda v: len(list_filter(xt, lambda w: strpos(w, v) > 0 OR strpos(v, w) > 0)) > 0)) AS hits FROM j),
 s AS (SELECT file, CASE WHEN en = xn THEN 1.0::DOUBLE WHEN strpos(en, xn) > 0 OR strpos(xn, en) > 0 THEN 0.8 ELSE 0 END AS name,
   CASE WHEN es IS NULL THEN CASE WHEN xs = 'null' THEN 1.0::DOUBLE ELSE 0 END WHEN esn = xsn THEN 1.0
        WHEN strpos(esn, xsn) > 0 OR strpos(xsn, esn) > 0 THEN 0.8 ELSE 0 END AS segment,
   CASE WHEN eo IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS opened,
   CASE WHEN len(xt) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, hits / 2 - least(0.2, 0.05 * greatest(0, len(xt) - hits))) END AS tags
   FROM h),
 sc AS (SELECT *, (name + segment + opened + tags) / 4 AS accuracy FROM s)"""


def golden(spark, sf):
    key = F.col("c_custkey")
    day = F.format_string("%02d/%02d/%d", 1 + key % 12, 1 + key % 28, 2000 + key % 20)
    return load_table(spark, sf, "customer").select(
        key.alias("file"), F.col("c_name").alias("name"), F.when(key % 7 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(key % 5 != 0, day).alias("opened"),
        F.array("c_mktsegment", F.concat(F.lit("nation "), F.col("c_nationkey"))).alias("tags"))


def extractions(spark, sf):
    key, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    nation = F.concat(F.lit("nation "), F.col("c_nationkey"))
    tags = (F.when(key % 4 == 0, F.array(nation)).when(key % 4 == 1, F.array(F.lit("a"), F.lit("b"), segment, F.lit("c")))
            .when(key % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lower(segment), F.initcap(nation))))
    record = F.struct(
        F.when(key % 3 == 0, name).when(key % 3 == 1, F.concat(F.lit("Commercial "), F.upper(name)))
        .otherwise(F.concat(name, F.lit(" Inc"))).alias("name"),
        F.when(key % 14 == 0, F.lit("null")).otherwise(segment).alias("segment"),
        F.format_string("%d-%d-%02d", 1 + key % 12, 1 + key % 28, key % 20).alias("opened"), tags.alias("tags"))
    answer = F.when(key % 11 == 0, F.lit('{"name": ')).otherwise(F.to_json(record))
    return load_table(spark, sf, "customer").select(key.alias("file"), answer.alias("extracted"))


def rounded(df, columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("score_extraction", f"""WITH {SCORE_SQL}
SELECT file, name, segment, opened, round(tags, 6) AS tags, round(accuracy, 6) AS accuracy FROM sc""")
def q_score_extraction(spark, sf):
    per_file, _ = ev.extraction_benchmark(extractions(spark, sf), golden(spark, sf), "file", FIELDS)
    return rounded(per_file, ["tags", "accuracy"])


@query("extraction_benchmark", f"""WITH {SCORE_SQL}
SELECT round(avg(accuracy), 9) AS accuracy, round(avg(name), 9) AS name, round(avg(segment), 9) AS segment,
  round(avg(opened), 9) AS opened, round(avg(tags), 9) AS tags, count(*) AS scored, (SELECT count(*) FROM g) AS golden,
  round(count(*) / (SELECT count(*) FROM g), 9) AS coverage, round((SELECT count(*) FROM g) / 60.0, 9) AS docs_per_s FROM sc""")
def q_extraction_benchmark(spark, sf):
    _, summary = ev.extraction_benchmark(extractions(spark, sf), golden(spark, sf), "file", FIELDS, wall_s=60.0)
    return rounded(summary, ["accuracy", *FIELDS, "coverage", "docs_per_s"], 9)


@query("approach_profile", f"""WITH {SCORE_SQL},
 b AS (SELECT file, segment AS name, name AS segment, opened, tags, (accuracy + name) / 2 AS accuracy FROM sc WHERE file % 3 <> 1),
 pf AS (SELECT coalesce(sc.file, b.file) AS file, round(b.accuracy - sc.accuracy, 3) AS delta, sc.name AS na, b.name AS nb,
        sc.tags AS ta, b.tags AS tb FROM sc FULL JOIN b ON sc.file = b.file)
SELECT 'file' AS part, CAST(file AS VARCHAR) AS key, delta AS value FROM pf
UNION ALL SELECT 'field', 'name', round(avg(nb) - avg(na), 6) FROM pf
UNION ALL SELECT 'field', 'tags', round(avg(tb) - avg(ta), 6) FROM pf
UNION ALL SELECT 'run', event_type, value FROM (SELECT event_type, value FROM events WHERE event_type IN ('click', 'view')
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) = 1)""")
def q_approach_profile(spark, sf):
    a, _ = ev.extraction_benchmark(extractions(spark, sf), golden(spark, sf), "file", FIELDS)
    b = a.where("file % 3 <> 1").select("file", F.col("segment").alias("name"), F.col("name").alias("segment"), "opened",
                                        "tags", ((F.col("accuracy") + F.col("name")) / 2).alias("accuracy"))
    runs = load_table(spark, sf, "events").select(
        F.col("event_type").alias("run_name"), F.col("ts").alias("start_time"), F.col("event_id").alias("run_id"), "value")
    per_file, newest, per_field = ev.approach_profile(a, b, runs, "file", ["name", "tags"], ("click", "view"))
    files = per_file.select(F.lit("file").alias("part"), F.col("file").cast("string").alias("key"), F.col("delta").alias("value"))
    return files.unionByName(per_field.select(F.lit("field").alias("part"), F.col("field").alias("key"),
                                              F.round("delta", 6).alias("value"))).unionByName(
        newest.select(F.lit("run").alias("part"), F.col("run_name").alias("key"), "value"))


@query("accuracy", """
SELECT round(avg(CASE WHEN doc_id % 5 = 0 THEN 1.0 WHEN quality = toxic THEN 1 ELSE 0 END), 9) AS accuracy, count(*) AS rows
FROM labels""")
def q_accuracy(spark, sf):
    judged = load_table(spark, sf, "labels").withColumn("verdict", F.when(F.col("doc_id") % 5 == 0, F.lit(True)))
    return rounded(ev.accuracy(judged, "toxic", "quality", "verdict"), ["accuracy"], 9)


@query("bleu1", f"""
WITH p AS (SELECT u.conv_id, u.turn, regexp_extract_all(lower(u.text), {sqltext.WORDS}) AS c,
       regexp_extract_all(lower(a.text), {sqltext.WORDS}) AS r
   FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
 w AS (SELECT conv_id, turn, unnest(c) AS word, 1 AS c, 0 AS r FROM p UNION ALL SELECT conv_id, turn, unnest(r), 0, 1 FROM p),
 n AS (SELECT conv_id, turn, word, sum(c) AS c, sum(r) AS r FROM w GROUP BY 1, 2, 3),
 s AS (SELECT conv_id, turn, sum(least(c, r)) AS hits, sum(c) AS c, sum(r) AS r FROM n GROUP BY 1, 2)
SELECT conv_id, turn, round(coalesce(hits / c * CASE WHEN c >= r THEN 1 ELSE exp(1 - r / greatest(1, c)) END, 0), 4) AS bleu FROM s""")
def q_bleu(spark, sf):
    turns = load_table(spark, sf, "conversations")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = turns.where("role = 'user'").join(replies, ["conv_id", "turn"])
    return ev.bleu1(pairs, ["conv_id", "turn"], "reply", "text")


# ---------------------------------------------------------------- traces


def traces(spark, sf):
    """A trace per document: a search with two results or one broken output, a lookup, and an answer with citations."""
    key, n = F.col("doc_id"), F.col("n_chars")
    item = lambda i: F.concat(F.lit('{"arxiv_id": "'), i.cast("string"), F.lit('", "summary": "s"}'))
    found = F.when(key % 6 == 5, F.lit("timeout")).otherwise(
        F.concat(F.lit("["), item(key % 50), F.lit(", "), item(n % 40), F.lit("]")))
    span = lambda kind, name, out: F.struct(
        F.lit(kind).alias("span_type"), F.lit(name).alias("name"), F.lit("{}").alias("inputs"), out.alias("outputs"))
    spans = F.array(span("TOOL", "search_arxiv", found), span("SpanType.TOOL", "get_paper", item(key % 30)),
                    span("CHAT_MODEL", "model", item(key % 9 + 1000)))
    cite = lambda i: F.concat(F.lit(" [arxiv:"), i.cast("string"), F.lit("]"))
    answer = F.concat(F.col("text"), F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, cite(key % 50))
                      .when(key % 4 == 2, F.concat(cite(key % 50), cite(n % 40))).otherwise(cite(key % 9 + 1000)))
    return load_table(spark, sf, "documents").select(key.alias("trace_id"), "lang", answer.alias("answer"), spans.alias("spans"))


# seen: ids of the tool outputs; cited: ids of the answer.
TRACE_SQL = """t AS (SELECT doc_id AS trace_id, lang, text, list_distinct(
    CASE WHEN doc_id % 6 = 5 THEN [CAST(doc_id % 30 AS VARCHAR)]
         ELSE [CAST(doc_id % 50 AS VARCHAR), CAST(n_chars % 40 AS VARCHAR), CAST(doc_id % 30 AS VARCHAR)] END) AS seen,
    list_sort(list_distinct(CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [CAST(doc_id % 50 AS VARCHAR)]
      WHEN 2 THEN [CAST(doc_id % 50 AS VARCHAR), CAST(n_chars % 40 AS VARCHAR)] ELSE [CAST(doc_id % 9 + 1000 AS VARCHAR)] END)) AS cited
  FROM documents),
 c AS (SELECT trace_id, lang, text, cited, list_filter(cited, lambda x: NOT list_contains(seen, x)) AS unseen FROM t)"""


@query("citation_correctness", f"""WITH {TRACE_SQL}
SELECT trace_id, len(cited) > 0 AND len(unseen) = 0 AS value, CASE WHEN len(cited) = 0 THEN 'The answer cites nothing.'
  WHEN len(unseen) > 0 THEN 'Cited without a source: ' || array_to_string(unseen, ', ') || '.'
  ELSE 'Every citation has a source: ' || array_to_string(cited, ', ') || '.' END AS rationale FROM c""")
def q_citation_correctness(spark, sf):
    return ev.citation_correctness(traces(spark, sf))


@query("trace_bleu", f"""
WITH p AS (SELECT doc_id, regexp_extract_all(lower(lang || ' ' || source || ' the of'), {sqltext.WORDS}) AS c,
       CASE WHEN doc_id % 6 = 5 THEN [] ELSE regexp_extract_all(lower(text || CASE WHEN doc_id % 6 < 2 THEN ' ' || source ELSE '' END), {sqltext.WORDS}) END AS r
   FROM documents WHERE text IS NOT NULL),
 w AS (SELECT doc_id, unnest(c) AS word, 1 AS c, 0 AS r FROM p UNION ALL SELECT doc_id, unnest(r), 0, 1 FROM p),
 n AS (SELECT doc_id, word, sum(c) AS c, sum(r) AS r FROM w GROUP BY 1, 2),
 s AS (SELECT doc_id, sum(least(c, r)) AS hits, sum(c) AS c, sum(r) AS r FROM n GROUP BY 1)
SELECT doc_id AS trace_id, round(coalesce(hits / c * CASE WHEN c >= r THEN 1 ELSE exp(1 - r / greatest(1, c)) END, 0), 4) AS bleu FROM s""")
def q_trace_bleu(spark, sf):
    """A trace per document: a search that finds its text or fails, a lookup that finds its source for some, and a model call."""
    form = F.col("doc_id") % 6
    item = lambda c: F.to_json(F.struct(F.col("doc_id").cast("string").alias("arxiv_id"), c.alias("summary")))
    span = lambda kind, name, out: F.struct(
        F.lit(kind).alias("span_type"), F.lit(name).alias("name"), F.lit("{}").alias("inputs"), out.alias("outputs"))
    found = F.when(form == 5, F.lit("timeout")).otherwise(F.concat(F.lit("["), item(F.col("text")), F.lit(', {"arxiv_id": "0"}]')))
    looked = F.when(form < 2, item(F.col("source"))).otherwise(item(F.lit("")))
    spans = F.array(span("TOOL", "search_arxiv", found), span("SpanType.TOOL", "get_paper", looked), span("CHAT_MODEL", "model", item(F.lit("the of"))))
    question = F.concat_ws(" ", "lang", "source", F.lit("the of"))
    rows = load_table(spark, sf, "documents").where("text IS NOT NULL")
    return ev.trace_bleu(rows.select(F.col("doc_id").alias("trace_id"), question.alias("question"), spans.alias("spans")))


@query("num_results", """
SELECT doc_id AS trace_id, CAST(CASE WHEN doc_id % 6 = 5 THEN 0 ELSE 2 END AS DOUBLE) AS total, CAST(1 AS INTEGER) AS calls
FROM documents""")
def q_num_results(spark, sf):
    return ev.num_results(traces(spark, sf))


@query("guideline_rules", f"""WITH {TRACE_SQL}
SELECT trace_id, 'must_cite' AS rule, len(cited) > 0 AS pass FROM c
UNION ALL SELECT trace_id, 'must_not_invent', len(unseen) = 0 FROM c""")
def q_guidelines(spark, sf):
    from tessera.functions.text import extract_citations

    cited = lambda: extract_citations(F.col("answer"))
    return ev.guideline_rules(traces(spark, sf), "trace_id", {
        "must_cite": lambda: F.size(cited()) > 0,
        "must_not_invent": lambda: F.size(F.array_except(cited(), ev.observed_ids(F.col("spans")))) == 0})


@ev.scorer("cites", "bool")
def cites():
    return language.RULES["cites"](F.col("answer"))


@ev.scorer("chars", "num")
def chars():
    return F.char_length("answer")


@ev.scorer("language", "str")
def language_of():
    return F.col("lang")


@query("evaluate", f"""WITH {TRACE_SQL}
SELECT 'cites' AS name, printf('%.4f', round(avg(CASE WHEN len(cited) > 0 THEN 1.0 ELSE 0 END), 4)) AS value FROM c
UNION ALL SELECT 'chars', printf('%.4f', round(avg(length(text) + coalesce(list_sum(list_transform(
    CASE trace_id % 4 WHEN 2 THEN [CAST(trace_id % 50 AS VARCHAR), CAST((SELECT n_chars FROM documents WHERE doc_id = trace_id) % 40 AS VARCHAR)]
    ELSE cited END, lambda x: length(x) + 9)), 0)), 4)) FROM c
UNION ALL SELECT 'language', min(lang) FROM (SELECT lang, count(*) AS n, max(count(*)) OVER () AS top FROM documents GROUP BY 1) WHERE n = top""")
def q_evaluate(spark, sf):
    return ev.evaluate(traces(spark, sf), "trace_id", [cites, chars, language_of])[1]


@query("merge_records", """
SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN d.n_chars % 2 ELSE l.quality END AS quality,
       l.toxic, d.lang FROM labels l FULL JOIN (SELECT * FROM documents WHERE lang <> 'en') d ON l.doc_id = d.doc_id""")
def q_merge_records(spark, sf):
    new = load_table(spark, sf, "documents").where("lang <> 'en'").select(
        "doc_id", (F.col("n_chars") % 2).alias("quality"), "lang")
    return ev.merge_records(load_table(spark, sf, "labels"), new, "doc_id")


@query("inference_log_load", """
SELECT CAST(u.conv_id AS VARCHAR) AS request_id, u.turn, md5(u.text) AS prompt, md5(a.text) AS response
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'""")
def q_inference_log(spark, sf):
    turns = load_table(spark, sf, "conversations")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    log = turns.where("role = 'user'").join(replies, ["conv_id", "turn"])
    out = ev.inference_log_load(log, {"request_id": "conv_id", "turn": "turn", "prompt": "text", "response": "reply"})
    return out.withColumn("prompt", F.md5("prompt")).withColumn("response", F.md5("response"))


@query("feedback_rollup", """
WITH f AS (SELECT 'quality' AS name, 'HUMAN' AS source_type, CAST(quality AS DOUBLE) AS v, NULL AS s, NULL AS r FROM labels
  UNION ALL SELECT 'length', 'LLM_JUDGE', n_chars / 1000, NULL, 'by length' FROM documents
  UNION ALL SELECT 'comment', CASE WHEN toxic = 1 THEN 'HUMAN' ELSE 'LLM_JUDGE' END, NULL, 'seen', NULL FROM labels)
SELECT name, source_type, count(*) AS n, round(avg(v), 9) AS mean, count(s) AS texts, count(r) AS rationales FROM f GROUP BY 1, 2""")
def q_feedback_rollup(spark, sf):
    labels, docs = load_table(spark, sf, "labels"), load_table(spark, sf, "documents")
    row = lambda df, id_col, name, source, b=None, n=None, s=None, r=None: df.select(
        F.col(id_col).alias("trace_id"), F.lit(name).alias("name"), source.alias("source_type"),
        F.lit(b).cast("boolean").alias("value_bool") if b is None else b.alias("value_bool"),
        F.lit(n).cast("double").alias("value_num") if n is None else n.alias("value_num"),
        F.lit(s).cast("string").alias("value_str"), F.lit(r).cast("string").alias("rationale"))
    feedback = (row(labels, "doc_id", "quality", F.lit("HUMAN"), b=F.col("quality") == 1)
                .unionByName(row(docs, "doc_id", "length", F.lit("LLM_JUDGE"), n=F.col("n_chars") / 1000, r="by length"))
                .unionByName(row(labels, "doc_id", "comment", F.when(F.col("toxic") == 1, F.lit("HUMAN"))
                                 .otherwise(F.lit("LLM_JUDGE")), s="seen")))
    return rounded(ev.feedback_rollup(feedback), ["mean"], 9)


@query("expectation_lookup", """
SELECT doc_id, length(text) <= 2000 AS length_ok, CAST(len(list_filter(['The', 'and', source], lambda e: strpos(lower(text), lower(e)) = 0)) AS INTEGER)
       AS missing, length(text) <= 2000 AND len(list_filter(['The', 'and', source], lambda e: strpos(lower(text), lower(e)) = 0)) = 0 AS passed
FROM documents JOIN labels USING (doc_id)""")
def q_expectation_lookup(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "source", "text")
    wanted = load_table(spark, sf, "labels").select("doc_id").join(docs.select("doc_id", "source"), "doc_id").select(
        "doc_id", F.struct(F.lit(2000).alias("max_response_length"),
                           F.array(F.lit("The"), F.lit("and"), F.col("source")).alias("required_elements")).alias("expectation"))
    out = ev.expectation_lookup(docs.select("doc_id", "text"), wanted, "doc_id", "text")
    return out.select("doc_id", "length_ok", F.size("missing_elements").alias("missing"), "passed")


@query("label_schema_check", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'awful' ELSE 'poor' END AS label FROM labels
WHERE quality = 0 AND toxic = 1""")
def q_label_schema(spark, sf):
    label = F.when(F.col("quality") == 1, F.lit("good")).when(F.col("toxic") == 1, F.lit("awful")).otherwise(F.lit("poor"))
    labels = load_table(spark, sf, "labels").select("doc_id", label.alias("label"))
    return ev.label_schema_check(labels, "label", ["poor", "fair", "good", "excellent"])


# ---------------------------------------------------------------- prompts and sessions

LOG_SQL = f"""v AS ({PROMPT_SQL}), l AS (SELECT p_name AS prompt_name, o_orderpriority AS alias, p_partkey AS version,
    o_orderdate AS ts, o_orderkey AS seq FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""


def alias_log(spark, sf):
    """Each order moves one alias of a prompt to one of its versions."""
    parts = load_table(spark, sf, "part").select("p_partkey", "p_name")
    orders = load_table(spark, sf, "orders").withColumn(
        "p_partkey", F.col("o_orderkey") % parts.agg(F.count(F.lit(1))).scalar())
    return orders.join(parts, "p_partkey").select(
        F.col("p_name").alias("prompt_name"), F.col("o_orderpriority").alias("alias"), F.col("p_partkey").alias("version"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


@query("prompt_registry", f"""WITH {LOG_SQL},
 r AS (SELECT prompt_name, alias, version, row_number() OVER (PARTITION BY prompt_name, alias ORDER BY ts DESC, seq DESC) AS n FROM l),
 cur AS (SELECT prompt_name, alias, version FROM r WHERE n = 1), old AS (SELECT prompt_name, alias, version FROM r WHERE n = 2)
SELECT cur.prompt_name, cur.alias, cur.version, v.prompt_text, old.version AS rollback_version
FROM cur JOIN v USING (prompt_name, version) LEFT JOIN old ON old.prompt_name = cur.prompt_name AND old.alias = cur.alias""")
def q_prompt_registry(spark, sf):
    log = alias_log(spark, sf)
    return registry.current_prompts(prompt_versions(spark, sf), log).select(
        "prompt_name", "alias", "version", "prompt_text", "rollback_version")


@query("prompt_versions", """
SELECT p_name AS prompt_name, count(*) + 0 AS version, 'text of ' || p_name AS prompt_text FROM part GROUP BY p_name""")
def q_prompt_versions(spark, sf):
    numbered = load_table(spark, sf, "part").groupBy(F.col("p_name").alias("prompt_name")).agg(
        (F.count(F.lit(1)) - 1).alias("version"))
    new = numbered.select("prompt_name", F.concat(F.lit("text of "), F.col("prompt_name")).alias("prompt_text"))
    return registry.register_version(numbered, new)


@query("session_rollup", """
SELECT user_id AS session, count(*) AS turns, min(event_id) AS first, max(event_id) AS last, min_by(event_type, event_id) AS user
FROM events GROUP BY 1""")
def q_session_rollup(spark, sf):
    events = load_table(spark, sf, "events").withColumnRenamed("user_id", "session")
    return registry.session_rollup(events, "session", "event_id", F.col("event_type"))
