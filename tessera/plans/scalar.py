"""Queries over text, JSON and scoring expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import responses, scoring, text
from tessera.plans.registry import query
from tessera.plans.sqltext import strip as strip_sql
from tessera.sources.readers import heavy_table, load_table

@query("file_name", "SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS name FROM pages")
def q_file_name(spark, sf):
    return load_table(spark, sf, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


@query("title_text_concat", f"""
SELECT doc_id, left({strip_sql("' ' || source")}, 512) AS title, md5(t) AS digest, length(t) AS chars
FROM (SELECT doc_id, source, left(trim(' ' || source || ' -- ' || text, ' -'), 2048) AS t FROM documents)""")
def q_title_text(spark, sf):
    short, joined = text.title_text(F.concat(F.lit(" "), F.col("source")), F.col("text"))
    return heavy_table(spark, sf, "documents").select(
        "doc_id", short.alias("title"), F.md5(joined).alias("digest"),
        F.char_length(joined).cast("bigint").alias("chars"))


@query("compose_prompt", """
SELECT doc_id, md5('Source: ' || source || chr(10) || 'Language: ' || lang || chr(10) || 'Text: ' || text) AS digest
FROM documents""")
def q_compose_prompt(spark, sf):
    prompt = text.compose_prompt("Source: {source}\nLanguage: {lang}\nText: {body}", source=F.col("source"),
                                 lang=F.col("lang"), body=F.col("text"))
    return heavy_table(spark, sf, "documents").select("doc_id", F.md5(prompt).alias("digest"))


@query("truncate_for_model", """
SELECT doc_id, md5(left(text, 8000)) AS model_input, left(text, 200) AS echo FROM documents""")
def q_truncate(spark, sf):
    return heavy_table(spark, sf, "documents").select(
        "doc_id", F.md5(text.truncate(F.col("text"), 8000)).alias("model_input"),
        text.truncate(F.col("text"), 200).alias("echo"))


@query("token_estimate", r"""
SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS by_chars,
       CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INTEGER) AS by_words FROM documents""")
def q_token_estimate(spark, sf):
    return heavy_table(spark, sf, "documents").select(
        "doc_id", text.token_estimate(F.col("text")).alias("by_chars"),
        text.token_estimate(F.col("text"), "words").alias("by_words"))


@query("parsed_elements_to_text", "SELECT doc_id, md5(text) AS digest FROM documents")
def q_elements(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("content"), F.lit("text").alias("type")))
    tree = F.to_json(F.struct(F.struct(lines.alias("elements")).alias("document")))
    return heavy_table(spark, sf, "documents").select("doc_id", tree.alias("parsed")).select(
        "doc_id", F.md5(responses.elements_to_text(F.col("parsed"))).alias("digest"))


@query("clean_model_json", """
SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events""")
def q_clean_json(spark, sf):
    fenced = F.concat(F.lit("```json\n{\"kind\": \""), F.col("event_type"), F.lit("\", \"props\": "), F.col("props"),
                      F.lit("}\n```"))
    events = heavy_table(spark, sf, "events").select("event_id", responses.clean_model_json(fenced).alias("answer"))
    return events.select("event_id", F.get_json_object("answer", "$.kind").alias("kind"),
                         F.get_json_object("answer", "$.props.k").alias("k"))


ANSWER_SQL = """SELECT event_id, CASE
    WHEN event_type = 'error' THEN '{"entity_type": "' || event_type || '", "score": '
    WHEN event_type = 'view' THEN '{"entity_type": "' || event_type || '", "score": "high", "note": 1}'
    WHEN event_type = 'signup' THEN '{"entity_type": "' || event_type || '"}'
    ELSE '{"entity_type": "' || event_type || '", "score": ' || json_extract_string(props, '$.k') || '}' END AS answer
  FROM events"""


def answers(spark, sf):
    """JSON answers of several qualities: broken, wrong type and extra key, missing key, good."""
    head = F.concat(F.lit('{"entity_type": "'), F.col("event_type"), F.lit('"'))
    kind = F.col("event_type")
    answer = (F.when(kind == "error", F.concat(head, F.lit(', "score": ')))
              .when(kind == "view", F.concat(head, F.lit(', "score": "high", "note": 1}')))
              .when(kind == "signup", F.concat(head, F.lit("}")))
              .otherwise(F.concat(head, F.lit(', "score": '), F.get_json_object("props", "$.k"), F.lit("}"))))
    return heavy_table(spark, sf, "events").select("event_id", answer.alias("answer"))


@query("parse_response", f"""
SELECT event_id, json_valid(answer) AS parse_ok,
       CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.entity_type') END AS entity_type,
       CASE WHEN json_valid(answer) THEN TRY_CAST(json_extract_string(answer, '$.score') AS DOUBLE) END AS score
FROM ({ANSWER_SQL})""")
def q_parse_response(spark, sf):
    value, ok = responses.parse_response(F.col("answer"), "entity_type string, score double")
    return answers(spark, sf).select("event_id", ok.alias("parse_ok"), value.alias("v")).select(
        "event_id", "parse_ok", "v.entity_type", "v.score")


@query("validate_response", f"""
SELECT event_id, array_to_string(list_filter(CASE WHEN NOT json_valid(answer) THEN ['not_object'] ELSE [
    CASE WHEN json_extract_string(answer, '$.entity_type') NOT IN ('click', 'view', 'signup')
         THEN 'choice:entity_type' END,
    CASE WHEN json_type(answer, '$.score') IS NULL THEN 'missing:score' END,
    CASE WHEN json_type(answer, '$.score') = 'VARCHAR' THEN 'type:score' END,
    CASE WHEN json_type(answer, '$.score') <> 'VARCHAR' AND CAST(json_extract_string(answer, '$.score') AS DOUBLE) > 90
         THEN 'range:score' END,
    CASE WHEN json_type(answer, '$.note') IS NOT NULL THEN 'extra:note' END] END, lambda x: x IS NOT NULL), ',')
    AS violations FROM ({ANSWER_SQL})""")
def q_validate(spark, sf):
    rules = [responses.FieldRule("entity_type", "string", choices=("click", "view", "signup")),
             responses.FieldRule("score", "number", low=0, high=90)]
    return answers(spark, sf).select(
        "event_id", F.array_join(responses.validate_response(F.col("answer"), rules), ",").alias("violations"))


@query("json_or_list_coerce", """
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 1 WHEN event_type = 'click' THEN 2 ELSE 0 END AS items,
       CASE WHEN event_type IN ('error', 'view', 'click') THEN CAST(json_extract_string(props, '$.k') AS BIGINT)
       END AS first_k FROM events""")
def q_coerce(spark, sf):
    kind, props = F.col("event_type"), F.col("props")
    outputs = (F.when(kind == "error", props)
               .when(kind == "view", F.concat(F.lit("["), props, F.lit(", 7]")))
               .when(kind == "click", F.concat(F.lit("["), props, F.lit(", "), props, F.lit("]")))
               .when(kind == "signup", F.lit("no json")).otherwise(F.lit("12")))
    items = responses.as_list(outputs, "struct<k bigint>")
    return heavy_table(spark, sf, "events").select("event_id", items.alias("items")).select(
        "event_id", F.size("items").alias("items"), F.get("items", F.lit(0))["k"].alias("first_k"))


@query("arxiv_id_normalize", r"""
SELECT page_id, regexp_replace('2301.' || page_id || 'v' || page_id % 7, 'v[0-9]+$', '') AS paper_id,
       replace(trim(html), chr(10), ' ') = replace(html, chr(10), ' ') AS same FROM pages""")
def q_paper_id(spark, sf):
    url = F.concat(F.lit("http://papers.example.org/abs/2301."), F.col("page_id"), F.lit("v"), F.col("page_id") % 7)
    return load_table(spark, sf, "pages").select(
        "page_id", text.paper_id(url).alias("paper_id"),
        (text.one_line(F.col("html")) == F.replace("html", F.lit("\n"), F.lit(" "))).alias("same"))


@query("normalize_value", f"""
SELECT doc_id, md5(replace(replace({strip_sql('lower(text)')}, '-', ''), ' ', '')) AS digest FROM documents""")
def q_normalize_value(spark, sf):
    return heavy_table(spark, sf, "documents").select(
        "doc_id", F.md5(scoring.normalize_value(F.col("text"))).alias("digest"))


@query("normalize_field", f"""
SELECT doc_id, md5(replace(replace(replace({strip_sql("lower('  Commercial ' || text || chr(10))")}, 'commercial ', ''),
       '''', ''), '  ', ' ')) AS digest FROM documents""")
def q_normalize_field(spark, sf):
    padded = F.concat(F.lit("  Commercial "), F.col("text"), F.lit("\n"))
    return heavy_table(spark, sf, "documents").select(
        "doc_id", F.md5(scoring.normalize_field(padded)).alias("digest"))


@query("strip_ws", f"""
SELECT doc_id, md5({strip_sql("chr(10) || chr(9) || text || chr(160) || chr(13)")}) AS digest FROM documents""")
def q_strip(spark, sf):
    padded = F.concat(F.lit("\n\t"), F.col("text"), F.lit("\xa0\r"))
    return heavy_table(spark, sf, "documents").select("doc_id", F.md5(text.strip_ws(padded)).alias("digest"))


DATE_SQL = """SELECT o_orderkey, o_orderdate, CASE o_orderkey % 5
    WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, ' %m-%d-%y')
    WHEN 2 THEN strftime(o_orderdate, '%m.%d.%Y at noon') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
    ELSE strftime(o_orderdate, '%m/%d/%Y') END AS shown FROM orders"""


def dated(spark, sf):
    """Order dates written in several ways, one of them not readable as a US date."""
    fmt = lambda f: F.date_format("o_orderdate", f)
    form = F.col("o_orderkey") % 5
    shown = (F.when(form == 1, fmt(" MM-dd-yy")).when(form == 2, F.concat(fmt("MM.dd.yyyy"), F.lit(" at noon")))
             .when(form == 3, fmt("yyyy-MM-dd")).otherwise(fmt("MM/dd/yyyy")))
    return heavy_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", shown.alias("shown"))


@query("parse_us_date", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 3 THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
       CASE WHEN o_orderkey % 5 <> 3 THEN CAST(day(o_orderdate) AS INTEGER) END AS day,
       CASE WHEN o_orderkey % 5 <> 3 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM ({DATE_SQL})""")
def q_parse_us_date(spark, sf):
    return dated(spark, sf).select("o_orderkey", scoring.parse_us_date(F.col("shown")).alias("d")).select(
        "o_orderkey", "d.month", "d.day", "d.year")


@query("elapsed_seconds", """
SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0 AS seconds FROM events""")
def q_elapsed(spark, sf):
    return heavy_table(spark, sf, "events").select(
        "event_id", text.elapsed_seconds(F.lit("2024-01-01 00:00:00"), F.col("ts")).alias("seconds"))


@query("content_hash_id", "SELECT doc_id, md5(text) AS chunk_id FROM documents")
def q_content_id(spark, sf):
    return heavy_table(spark, sf, "documents").select("doc_id", text.content_id(F.col("text")).alias("chunk_id"))


@query("tokenize_words", r"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS words, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)""")
def q_tokenize(spark, sf):
    return heavy_table(spark, sf, "documents").select("doc_id", text.tokenize_words(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").alias("words"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("extract_citations", """
SELECT doc_id, source || CASE WHEN source <> 'v' || lang THEN ',v' || lang ELSE '' END AS cited FROM documents""")
def q_citations(spark, sf):
    answer = F.concat(F.lit("See [arxiv:"), F.col("source"), F.lit("] and [ArXiv:v"), F.col("lang"), F.lit("] and [arxiv:"),
                      F.col("source"), F.lit("]. "), F.col("text"))
    return heavy_table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.extract_citations(answer), ",").alias("cited"))


# ---------------------------------------------------------------- scores

NORM_SQL = "replace(replace(replace({s}, 'commercial ', ''), '''', ''), '  ', ' ')"


def norm_sql(expr: str) -> str:
    return NORM_SQL.format(s=strip_sql(f"lower({expr})"))


@query("score_text", f"""
WITH p AS (SELECT p_partkey, p_name AS e,
    CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' ' WHEN 1 THEN 'Commercial ' || p_name
         WHEN 2 THEN p_name || ' ' || p_brand ELSE p_brand END AS x FROM part),
 n AS (SELECT p_partkey, {norm_sql('e')} AS e, {norm_sql('x')} AS x FROM p)
SELECT p_partkey, CAST(CASE WHEN e = x THEN 1.0 WHEN strpos(e, x) > 0 OR strpos(x, e) > 0 THEN 0.8 ELSE 0 END AS DOUBLE)
       AS score FROM n""")
def q_score_text(spark, sf):
    form, name, brand = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand")
    found = (F.when(form == 0, F.concat(F.upper(name), F.lit(" "))).when(form == 1, F.concat(F.lit("Commercial "), name))
             .when(form == 2, F.concat_ws(" ", name, brand)).otherwise(brand))
    return load_table(spark, sf, "part").select("p_partkey", scoring.score_text(found, name).alias("score"))


@query("score_null", """
SELECT event_id, CAST(CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS DOUBLE) AS score
FROM events""")
def q_score_null(spark, sf):
    kind = F.col("event_type")
    found = (F.when(kind == "view", F.lit("null")).when(kind == "click", F.lit(""))
             .when(kind == "signup", F.lit(None)).otherwise(F.col("props")))
    return heavy_table(spark, sf, "events").select(
        "event_id", scoring.score_text(found, F.lit(None).cast("string")).alias("score"))


@query("score_list", """
WITH p AS (SELECT p_partkey, [p_brand, p_type] AS e, CASE p_partkey % 4 WHEN 0 THEN [p_type, p_brand]
    WHEN 1 THEN [p_name, lower(p_type), 'x', 'y', 'z', 'q', 'w'] WHEN 2 THEN [] ELSE [p_name] END AS x FROM part),
 m AS (SELECT p_partkey, len(x) AS nx, len(list_filter(e, lambda v: len(list_filter(x,
           lambda w: strpos(lower(w), lower(v)) > 0 OR strpos(lower(v), lower(w)) > 0)) > 0)) AS hits FROM p)
SELECT p_partkey, round(CASE WHEN nx = 0 THEN 0.0
    ELSE greatest(0.0, hits / 2 - least(0.2, 0.05 * greatest(0, nx - hits))) END, 6) AS score FROM m""")
def q_score_list(spark, sf):
    form, name, brand, kind = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand"), F.col("p_type")
    found = (F.when(form == 0, F.array(kind, brand))
             .when(form == 1, F.array(name, F.lower(kind), *[F.lit(c) for c in "xyzqw"]))
             .when(form == 2, F.array().cast("array<string>")).otherwise(F.array(name)))
    score = scoring.score_list(found, F.array(brand, kind))
    return load_table(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("score_list_answer", """
SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 6 > 2 THEN 1 ELSE 0 END
  WHEN p_partkey % 6 IN (3, 4) THEN 0 WHEN p_partkey % 7 < 4 THEN CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 END
  WHEN p_partkey % 6 = 0 THEN 0.95 ELSE 0 END AS DOUBLE) AS score FROM part""")
def q_score_list_answer(spark, sf):
    """Answers with a list, a text, a number, null, no such key and an empty text, against nothing, an empty list and one item."""
    form, brand = F.col("p_partkey") % 6, F.col("p_brand")
    answer = (F.when(form == 0, F.to_json(F.struct(F.array(brand, F.col("p_type")).alias("tags"))))
              .when(form == 1, F.to_json(F.struct(brand.alias("tags")))).when(form == 2, F.lit('{"tags": 7}'))
              .when(form == 3, F.lit('{"tags": null}')).when(form == 4, F.lit("{}")).otherwise(F.lit('{"tags": ""}')))
    expected = F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).when(
        F.col("p_partkey") % 7 < 4, F.array().cast("array<string>")).otherwise(F.array(brand))
    rows = load_table(spark, sf, "part").select("p_partkey", F.from_json(answer, "tags variant").alias("extracted"), F.struct(expected.alias("tags")).alias("expected"))
    scored = scoring.score_extraction(rows, {"tags": "list"})
    return scored.select("p_partkey", F.round("score_tags", 6).alias("score"))


@query("score_date", f"""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 <> 3 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM ({DATE_SQL})""")
def q_score_date(spark, sf):
    expected = F.date_format("o_orderdate", "M/d/yyyy")
    return dated(spark, sf).select("o_orderkey", scoring.score_date(F.col("shown"), expected).alias("score"))


@query("nonempty_score", f"""
SELECT round(avg(CASE WHEN {strip_sql("replace(text, 'e', '')")} <> '' THEN 1.0 ELSE 0.0 END), 6) AS average_score
FROM conversations""")
def q_nonempty(spark, sf):
    shown = F.replace("text", F.lit("e"), F.lit(""))
    return load_table(spark, sf, "conversations").agg(
        F.round(F.coalesce(F.avg(scoring.nonempty_score(shown)), F.lit(0.0)), 6).alias("average_score"))


LIST_RE = r"^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]+"
METRIC_SQL = f"""
WITH t AS (SELECT conv_id, turn, '- ' || replace(text, '. ', chr(10) || '- ') AS r FROM conversations),
 i AS (SELECT conv_id, turn, r, list_transform(list_filter(string_split(r, chr(10)),
        lambda s: regexp_matches(s, '{LIST_RE}')),
        lambda s: {strip_sql(f"regexp_replace(s, '{LIST_RE}', '')")}) AS items FROM t)
SELECT conv_id, turn, round((CAST(len(list_distinct(items)) = len(items) AS INTEGER)
       + CAST(len(items) > 0 AS INTEGER) + greatest((600 - length(r)) / 200.0, 0)) / 5.0, 6) AS score FROM i"""


@query("length_list_metric", METRIC_SQL)
def q_length_list(spark, sf):
    listed = F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit("\n- ")))
    return load_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.round(scoring.length_list_metric(listed), 6).alias("score"))
