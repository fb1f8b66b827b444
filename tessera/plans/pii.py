"""Queries over personal data in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import pii
from tessera.functions.core import rows_of
from tessera.operators import pii as ops
from tessera.plans import sqltext
from tessera.plans.registry import query
from tessera.sources.readers import heavy_table

EMAIL, CARD, PHONE, KEY = (pii.DETECTORS[0].pattern, "[0-9]{16}", pii.DETECTORS[3].pattern, "[0-9a-f]{40}")

LUHN_SQL = """list_sum(list_transform(range(1, length(regexp_replace(v, '[^0-9]', '', 'g')) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS INTEGER)
       WHEN CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS INTEGER) > 4
       THEN CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS INTEGER) * 2 - 9
       ELSE CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS INTEGER) * 2 END)) % 10 = 0"""


def detector_sql(d: pii.Detector) -> str:
    kind = f"CASE WHEN {LUHN_SQL} THEN '{d.entity_type}' ELSE '{d.fallback}' END" if d.luhn else f"'{d.entity_type}'"
    return (f"list_transform(regexp_extract_all(text, '{d.pattern}', {d.group}), "
            f"lambda v: {{'pos': strpos(text, v), 'entity_type': {kind}, 'original_value': v}})")


_found = detector_sql(pii.DETECTORS[0])
for _d in pii.DETECTORS[1:]:
    _found = f"list_concat({_found}, {detector_sql(_d)})"
# found: entities in order; salted: with ids; truths: entities of the annotated spans.
FOUND_SQL = f"found AS (SELECT doc_id, source, text, list_sort({_found}) AS es FROM documents)"
SALT_SQL = f"""{FOUND_SQL},
 firsts AS (SELECT doc_id, e.entity_type AS t, e.original_value AS v, min(n) AS first FROM (
     SELECT doc_id, unnest(es) AS e, generate_subscripts(es, 1) AS n FROM found) GROUP BY 1, 2, 3),
 ids AS (SELECT doc_id, t, v, t || '_' || printf('%03d', row_number() OVER (PARTITION BY doc_id, t ORDER BY first)) AS salt_id FROM firsts),
 ents AS (SELECT doc_id, e.n AS n, e.e.entity_type AS entity_type, e.e.original_value AS original_value, salt_id FROM (
     SELECT doc_id, {{'e': unnest(es), 'n': generate_subscripts(es, 1)}} AS e FROM found) x
     JOIN ids USING (doc_id) WHERE ids.t = x.e.e.entity_type AND ids.v = x.e.e.original_value),
 salted AS (SELECT f.doc_id, f.source, f.text, coalesce(s.es, []) AS es FROM found f LEFT JOIN (
     SELECT doc_id, list({{'entity_type': entity_type, 'original_value': original_value, 'salt_id': salt_id}} ORDER BY n) AS es
     FROM ents GROUP BY 1) s USING (doc_id))"""
TRUTH_SQL = f"""truths AS (SELECT doc_id, list_concat(list_concat(list_concat(
     list_transform(regexp_extract_all(text, '{EMAIL}'), lambda v: {{'type': 'EMAIL', 'value': v}}),
     list_transform(regexp_extract_all(text, '{CARD}'), lambda v: {{'type': 'CREDIT_CARD', 'value': v}})),
     list_transform(regexp_extract_all(text, '{PHONE}'), lambda v: {{'type': 'PHONE', 'value': v}})),
     list_transform(regexp_extract_all(text, '{KEY}'), lambda v: {{'type': 'OTHER', 'value': v}})) AS gs FROM documents)"""


def mask_sql(text: str, es: str) -> str:
    return f"""list_reduce(list_transform(list_sort(list_transform({es}, lambda e, i: {{'l': -length(e.original_value), 'i': i,
        'v': e.original_value, 's': e.salt_id}})), lambda e: {{'v': e.v, 's': e.s}}),
        lambda a, e: {{'v': replace(a.v, e.v, e.s), 's': ''}}, {{'v': {text}, 's': ''}}).v"""


def docs(spark, sf):
    return heavy_table(spark, sf, "documents")


def salted(spark, sf):
    return ops.pii_salt(ops.pii_detect(docs(spark, sf), "text"))


def spans(spark, sf):
    """Annotated spans as a data set would hold them: JSON, or a Python literal for every third document."""
    text = F.col("text")
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = lambda t: F.lit(None).cast(t)

    def span(pattern, label=None, kind=None, by="text"):
        def one(v):
            start = F.instr(text, v) - 1
            return F.struct(
                (F.lit(label) if label else none("string")).alias("label"), (F.lit(kind) if kind else none("string")).alias("type"),
                (v if by == "text" else none("string")).alias("text"), (v if by == "value" else none("string")).alias("value"),
                (start if by == "range" else none("int")).alias("start"),
                (start + F.char_length(v) if by == "range" else none("int")).alias("end"))
        return F.transform(every(pattern), one)

    json = F.to_json(F.concat(span(EMAIL, label=" Email "), span(CARD, kind="credit_card_number", by="value"),
                              span(PHONE, label="phone", by="range"), span(KEY, label="api_key")))
    shown = F.when(F.col("doc_id") % 3 == 0, F.translate(json, '"', "'")).otherwise(json)
    return docs(spark, sf).withColumn("spans", shown)


def predictions(entities):
    return F.transform(entities, lambda e: F.struct(e["entity_type"].alias("type"), e["original_value"].alias("value")))


@query("pii_label_map", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'BANK_ACCOUNT' WHEN 2 THEN 'DATE_OF_BIRTH' ELSE 'OTHER' END
       AS entity_type FROM part""")
def q_label_map(spark, sf):
    from tessera.sources.readers import load_table

    form = F.col("p_partkey") % 4
    label = F.when(form == 0, F.lit(" Email_Address")).when(form == 1, F.lit("iban")).when(
        form == 2, F.lit("DOB\n")).otherwise(F.col("p_name"))
    return load_table(spark, sf, "part").select("p_partkey", pii.label_type(label).alias("entity_type"))


@query("pii_truth", f"""WITH {TRUTH_SQL}
SELECT doc_id, array_to_string(list_transform(gs, lambda g: g.type || '=' || g.value), ';') AS entities FROM truths""")
def q_truth(spark, sf):
    found = pii.truth(F.col("spans"), F.col("text"))
    return spans(spark, sf).select("doc_id", F.array_join(F.transform(
        found, lambda e: F.concat_ws("=", e["type"], e["value"])), ";").alias("entities"))


@query("pii_truth_literals", f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{EMAIL}'), lambda v: 'EMAIL=' || CASE doc_id % 4
  WHEN 2 THEN 'it''s "' || v || '" \\' WHEN 3 THEN v || '''s (None,)' ELSE v END), ';') AS entities FROM documents""")
def q_truth_literals(spark, sf):
    """Spans as Python shows them: None with a range, a tuple with True, escapes, and both kinds of quotes."""
    text, form = F.col("text"), F.col("doc_id") % 4

    def one(v):
        start = F.instr(text, v) - 1
        return (F.when(form == 0, F.format_string("{'label': 'email', 'text': None, 'start': %d, 'end': %d}", start, start + F.char_length(v)))
                .when(form == 1, F.format_string("{'label': 'email', 'checked': True, 'text': '%s'}", v))
                .when(form == 2, F.format_string("{'type': 'email', 'value': 'it\\'s \"%s\" \\\\'}", v))
                .otherwise(F.format_string("{\"label\": 'email', 'text': \"%s's (None,)\", 'ok': False,}", v)))

    shown = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), one), ", ")
    listed = F.when(shown == "", F.lit("()")).when(form == 1, F.concat(F.lit("("), shown, F.lit(",)"))).otherwise(F.concat(F.lit("["), shown, F.lit("]")))
    found = pii.truth(listed, text)
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(found, lambda e: F.concat_ws("=", e["type"], e["value"])), ";").alias("entities"))


@query("pii_detect", f"""WITH {FOUND_SQL}
SELECT doc_id, array_to_string(list_transform(es, lambda e: e.entity_type || '=' || e.original_value), ';') AS entities FROM found""")
def q_detect(spark, sf):
    return ops.pii_detect(docs(spark, sf), "text").select("doc_id", F.array_join(F.transform(
        "entities", lambda e: F.concat_ws("=", e["entity_type"], e["original_value"])), ";").alias("entities"))


@query("pii_salt", f"""WITH {SALT_SQL}
SELECT doc_id, array_to_string(list_transform(es, lambda e: e.salt_id || '=' || e.original_value), ';') AS entities FROM salted""")
def q_salt(spark, sf):
    return salted(spark, sf).select("doc_id", F.array_join(F.transform(
        "entities", lambda e: F.concat_ws("=", e["salt_id"], e["original_value"])), ";").alias("entities"))


@query("entity_numbering", f"""WITH {SALT_SQL} SELECT doc_id, entity_type, original_value, salt_id FROM ents""")
def q_numbering(spark, sf):
    rows = ops.pii_detect(docs(spark, sf), "text")
    rows = rows_of(rows, ["doc_id"], F.col("entities"), "e").select("doc_id", "e.*")
    return ops.entity_numbering(rows, "doc_id", "entity_type", "original_value", "pos").select(
        "doc_id", "entity_type", "original_value", "salt_id")


@query("pii_mask", f"""WITH {SALT_SQL} SELECT doc_id, md5({mask_sql('text', 'es')}) AS digest FROM salted""")
def q_mask(spark, sf):
    return salted(spark, sf).select("doc_id", F.md5(pii.mask(F.col("text"), F.col("entities"))).alias("digest"))


NORM = sqltext.strip("lower({v})")


def _norm(v: str) -> str:
    return f"replace(replace({NORM.format(v=v)}, '-', ''), ' ', '')"


FREE = f"""list_filter(range(1, len(gs) + 1), lambda j: NOT s.used[j] AND (p.t = gs[j].type OR gs[j].type = 'OTHER')
   AND (strpos({_norm('gs[j].value')}, p.v) > 0 OR strpos(p.v, {_norm('gs[j].value')}) > 0))[1]"""
MATCH_SQL = f"""{FOUND_SQL}, {TRUTH_SQL},
 m AS (SELECT doc_id, source, len(es) AS num_entities, len(gs) AS gt_count, list_reduce(list_transform(es, lambda e: {{'t': e.entity_type, 'v': {_norm('e.original_value')},
     'used': []::BOOLEAN[], 'tp': 0, 'fp': 0}}), lambda s, p: {{'t': '', 'v': '',
     'used': list_transform(s.used, lambda u, i: u OR coalesce(i = {FREE}, false)),
     'tp': s.tp + CASE WHEN {FREE} IS NULL THEN 0 ELSE 1 END, 'fp': s.fp + CASE WHEN {FREE} IS NULL THEN 1 ELSE 0 END}},
     {{'t': '', 'v': '', 'used': list_transform(gs, lambda g: false), 'tp': 0, 'fp': 0}}) AS r FROM found JOIN truths USING (doc_id)),
 c AS (SELECT doc_id, source, num_entities, gt_count, r.tp AS tp, r.fp AS fp, CAST(len(list_filter(r.used, lambda u: NOT u)) AS INTEGER) AS fn FROM m),
 pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c),
 sc AS (SELECT doc_id, num_entities, gt_count, tp, fp, fn, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE p END AS precision,
     CASE WHEN tp + fp + fn = 0 THEN 1 ELSE r END AS recall,
     CASE WHEN tp + fp + fn = 0 THEN 1 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""


def scored(spark, sf):
    both = ops.pii_detect(spans(spark, sf), "text").withColumn("truth", pii.truth(F.col("spans"), F.col("text")))
    both = both.withColumn("predicted", predictions(F.col("entities")))
    return ops.pii_doc_scores(both, "predicted", "truth").withColumn("num_entities", F.size("entities")).withColumn(
        "gt_count", F.size("truth"))


@query("pii_match", f"WITH {MATCH_SQL} SELECT doc_id, tp, fp, fn FROM c")
def q_match(spark, sf):
    return scored(spark, sf).select("doc_id", "tp", "fp", "fn")


@query("pii_doc_scores", f"""WITH {MATCH_SQL}
SELECT doc_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sc""")
def q_doc_scores(spark, sf):
    return scored(spark, sf).select("doc_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("micro_macro_prf", f"""WITH {MATCH_SQL},
 a AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf FROM sc)
SELECT tp, fp, fn, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1,
  round(tp / (tp + fp), 9) AS micro_precision, round(tp / (tp + fn), 9) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 9) AS micro_f1 FROM a""")
def q_micro_macro(spark, sf):
    from tessera.operators.aggregates import micro_macro_prf

    out = micro_macro_prf(scored(spark, sf))
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in out.columns if c[:5] in ("micro", "macro")])


RAW_OK = "doc_id % 17 <> 0"


def results(spark, sf):
    """Result rows of a model whose answer is cut off for every 17th document."""
    found = ops.pii_salt(ops.pii_detect(spans(spark, sf), "text")).withColumn("truth", pii.truth(F.col("spans"), F.col("text")))
    answer = F.to_json(F.struct((F.size("entities") > 0).alias("has_pii"), "entities"))
    raw = F.when(F.col("doc_id") % 17 == 0, F.concat(answer, F.lit("]"))).otherwise(answer)
    answered = found.withColumn("raw", raw).drop("entities")
    return ops.pii_result_table(answered, "doc_id", "source", "text", "raw", "truth", "patterns", F.char_length("raw"))


@query("pii_result_table", f"""WITH {SALT_SQL}, {TRUTH_SQL}
SELECT doc_id, 'patterns' AS model_id, source AS document_type, CASE WHEN {RAW_OK} THEN md5({mask_sql('text', 'es')}) ELSE md5(text) END AS masked,
  {RAW_OK} AND len(es) > 0 AS has_pii, CAST(CASE WHEN {RAW_OK} THEN len(es) ELSE 0 END AS INTEGER) AS num_entities,
  CASE WHEN {RAW_OK} THEN '[' || array_to_string(list_transform(es, lambda e: '{{"entity_type":"' || e.entity_type || '","original_value":"'
     || e.original_value || '","salt_id":"' || e.salt_id || '"}}'), ',') || ']' ELSE '[]' END AS entities_json,
  CAST(len(gs) AS INTEGER) AS gt_count, {RAW_OK} AS parse_ok FROM salted JOIN truths USING (doc_id)""")
def q_result_table(spark, sf):
    return results(spark, sf).select(
        "doc_id", "model_id", "document_type", F.md5("masked_text").alias("masked"), "has_pii", "num_entities",
        "entities_json", "gt_count", "parse_ok")


@query("parse_success", f"""WITH {FOUND_SQL}, {TRUTH_SQL}
SELECT count(*) FILTER ({RAW_OK}) AS ok, count(*) AS total, count(*) FILTER (NOT ({RAW_OK})) AS errors,
  CAST(sum(CASE WHEN {RAW_OK} THEN len(es) ELSE 0 END) AS BIGINT) AS detected, CAST(sum(len(gs)) AS BIGINT) AS truth
FROM found JOIN truths USING (doc_id)""")
def q_parse_success(spark, sf):
    from tessera.operators.aggregates import parse_success

    return parse_success(results(spark, sf))


@query("pii_report", f"""WITH {MATCH_SQL},
 k AS (SELECT doc_id, gt_count, CASE WHEN {RAW_OK} THEN num_entities ELSE 0 END AS num_entities, CASE WHEN {RAW_OK} THEN tp ELSE 0 END AS tp,
   CASE WHEN {RAW_OK} THEN fp ELSE 0 END AS fp, CASE WHEN {RAW_OK} THEN fn ELSE gt_count END AS fn,
   CASE WHEN {RAW_OK} THEN precision WHEN gt_count = 0 THEN 1 ELSE 0 END AS p, CASE WHEN {RAW_OK} THEN recall WHEN gt_count = 0 THEN 1 ELSE 0 END AS r,
   CASE WHEN {RAW_OK} THEN f1 WHEN gt_count = 0 THEN 1 ELSE 0 END AS f FROM sc)
SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(p), 9) AS macro_precision,
  round(avg(r), 9) AS macro_recall, round(avg(f), 9) AS macro_f1, round(sum(tp) / sum(tp + fp), 9) AS micro_precision,
  round(sum(tp) / sum(tp + fn), 9) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 9) AS micro_f1,
  count(*) FILTER ({RAW_OK}) AS ok, count(*) AS total, count(*) FILTER (NOT ({RAW_OK})) AS errors,
  CAST(sum(num_entities) AS BIGINT) AS detected, CAST(sum(gt_count) AS BIGINT) AS truth FROM k""")
def q_report(spark, sf):
    rows = results(spark, sf).withColumn("predicted", predictions(F.col("entities")))
    out = ops.pii_report(ops.pii_doc_scores(rows, "predicted", "truth"))
    return out.select(*[F.round(c, 9).alias(c) if c[:5] in ("micro", "macro") else F.col(c) for c in out.columns])


@query("pii_counts_by_type", f"""WITH {FOUND_SQL}
SELECT e.entity_type AS entity_type, count(*) AS n FROM (SELECT unnest(es) AS e FROM found) GROUP BY 1""")
def q_counts_by_type(spark, sf):
    return ops.counts_by_type(ops.pii_detect(docs(spark, sf), "text"))
