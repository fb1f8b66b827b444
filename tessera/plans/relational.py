"""Queries over filters, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as agg
from tessera.operators import ranking, relational
from tessera.plans.registry import query
from tessera.sources.readers import load_table

# ---------------------------------------------------------------- filters


@query("param_filter", "SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def q_param_filter(spark, sf):
    return relational.param_filter(
        spark, "SELECT event_id, user_id, value FROM {events} WHERE event_type = :kind", {"kind": "click"},
        events=load_table(spark, sf, "events"))


@query("exact_lookup", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'""")
def q_exact_lookup(spark, sf):
    return relational.exact_lookup(load_table(spark, sf, "customer"), "c_name", "Customer#000000042",
                                   ["c_custkey", "c_name", "c_acctbal"])


@query("null_or_error_split", """
SELECT 'ok' AS part, event_id FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'error', event_id FROM events WHERE event_type = 'error'
UNION ALL SELECT 'n_ok', count(*) FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'n_error', count(*) FROM events WHERE event_type = 'error'""")
def q_split(spark, sf):
    events = load_table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.lit("ERROR: call failed")).otherwise("SUCCESS")
        .alias("status"))
    ok, bad, counts = relational.null_or_error_split(events, "status")
    tagged = ok.select(F.lit("ok").alias("part"), "event_id").unionByName(
        bad.select(F.lit("error").alias("part"), "event_id"))
    totals = counts.select(F.explode(F.array(
        F.struct(F.lit("n_ok").alias("part"), F.col("ok").alias("event_id")),
        F.struct(F.lit("n_error").alias("part"), F.col("errors").alias("event_id")))).alias("c")).select("c.*")
    return tagged.unionByName(totals)


@query("min_length_filter", """
WITH long AS (SELECT * FROM documents WHERE length(text) > 1000)
SELECT doc_id, source, n_chars FROM long WHERE doc_id > (SELECT min(doc_id) FROM long) AND source <> ''""")
def q_min_length(spark, sf):
    docs = load_table(spark, sf, "documents")
    return ranking.min_length_filter(docs, "text", 1000, "doc_id", "source").select("doc_id", "source", "n_chars")


@query("range_holdout", """
SELECT vec_id, label FROM embeddings
WHERE vec_id >= (SELECT CAST(floor(max(vec_id) * 0.9) AS BIGINT) FROM embeddings) ORDER BY vec_id LIMIT 200""")
def q_range_holdout(spark, sf):
    vectors = load_table(spark, sf, "embeddings").select("vec_id", "label")
    cutoff = vectors.agg(F.floor(F.max("vec_id") * 0.9)).scalar()
    return ranking.range_holdout(vectors, "vec_id", cutoff, 200)


@query("nested_field_filter", """
SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '69'""")
def q_nested(spark, sf):
    return relational.nested_field_filter(load_table(spark, sf, "events"), "props:$.k", "69").select(
        "event_id", "user_id")


@query("trace_search", """
SELECT event_id AS trace_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
WHERE user_id = 8 ORDER BY ts DESC, event_id LIMIT 25""")
def q_trace_search(spark, sf):
    events = load_table(spark, sf, "events")
    traces = events.select(
        F.col("event_id").alias("trace_id"), "ts",
        F.create_map(F.lit("session"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
        .alias("metadata"))
    return relational.trace_search(traces, "session", "8", 25).select(
        "trace_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


# ---------------------------------------------------------------- joins


@query("compare_outer", """
WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS accuracy FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
     b AS (SELECT l_orderkey AS k, sum(l_quantity) AS accuracy FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS order_key, a.accuracy AS accuracy_a, b.accuracy AS accuracy_b,
       round(b.accuracy - a.accuracy, 3) AS delta FROM a FULL JOIN b ON a.k = b.k""")
def q_compare_outer(spark, sf):
    items = load_table(spark, sf, "lineitem")
    run = lambda flag: (items.where(F.col("l_returnflag") == flag)
                        .groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sum("l_quantity").alias("accuracy")))
    both = relational.compare_outer(run("A"), run("R"), "order_key", ["accuracy"], ("_a", "_b"), "accuracy")
    return ranking.sort_by_delta(both, "delta", "order_key")


@query("usage_semi_join", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#17')""")
def q_usage_semi_join(spark, sf):
    return relational.usage_semi_join(
        load_table(spark, sf, "lineitem"), load_table(spark, sf, "part"), "l_partkey", "p_partkey",
        F.col("p_brand") == "Brand#17").select("l_orderkey", "l_linenumber", "l_quantity")


EXTRACTED_SQL = """SELECT doc_id,
    CASE WHEN strpos(text, '@') > 0 THEN 'broken {' ELSE '{"lang": "' || lang || '"}' END AS extracted FROM documents"""


def extracted_docs(spark, sf):
    """An answer per document; those with a mail address get an answer that is no JSON."""
    docs = load_table(spark, sf, "documents")
    answer = F.when(F.instr("text", "@") > 0, F.lit("broken {")).otherwise(
        F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('"}')))
    return docs.select("doc_id", answer.alias("extracted"))


@query("golden_inner_join", f"""
SELECT e.doc_id, e.extracted, l.quality FROM ({EXTRACTED_SQL}) e JOIN labels l USING (doc_id)
WHERE json_valid(e.extracted)""")
def q_golden_join(spark, sf):
    golden = load_table(spark, sf, "labels").select("doc_id", "quality")
    return relational.golden_inner_join(extracted_docs(spark, sf), golden, "doc_id")


@query("golden_missing", f"""
SELECT l.doc_id, l.quality FROM labels l
WHERE l.doc_id NOT IN (SELECT doc_id FROM ({EXTRACTED_SQL}) WHERE json_valid(extracted))""")
def q_golden_missing(spark, sf):
    golden = load_table(spark, sf, "labels").select("doc_id", "quality")
    return relational.golden_missing(golden, extracted_docs(spark, sf), "doc_id")


@query("model_matrix", """
SELECT doc_id, model_id FROM documents, (VALUES ('small'), ('medium'), ('large')) m(model_id)""")
def q_model_matrix(spark, sf):
    return relational.model_matrix(load_table(spark, sf, "documents").select("doc_id"), ["small", "medium", "large"])


PROMPT_SQL = """SELECT p_name AS prompt_name, CAST(p_partkey AS BIGINT) AS version, p_type AS prompt_text FROM part"""


def prompt_versions(spark, sf):
    return load_table(spark, sf, "part").select(
        F.col("p_name").alias("prompt_name"), F.col("p_partkey").alias("version"), F.col("p_type").alias("prompt_text"))


@query("alias_join", f"""
WITH v AS ({PROMPT_SQL}), a AS (SELECT prompt_name, max(version) AS version FROM v GROUP BY 1)
SELECT v.prompt_name, v.version, v.prompt_text FROM v JOIN a USING (prompt_name, version)""")
def q_alias_join(spark, sf):
    versions = prompt_versions(spark, sf)
    newest = versions.groupBy("prompt_name").agg(F.max("version").alias("version"))
    oldest = versions.groupBy("prompt_name").agg(F.min("version").alias("version"))
    aliases = newest.withColumn("alias", F.lit("production")).unionByName(
        oldest.withColumn("alias", F.lit("archived")))
    return relational.alias_join(versions, aliases, "production")


# ---------------------------------------------------------------- aggregates


@query("daily_usage", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS total FROM events
WHERE event_type = 'purchase' GROUP BY 1 ORDER BY 1 DESC""")
def q_daily_usage(spark, sf):
    days = agg.daily_usage(load_table(spark, sf, "events"), "ts", "value", F.col("event_type") == "purchase")
    return days.select(F.col("day").cast("string").alias("day"), F.round("total", 4).alias("total"))


@query("latency_percentiles", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.9), 6) AS value_p90,
       round(quantile_cont(value, 0.99), 6) AS value_p99, round(avg(value), 6) AS value_mean
FROM events GROUP BY 1""")
def q_latency_percentiles(spark, sf):
    out = agg.latency_percentiles(load_table(spark, sf, "events"), ["event_type"], ["value"], [0.5, 0.9, 0.99], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in
                                      ("value_p50", "value_p90", "value_p99", "value_mean")])


@query("approx_latency_percentiles", """
SELECT event_type, quantile_disc(value, 0.5) AS value_p50, quantile_disc(value, 0.9) AS value_p90,
       quantile_disc(value, 0.99) AS value_p99 FROM events GROUP BY 1""")
def q_approx_percentiles(spark, sf):
    """The sketch holds up to its accuracy exactly, so small groups equal the plain percentile."""
    return agg.approx_latency_percentiles(load_table(spark, sf, "events"), ["event_type"], ["value"], [0.5, 0.9, 0.99],
                                          accuracy=100_000)


@query("nearest_rank_percentile", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (pos = round_even(0.5 * (n - 1), 0)) AS value_p50,
       max(value) FILTER (pos = round_even(0.95 * (n - 1), 0)) AS value_p95,
       max(value) FILTER (pos = round_even(0.99 * (n - 1), 0)) AS value_p99 FROM r GROUP BY 1""")
def q_nearest_rank(spark, sf):
    return agg.nearest_rank_percentile(load_table(spark, sf, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])


# Whole numbers, so that the mean is the same in any order of rows; two digits, half up.
MEAN_SQL = "CAST((200 * sum({c}) + count(*)) // (2 * count(*)) AS DOUBLE) / 100"


@query("spill_flags", f"""
WITH e AS (SELECT event_type, user_id % 7 AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS hit FROM events)
SELECT event_type, model, {MEAN_SQL.format(c='hit')} AS mean_hit, {MEAN_SQL.format(c='(hit % 3)')} AS mean_read,
       CAST(max(hit % 3) AS DOUBLE) AS max_read, {MEAN_SQL.format(c='(hit % 3)')} > 1.0 AS spilled
FROM e GROUP BY 1, 2""")
def q_spill_flags(spark, sf):
    hit = F.get_json_object("props", "$.k").cast("bigint")
    rows = load_table(spark, sf, "events").select(
        "event_type", (F.col("user_id") % 7).alias("model"), hit.cast("double").alias("hit"),
        (hit % 3).cast("double").alias("read"))
    return agg.spill_flags(rows, ["event_type", "model"], "hit", "read")


@query("load_test_summary", """
WITH ok AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS pos, count(*) OVER () AS n
            FROM events WHERE event_type <> 'error')
SELECT (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM ok) AS successes,
       (SELECT count(*) FROM events WHERE event_type = 'error') AS failures,
       round((SELECT count(*) FROM ok) / (SELECT count(*) FROM events), 6) AS success_rate,
       round((SELECT count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000 FROM events), 6) AS requests_per_s,
       max(value) FILTER (pos = round_even(0.5 * (n - 1), 0)) AS p50,
       max(value) FILTER (pos = round_even(0.9 * (n - 1), 0)) AS p90,
       max(value) FILTER (pos = round_even(0.95 * (n - 1), 0)) AS p95,
       max(value) FILTER (pos = round_even(0.99 * (n - 1), 0)) AS p99, max(value) AS max FROM ok""")
def q_load_test(spark, sf):
    events = load_table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    out = agg.load_test_summary(events, F.col("event_type") != "error", "value",
                                (F.max("at") - F.min("at")) / F.lit(1e6))
    return out.withColumn("success_rate", F.round("success_rate", 6)).withColumn(
        "requests_per_s", F.round("requests_per_s", 6))


@query("corpus_profile", """
SELECT count(*) AS docs, count(DISTINCT source) AS types, round(avg(length(text)), 6) AS mean_chars,
       CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS entities,
       round(avg(len(regexp_extract_all(text, '[0-9]+'))), 6) AS mean_entities FROM documents""")
def q_corpus_profile(spark, sf):
    numbers = F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    out = agg.corpus_profile(load_table(spark, sf, "documents"), "source", "text", numbers)
    return out.withColumn("mean_chars", F.round("mean_chars", 6)).withColumn(
        "mean_entities", F.round("mean_entities", 6))


@query("approx_distinct_profile", """
SELECT count(*) AS docs, count(DISTINCT source) AS source, count(DISTINCT text) AS text, true AS source_near, true AS text_near
FROM documents""")
def q_approx_distinct(spark, sf):
    """Sketched counts next to the exact ones; near means within four standard errors."""
    docs = load_table(spark, sf, "documents")
    rough = agg.approx_distinct_profile(docs, ["source", "text"], rsd=0.01).select(F.struct("*")).scalar()
    exact = docs.agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("source"),
                     F.count_distinct(F.md5("text")).alias("text")).withColumn("r", rough)
    near = lambda c: F.abs(F.col(f"r.distinct_{c}") - F.col(c)) <= 0.04 * F.col(c)
    return exact.select("docs", "source", "text", near("source").alias("source_near"), near("text").alias("text_near"))


@query("length_histogram", """
WITH l AS (SELECT CAST(length(text) AS DOUBLE) AS c FROM documents),
     e AS (SELECT min(c) AS lo, max(c) AS hi, (max(c) - min(c)) / 20 AS w FROM l)
SELECT CAST(least(floor((c - lo) / w) + 1, 20) AS BIGINT) AS bin,
       round(lo + w * (least(floor((c - lo) / w) + 1, 20) - 1), 6) AS lo,
       round(lo + w * least(floor((c - lo) / w) + 1, 20), 6) AS hi, count(*) AS n FROM l, e GROUP BY 1, 2, 3""")
def q_length_histogram(spark, sf):
    out = agg.length_histogram(load_table(spark, sf, "documents"), "text", 20)
    return out.select(F.col("bin").cast("bigint").alias("bin"), F.round("lo", 6).alias("lo"),
                      F.round("hi", 6).alias("hi"), "n")


@query("mean_summary", """
SELECT round(avg(quality), 6) AS mean_quality, round(avg(toxic), 6) AS mean_toxic, count(*) AS docs,
       CAST(sum(n_chars) / 1000.0 AS DOUBLE) AS wall_s, round(count(*) / (sum(n_chars) / 1000.0), 6) AS docs_per_s
FROM labels JOIN documents USING (doc_id)""")
def q_mean_summary(spark, sf):
    scored = load_table(spark, sf, "labels").join(load_table(spark, sf, "documents").select("doc_id", "n_chars"),
                                                  "doc_id")
    out = agg.mean_summary(scored, ["quality", "toxic"], F.sum("n_chars") / F.lit(1000.0))
    return out.select(F.round("mean_quality", 6).alias("mean_quality"), F.round("mean_toxic", 6).alias("mean_toxic"),
                      "docs", "wall_s", F.round("docs_per_s", 6).alias("docs_per_s"))


@query("per_field_means", """
WITH w AS (SELECT l_discount AS discount_a, l_tax AS discount_b, l_tax AS tax_a, l_discount AS tax_b,
                  l_quantity AS quantity_a, l_quantity * 2 AS quantity_b FROM lineitem)
SELECT 'discount' AS field, round(avg(discount_a), 9) AS mean_a, round(avg(discount_b), 9) AS mean_b,
       round(avg(discount_b) - avg(discount_a), 9) AS delta FROM w
UNION ALL SELECT 'tax', round(avg(tax_a), 9), round(avg(tax_b), 9), round(avg(tax_b) - avg(tax_a), 9) FROM w
UNION ALL SELECT 'quantity', round(avg(quantity_a), 9), round(avg(quantity_b), 9),
       round(avg(quantity_b) - avg(quantity_a), 9) FROM w""")
def q_per_field_means(spark, sf):
    wide = load_table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("discount_a"), F.col("l_tax").alias("discount_b"),
        F.col("l_tax").alias("tax_a"), F.col("l_discount").alias("tax_b"),
        F.col("l_quantity").alias("quantity_a"), (F.col("l_quantity") * 2).alias("quantity_b"))
    out = agg.per_field_means(wide, ["discount", "tax", "quantity"], "_a", "_b")
    return out.select("field", *[F.round(c, 9).alias(c) for c in ("mean_a", "mean_b", "delta")])


def scorer_rows(spark, sf):
    """Per-document scorer results in long form: one boolean, one number, one numeric text, one text."""
    docs = load_table(spark, sf, "documents")
    none = lambda t: F.lit(None).cast(t)
    row = lambda name, b=None, n=None, s=None: F.struct(
        F.lit(name).alias("name"), (none("boolean") if b is None else b).alias("bool_value"),
        (none("double") if n is None else n).alias("num_value"), (none("string") if s is None else s).alias("str_value"))
    cells = F.array(
        row("short", b=F.col("n_chars") < 1000), row("chars", n=F.col("n_chars").cast("double")),
        row("words", s=F.size(F.split("text", " ")).cast("string")), row("language", s=F.col("lang")))
    return docs.select("doc_id", "source", F.explode(cells).alias("c")).select("doc_id", "source", "c.*")


TYPED_SQL = """
SELECT {by}'short' AS name, printf('%.4f', round(avg(CASE WHEN n_chars < 1000 THEN 1.0 ELSE 0.0 END), 4)) AS value
FROM documents {group}
UNION ALL SELECT {by}'chars', printf('%.4f', round(avg(n_chars), 4)) FROM documents {group}
UNION ALL SELECT {by}'words', printf('%.4f', round(avg(len(string_split(text, ' '))), 4)) FROM documents {group}
UNION ALL SELECT {by}'language', min(lang) FROM (
    SELECT {by}lang, count(*) AS n, max(count(*)) OVER ({part}) AS top FROM documents GROUP BY {by}lang)
    WHERE n = top {group}"""


@query("typed_agg", TYPED_SQL.format(by="", group="", part=""))
def q_typed_agg(spark, sf):
    return agg.typed_agg(scorer_rows(spark, sf))


@query("version_compare", f"""
WITH t AS ({TYPED_SQL.format(by="source, ", group="GROUP BY source", part="PARTITION BY source")})
SELECT name, max(value) FILTER (source = 'src0') AS src0, max(value) FILTER (source = 'src1') AS src1,
       round(TRY_CAST(max(value) FILTER (source = 'src1') AS DOUBLE)
             - TRY_CAST(max(value) FILTER (source = 'src0') AS DOUBLE), 4) AS delta FROM t GROUP BY name""")
def q_version_compare(spark, sf):
    by_source = agg.typed_agg(scorer_rows(spark, sf), ["source"]).withColumnRenamed("source", "version")
    return agg.version_compare(by_source, ["src0", "src1"])


def batch_input(spark, sf):
    return load_table(spark, sf, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def batches(spark, sf):
    return agg.batch_profile(batch_input(spark, sf), [F.col("event_id")], 50, F.col("k"), F.col("value"),
                             F.col("k") * 10)


BATCH_SQL = """SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS batch, count(*) AS docs, max(rn) AS docs_cumulative,
    CAST(sum(k) AS BIGINT) AS tokens, sum(value) AS wall_s, min_by(k, rn) * 10 AS mem_start, max_by(k, rn) * 10 AS mem_end
  FROM (SELECT row_number() OVER (ORDER BY event_id) AS rn, value,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"""


@query("batch_profile", f"""
SELECT batch, docs, docs_cumulative, tokens, round(wall_s, 4) AS wall_s, mem_start, mem_end,
       round(tokens / wall_s, 4) AS tokens_per_s, mem_end - mem_start AS mem_delta FROM ({BATCH_SQL})""")
def q_batch_profile(spark, sf):
    return batches(spark, sf).withColumn("wall_s", F.round("wall_s", 4)).withColumn(
        "tokens_per_s", F.round("tokens_per_s", 4))


@query("cumulative_docs", f"""
SELECT batch, docs, tokens, CAST(sum(docs) OVER w AS BIGINT) AS docs_running,
       CAST(sum(tokens) OVER w AS BIGINT) AS tokens_running FROM ({BATCH_SQL}) WINDOW w AS (ORDER BY batch)""")
def q_cumulative_docs(spark, sf):
    return agg.cumulative_docs(batches(spark, sf))


@query("drift_first_last", f"""
SELECT max_by(mem_end, batch) - min_by(mem_start, batch) AS drift, round(avg(mem_end), 6) AS mean_mem,
       max(mem_end) AS peak_mem FROM ({BATCH_SQL})""")
def q_drift(spark, sf):
    return agg.drift_first_last(batches(spark, sf)).withColumn("mean_mem", F.round("mean_mem", 6))


@query("agreement_ratio", """
WITH s AS (SELECT avg(quality) AS qa, avg(toxic) AS ta, count(*) / 10.0 AS d1, count(*) / 4.0 AS d2 FROM labels)
SELECT round(ta - qa, 6) AS accuracy_delta, round(d2 / d1, 6) AS throughput_ratio FROM s""")
def q_agreement(spark, sf):
    labels = load_table(spark, sf, "labels")
    a = labels.agg(F.avg("quality").alias("accuracy"), (F.count(F.lit(1)) / F.lit(10.0)).alias("docs_per_s"))
    b = labels.agg(F.avg("toxic").alias("accuracy"), (F.count(F.lit(1)) / F.lit(4.0)).alias("docs_per_s"))
    out = agg.agreement_ratio(a, b)
    return out.select(F.round("accuracy_delta", 6).alias("accuracy_delta"),
                      F.round("throughput_ratio", 6).alias("throughput_ratio"))


@query("usage_cube", """
SELECT user_id, event_type, round(sum(value), 4) AS total, count(*) AS rows,
       CAST(grouping_id(user_id, event_type) AS INTEGER) AS grouping_id FROM events GROUP BY CUBE (user_id, event_type)""")
def q_usage_cube(spark, sf):
    return agg.usage_cube(load_table(spark, sf, "events"), ["user_id", "event_type"], "value").withColumn(
        "total", F.round("total", 4))


# ---------------------------------------------------------------- windows, order, sets


@query("latest_run", """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def q_latest_run(spark, sf):
    events = load_table(spark, sf, "events")
    return ranking.latest_per_key(events, "user_id", [F.col("ts").desc(), F.col("event_id")]).select(
        "user_id", "event_id", "event_type", "value")


@query("topk_per_group", """
SELECT event_type, event_id, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 10""")
def q_topk_per_group(spark, sf):
    events = load_table(spark, sf, "events").select("event_type", "event_id", "value")
    return ranking.topk_per_group(events, ["event_type"], [F.col("value").desc(), F.col("event_id")], 10)


@query("day_over_day_drop", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY 1),
     s AS (SELECT day, value, lag(value) OVER (ORDER BY day) AS prev FROM d)
SELECT CAST(day AS VARCHAR) AS day, round(value, 4) AS value, round(prev, 4) AS prev,
       round((value - prev) / prev * 100, 4) AS change_pct FROM s WHERE (value - prev) / prev * 100 < -5""")
def q_day_over_day(spark, sf):
    out = ranking.day_over_day_drop(load_table(spark, sf, "events"), "ts", "value", 5.0)
    return out.select(F.col("day").cast("string").alias("day"),
                      *[F.round(c, 4).alias(c) for c in ("value", "prev", "change_pct")])


@query("train_test_cut", """
WITH t AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS pos FROM documents)
SELECT doc_id, n_chars, CAST(pos AS INTEGER) AS pos,
       CASE WHEN pos <= floor((SELECT count(*) FROM t WHERE pos <= 100) * 0.6) THEN 'train' ELSE 'test' END AS split
FROM t WHERE pos <= 100""")
def q_train_test_cut(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "n_chars")
    return ranking.train_test_cut(docs, [F.col("n_chars"), F.col("doc_id")], 100, 0.6)


@query("stratified_sample", """
SELECT vec_id, label, CAST(row_number() OVER w AS INTEGER) AS draw_no FROM embeddings
WINDOW w AS (PARTITION BY label ORDER BY md5('1-' || CAST(vec_id AS VARCHAR)), vec_id)
QUALIFY row_number() OVER w <= 10""")
def q_stratified_sample(spark, sf):
    vectors = load_table(spark, sf, "embeddings").select("vec_id", "label")
    return ranking.stratified_sample(vectors, "label", "vec_id", 10, seed=1)


@query("stratified_split", """
SELECT vec_id, label, CASE WHEN n <= 3 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('1-' || CAST(vec_id AS VARCHAR)), vec_id) AS n FROM embeddings) WHERE n <= 13""")
def q_stratified_split(spark, sf):
    vectors = load_table(spark, sf, "embeddings").select("vec_id", "label")
    return ranking.stratified_split(vectors, "label", "vec_id", 3, 10, labels=list(range(10)))


@query("order_limit", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q_order_limit(spark, sf):
    orders = load_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.order_limit(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)


@query("sort_by_delta", """
SELECT s_suppkey, round(avg(l_tax - l_discount), 9) AS delta FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey
GROUP BY 1 ORDER BY delta NULLS LAST, s_suppkey""")
def q_sort_by_delta(spark, sf):
    gaps = load_table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg(F.col("l_tax") - F.col("l_discount")), 9).alias("delta"))
    suppliers = load_table(spark, sf, "supplier").select("s_suppkey")
    joined = suppliers.join(gaps, suppliers.s_suppkey == gaps.l_suppkey, "left").select("s_suppkey", "delta")
    return ranking.sort_by_delta(joined, "delta", "s_suppkey")


@query("first_failures", """
SELECT event_id, event_type, value FROM events WHERE value >= 100 ORDER BY event_id LIMIT 5""")
def q_first_failures(spark, sf):
    rows = load_table(spark, sf, "events").select("event_id", "event_type", "value",
                                                  (F.col("value") < 100).alias("passed"))
    return ranking.first_failures(rows, "passed", "event_id").drop("passed")


@query("union_versions", """
SELECT doc_id, 'v1' AS version, CAST(quality AS DOUBLE) AS score, CAST(NULL AS INTEGER) AS toxic FROM labels
UNION ALL SELECT doc_id, 'v2', 1.0 - quality, toxic FROM labels""")
def q_union_versions(spark, sf):
    labels = load_table(spark, sf, "labels")
    v1 = labels.select("doc_id", F.col("quality").cast("double").alias("score"))
    v2 = labels.select("doc_id", (1.0 - F.col("quality")).alias("score"), "toxic")
    return relational.union_versions({"v1": v1, "v2": v2})


@query("set_minus_ids", """
SELECT 'not_labelled' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'not_stored', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def q_set_minus(spark, sf):
    stored, labelled = (load_table(spark, sf, t).select("doc_id") for t in ("documents", "labels"))
    return relational.set_minus_ids(stored, labelled).select(F.lit("not_labelled").alias("side"), "doc_id").unionByName(
        relational.set_minus_ids(labelled, stored).select(F.lit("not_stored").alias("side"), "doc_id"))


@query("label_set_check", """
SELECT DISTINCT p_brand FROM part WHERE p_size > 10
AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice < 910)""")
def q_label_set_check(spark, sf):
    part = load_table(spark, sf, "part")
    return relational.label_set_check(part.where("p_retailprice < 910"), part.where("p_size > 10"), "p_brand")
