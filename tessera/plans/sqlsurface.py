"""Queries in SQL text over registered functions."""

from __future__ import annotations

from tessera.functions.sqlnames import register_functions, register_model
from tessera.functions.tablefns import register_gap_sessions, register_split_table
from tessera.inference.models import Checksum
from tessera.plans.documents import COVER_SQL, cover
from tessera.plans.registry import query
from tessera.sources.readers import heavy_table, load_table


@query("sql_functions", """
SELECT event_id, CAST(greatest(1, length(props) // 4) AS INTEGER) AS tokens, md5(props) AS content,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0 AS seconds,
       '{"k": ' || json_extract_string(props, '$.k') || '}' AS answer, event_type AS name FROM events""")
def q_sql_functions(spark, sf):
    register_functions(spark)
    return spark.sql("""
        SELECT event_id, token_estimate(props) AS tokens, content_id(props) AS content,
               elapsed_seconds(timestamp'2024-01-01 00:00:00', cast(ts AS timestamp)) AS seconds,
               clean_model_json(concat('```json\\n', props, '\\n```')) AS answer, file_name(concat('a/b/', event_type)) AS name
        FROM {events}""", events=load_table(spark, sf, "events"))


@query("sql_model", """
SELECT conv_id, turn, 'm ' || length('{"role":"' || role || '","chars":' || length(text) || '}') || ':'
       || md5('{"role":"' || role || '","chars":' || length(text) || '}') AS answer FROM conversations""")
def q_sql_model(spark, sf):
    register_model(spark, "chat_model", Checksum("m "))
    return spark.sql("""
        SELECT conv_id, turn, chat_model(to_json(named_struct('role', role, 'chars', char_length(text)))) AS answer
        FROM {turns}""", turns=load_table(spark, sf, "conversations"))


@query("sql_embed", "SELECT doc_id, CAST(64 AS INTEGER) AS dim FROM documents")
def q_sql_embed(spark, sf):
    register_functions(spark)
    return spark.sql("SELECT doc_id, size(hashed_embed(text)) AS dim FROM {docs}", docs=heavy_table(spark, sf, "documents"))


@query("sql_chunks", COVER_SQL)
def q_sql_chunks(spark, sf):
    register_functions(spark)
    return cover(spark.sql("SELECT doc_id, chunk_no, chunk FROM {docs}, LATERAL split_text(text, 500, 0)",
                           docs=heavy_table(spark, sf, "documents")))


@query("sql_split_table", COVER_SQL)
def q_sql_split_table(spark, sf):
    docs = heavy_table(spark, sf, "documents").select("doc_id", "text")
    register_split_table(spark, "split_documents", docs.schema, "text")
    return cover(spark.sql("SELECT doc_id, chunk_no, chunk FROM split_documents(TABLE({docs}), 500, 0)", docs=docs))


@query("sql_gap_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events
     WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS turns FROM s GROUP BY user_id, n""")
def q_sql_gap_sessions(spark, sf):
    """A function that is called once per user, over rows in order of time."""
    events = load_table(spark, sf, "events").selectExpr("user_id", "cast(ts as timestamp) as ts")
    register_gap_sessions(spark, "user_sessions", events.schema, "user_id", "ts")
    return spark.sql("""
        SELECT user_id, unix_micros(first) AS first, unix_micros(last) AS last, turns
        FROM user_sessions(TABLE({events}) PARTITION BY user_id ORDER BY (ts), 1800.0)""", events=events)
