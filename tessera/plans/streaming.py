"""Queries over bounded runs of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sketches
from tessera.operators.evaluation import Scorer
from tessera.plans.registry import query
from tessera.session import fit_local, scratch_path
from tessera.sources.readers import load_table
from tessera.sources.writers import save_table
from tessera.streaming import index, log, sources, state, timers, windows


def event_stream(spark, sf):
    fit_local(spark)
    schema = load_table(spark, sf, "events").schema
    return sources.event_time(sources.stream_table(spark, sf, "events", schema), "ts")


def closed_event_stream(spark, sf):
    """Events with a row that closes the last windows."""
    schema = load_table(spark, sf, "events").schema
    path = scratch_path(spark, "closing")
    windows.closing_rows(spark, path, schema, "ts")
    end = sources.event_time(sources.stream_file_ingest(spark, path, schema), "ts")
    return event_stream(spark, sf).unionByName(end)


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


STAMP_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


@query("stream_file_ingest", """
SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS INTEGER) AS run FROM documents""")
def q_file_ingest(spark, sf):
    """Two runs with files added in between; each row arrives once, in the run its file came in."""
    docs = load_table(spark, sf, "documents")
    inbox, out, checkpoint = (scratch_path(spark, n) for n in ("inbox", "ingested", "checkpoint"))
    for run, part in ((1, docs.where("lang = 'en'")), (2, docs.where("lang <> 'en'"))):
        save_table(part, inbox, "append")
        new = sources.stream_file_ingest(spark, inbox, docs.schema).withColumn("run", F.lit(run))
        sources.append_table(new, out, checkpoint)
    return spark.read.parquet(out).select("doc_id", "run")


@query("stream_index_sync", """
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_index_sync(spark, sf):
    """Events as changes of a table of users, one file of changes per batch, files in no time order."""
    events = load_table(spark, sf, "events")
    feed, path, checkpoint = (scratch_path(spark, n) for n in ("feed", "index", "checkpoint"))
    save_table(events.repartition(4, "event_id"), feed)
    changes = sources.stream_file_ingest(spark, feed, events.schema, files_per_batch=1)
    index.stream_index_sync(changes, "user_id", ["ts", "event_id"], path, checkpoint, buckets=8)
    return index.read_index(spark, path).select("user_id", "event_id", "event_type", "value")


@query("stream_index_log", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'""")
def q_index_log(spark, sf):
    """The same changes kept as a log; an error deletes the user. Six batches of two runs, merged three at a time."""
    events = load_table(spark, sf, "events").withColumn("gone", F.col("event_type") == "error")
    feed, path, checkpoint = (scratch_path(spark, n) for n in ("feed", "log", "checkpoint"))
    for half in (0, 1):
        save_table(events.where(F.col("event_id") % 2 == half).repartition(3, "event_id"), feed, "append")
        changes = sources.stream_file_ingest(spark, feed, events.schema, files_per_batch=1)
        log.stream_log_sync(changes, "user_id", ["ts", "event_id"], path, checkpoint, fanout=3)
    return log.read_log(spark, path, "user_id", ["ts", "event_id"], "gone").select("user_id", "event_id", "event_type", "value")


@query("stream_monitor", r"""
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[0-9]{16}')) > 0 THEN true ELSE false END AS has_card, CAST(length(text) AS DOUBLE) AS chars
FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.5""")
def q_monitor(spark, sf):
    schema = load_table(spark, sf, "documents").schema
    stream = sources.stream_table(spark, sf, "documents", schema)
    scorers = [Scorer("has_card", "bool", lambda: F.regexp_like("text", F.lit("[0-9]{16}"))),
               Scorer("chars", "num", lambda: F.char_length("text"))]
    out = scratch_path(spark, "scores")
    sources.append_table(index.stream_monitor(stream, "doc_id", scorers, 0.5), out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out)


@query("stream_tumbling_usage", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, round(sum(value), 4) AS total, count(*) AS rows FROM events GROUP BY 1, 2""")
def q_tumbling(spark, sf):
    usage = windows.stream_tumbling_usage(closed_event_stream(spark, sf), "ts", "1 day", "1 day", ["event_type"], "value")
    out = scratch_path(spark, "usage")
    sources.append_table(usage, out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type",
                                          F.round("total", 4).alias("total"), "rows")


@query("stream_sliding_latency", f"""
WITH w AS (SELECT time_bucket(INTERVAL '10 minutes', ts) - to_minutes(10 * CAST(i AS INTEGER)) AS start, value FROM events, range(6) r(i))
SELECT {STAMP_SQL.format(c='start')} AS start, count(*) AS rows, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
FROM w GROUP BY start""")
def q_sliding(spark, sf):
    rolling = windows.stream_sliding_latency(closed_event_stream(spark, sf), "ts", "1 hour", "10 minutes", "1 day", "value")
    out = scratch_path(spark, "latency")
    sources.append_table(rolling, out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out).withColumn("start", stamp("start"))


@query("stream_sessions", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events
     WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, {STAMP_SQL.format(c='min(ts)')} AS first, {STAMP_SQL.format(c='max(ts)')} AS last, count(*) AS turns FROM s GROUP BY user_id, n""")
def q_sessions(spark, sf):
    sessions = windows.stream_sessions(closed_event_stream(spark, sf), "ts", "user_id", "30 minutes", "1 day")
    out = scratch_path(spark, "sessions")
    sources.append_table(sessions, out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out).withColumn("first", stamp("first")).withColumn("last", stamp("last"))


@query("stream_session_timers", f"""
WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 day' AS edge FROM events WHERE event_type <> 'error'),
 e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN ts - INTERVAL '2 days' ELSE ts END AS ts, event_type = 'error' AS second FROM events),
 a AS (SELECT user_id, ts, second AND ts < edge AS late FROM e, m),
 g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM a WHERE NOT late
     WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, 'session' AS kind, {STAMP_SQL.format(c='min(ts)')} AS first, {STAMP_SQL.format(c='max(ts)')} AS last, CAST(count(*) AS BIGINT) AS turns FROM s GROUP BY user_id, n
UNION ALL SELECT user_id, 'late', {STAMP_SQL.format(c='ts')}, {STAMP_SQL.format(c='ts')}, CAST(count(*) AS BIGINT) FROM a WHERE late GROUP BY user_id, ts""")
def q_session_timers(spark, sf):
    """Three runs of one stream: events without errors, then errors dated two days back, then a row that closes what is open."""
    fit_local(spark)
    events = sources.event_time(load_table(spark, sf, "events"), "ts")
    feed, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "timed", "checkpoint"))
    errors = events.where("event_type = 'error'").withColumn("ts", F.col("ts") - F.expr("INTERVAL 2 DAYS"))
    ending = scratch_path(spark, "closing")
    windows.closing_rows(spark, ending, events.schema, "ts")
    for rows in (events.where("event_type <> 'error'"), errors, spark.read.schema(events.schema).parquet(ending)):
        save_table(rows, feed, "append")
        stream = sources.stream_file_ingest(spark, feed, events.schema)
        with state.rocksdb(spark):
            sources.append_table(timers.stream_session_timers(stream, "ts", "user_id", 30, "1 day"), out, checkpoint)
    rows = spark.read.parquet(out).groupBy("user_id", "kind", "first", "last").agg(F.sum("turns").alias("turns"))
    return rows.withColumn("first", stamp("first")).withColumn("last", stamp("last"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def q_dedup(spark, sf):
    events = event_stream(spark, sf).select("ts", "user_id", "event_type")
    first = windows.stream_dedup(events, "ts", ["user_id", "event_type"], "60 days")
    out = scratch_path(spark, "first")
    sources.append_table(first.select("user_id", "event_type"), out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out)


@query("stream_latest_state", """
WITH b AS (SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'error'), -1) AS bad FROM events GROUP BY 1)
SELECT user_id, CAST(least(3, count(*) FILTER (event_type <> 'error' AND event_id > bad)) AS INTEGER) AS streak,
       count(*) FILTER (event_type <> 'error' AND event_id > bad) >= 3 AS ready FROM events JOIN b USING (user_id) GROUP BY 1""")
def q_latest_state(spark, sf):
    """A user is ready after three events in a row that are no error. Four batches share the state."""
    fit_local(spark)
    events = load_table(spark, sf, "events")
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "state")
    save_table(events.repartition(4, "event_id"), feed)
    stream = sources.stream_file_ingest(spark, feed, events.schema, files_per_batch=1).withColumn(
        "state", F.when(F.col("event_type") == "error", F.lit("DOWN")).otherwise(F.lit("ACTIVE")))
    ready = state.stream_latest_state(stream, "user_id", "state", "event_id", 3)
    with state.rocksdb(spark):
        sources.run_available(ready, scratch_path(spark, "checkpoint"), "update",
                              lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite")
                              .parquet(f"{out}/run={n}"))
    newest = F.max_by(F.struct("streak", "ready"), "batch")
    return spark.read.parquet(out).groupBy("user_id").agg(newest.alias("s")).select("user_id", "s.streak", "s.ready")


@query("late_rows", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN ts - INTERVAL '3 days' ELSE ts END AS t FROM events),
 m AS (SELECT event_id, t, max(t) OVER (ORDER BY event_id) AS newest FROM e)
SELECT event_id, CASE WHEN t < newest - INTERVAL '1 day' THEN 'late' ELSE 'on_time' END AS side FROM m""")
def q_late_rows(spark, sf):
    shifted = F.when(F.col("event_type") == "error", F.col("ts") - F.expr("INTERVAL 3 DAYS")).otherwise(F.col("ts"))
    rows = load_table(spark, sf, "events").select("event_id", shifted.alias("at"))
    on_time, late = windows.late_rows(rows, [F.col("event_id")], "at", "1 DAY")
    side = lambda df, name: df.select("event_id", F.lit(name).alias("side"))
    return side(on_time, "on_time").unionByName(side(late, "late"))


PS = [0.5, 0.9, 0.99]


def held(rows, answers, keys):
    """(keys, rows, and for each quantile and the distinct count whether the sketch's answer is within its bound)."""
    met = rows.join(answers, keys)
    counts = met.groupBy(*keys).agg(F.max("rows").alias("rows"), F.max("distinct").alias("_d"), F.count_distinct("user_id").alias("_exact"), *[
        F.count_if(F.col("value") < F.col(f"p{p * 100:g}")).alias(f"_below{i}") for i, p in enumerate(PS)], *[
        F.count_if(F.col("value") <= F.col(f"p{p * 100:g}")).alias(f"_upto{i}") for i, p in enumerate(PS)])
    close = F.abs(F.col("_d") - F.col("_exact")) <= 1 + sketches.DISTINCT_ERROR * F.col("_exact")
    return counts.select(*keys, "rows", close.alias("distinct_holds"), *[
        sketches.rank_holds(F.col(f"_below{i}"), F.col(f"_upto{i}"), F.col("rows"), p).alias(f"p{p * 100:g}_holds") for i, p in enumerate(PS)])


HOLDS_SQL = "true AS distinct_holds, true AS p50_holds, true AS p90_holds, true AS p99_holds"


@query("sketch_rollup", f"""
SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS rows, {HOLDS_SQL} FROM events GROUP BY 1, 2""")
def q_sketch_rollup(spark, sf):
    """Hourly sketches merged to weeks; the answers are held against the rows."""
    events = sources.event_time(load_table(spark, sf, "events"), "ts")
    path = scratch_path(spark, "sketches")
    save_table(sketches.sketch_windows(events, "ts", "1 hour", ["event_type"], "value", "user_id"), path)
    week = lambda c: F.date_format(F.date_trunc("week", c), "yyyy-MM-dd").alias("week")
    fine = spark.read.parquet(path).select("*", week("start"))
    answers = sketches.quantiles_of(sketches.roll_up(fine, ["event_type", "week"]), PS)
    return held(events.select("event_type", week("ts"), "value", "user_id"), answers, ["event_type", "week"])


@query("stream_sketch_windows", f"""
WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(CAST(i AS INTEGER)) AS start FROM events, range(6) r(i))
SELECT {STAMP_SQL.format(c='start')} AS start, count(*) AS rows, {HOLDS_SQL} FROM w GROUP BY 1""")
def q_stream_sketches(spark, sf):
    """Closed hours appended with their sketches; windows of six hours that move by one come from these alone."""
    out = scratch_path(spark, "hours")
    hours = sketches.stream_sketch_windows(closed_event_stream(spark, sf), "ts", "1 hour", "1 day", [], "value", "user_id")
    sources.append_table(hours, out, scratch_path(spark, "checkpoint"))
    answers = sketches.quantiles_of(sketches.roll_up(spark.read.parquet(out), [], "6 hours", "1 hour"), PS)
    rows = load_table(spark, sf, "events").select(F.window(F.col("ts").cast("timestamp"), "6 hours", "1 hour")["start"].alias("start"), "value", "user_id")
    return held(rows, answers, ["start"]).withColumn("start", stamp("start"))
