"""Streams over several runs and batches: replay, late data, state."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators.evaluation import Scorer
from tessera.streaming import index, sources, state, windows

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp, k string, x double"


def add(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def row(i, minutes, k="a", x=1.0):
    return (i, DAY + dt.timedelta(minutes=minutes), k, x)


def test_only_new_files_are_read(spark, folder):
    for run in (1, 2):
        add(spark, folder("in"), [row(run, run)])
        sources.append_table(sources.stream_file_ingest(spark, folder("in"), SCHEMA), folder("out"), folder("ckpt"))
    assert sorted(r["id"] for r in spark.read.parquet(folder("out")).collect()) == [1, 2]


def test_index_upsert_newest_wins_and_replay_changes_nothing(spark, folder):
    path = folder("index")
    read = lambda: {r["id"]: r["x"] for r in index.read_index(spark, path).collect()}
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    first = batch(row(1, 0, x=1.0), row(2, 5, x=2.0), row(1, 1, x=1.5), row(3, 0, x=3.0))
    index.upsert_batch(spark, path, first, 0, "id", ["ts"], buckets=4)
    assert read() == {1: 1.5, 2: 2.0, 3: 3.0}
    second = batch(row(2, 1, x=9.0), row(4, 0, x=4.0), row(3, 9, x=3.5))
    for _ in range(2):
        index.upsert_batch(spark, path, second, 1, "id", ["ts"], buckets=4)
        assert read() == {1: 1.5, 2: 2.0, 3: 3.5, 4: 4.0}


def test_index_keeps_rows_under_a_new_checkpoint(spark, folder):
    read = lambda path: {r["id"]: r["x"] for r in index.read_index(spark, path).collect()}
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    index.upsert_batch(spark, folder("a"), batch(row(1, 0, x=1.0), row(2, 0, x=2.0)), 0, "id", ["ts"], buckets=2)
    index.compact_index(spark, folder("a"), folder("b"))
    for n, x in enumerate((3.0, 4.0)):
        feed = folder(f"feed{n}")
        batch(row(3 + n, 0, x=x)).write.parquet(feed)
        stream = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
        index.stream_index_sync(stream, "id", ["ts"], folder("b"), folder(f"checkpoint{n}"), buckets=2)
    assert read(folder("b")) == {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}


def test_index_goes_on_after_compaction(spark, folder):
    read = lambda path: {r["id"]: r["x"] for r in index.read_index(spark, path).collect()}
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    index.upsert_batch(spark, folder("a"), batch(row(1, 0, x=1.0), row(2, 0, x=2.0)), 0, "id", ["ts"], buckets=2)
    index.upsert_batch(spark, folder("a"), batch(row(1, 1, x=1.5)), 1, "id", ["ts"], buckets=2)
    index.compact_index(spark, folder("a"), folder("b"))
    assert read(folder("b")) == read(folder("a")) == {1: 1.5, 2: 2.0}
    index.upsert_batch(spark, folder("b"), batch(row(2, 5, x=9.0)), 2, "id", ["ts"], buckets=2)
    assert read(folder("b")) == {1: 1.5, 2: 9.0}


def test_index_deletes(spark, folder):
    path = folder("index")
    batch = lambda *rows: spark.createDataFrame(list(rows), "id bigint, seq int, gone boolean")
    index.upsert_batch(spark, path, batch((1, 1, False), (2, 1, False)), 0, "id", ["seq"], buckets=1)
    index.upsert_batch(spark, path, batch((1, 2, True)), 1, "id", ["seq"], buckets=1)
    assert [r["id"] for r in index.read_index(spark, path, deleted="gone").collect()] == [2]


def test_index_sync_runs_again(spark, folder):
    for x in (1.0, 2.0):
        add(spark, folder("in"), [row(7, int(x), x=x)])
        index.stream_index_sync(sources.stream_file_ingest(spark, folder("in"), SCHEMA), "id", ["ts"], folder("index"), folder("ckpt"))
        assert [r["x"] for r in index.read_index(spark, folder("index")).collect()] == [x]


def test_monitor_sample_is_fixed(spark, folder):
    add(spark, folder("in"), [row(i, i) for i in range(1000)])
    scorer = Scorer("big", "bool", lambda: F.col("x") > 0)
    got = []
    for run in "ab":
        stream = index.stream_monitor(sources.stream_file_ingest(spark, folder("in"), SCHEMA), "id", [scorer], 0.3)
        sources.append_table(stream, folder("out" + run), folder("ckpt" + run))
        got.append({r["id"] for r in spark.read.parquet(folder("out" + run)).collect()})
    assert got[0] == got[1] and 230 < len(got[0]) < 370


def test_sessions_equal_gaps(spark, folder):
    add(spark, folder("in"), [row(1, 0), row(2, 10), row(3, 45), row(4, 20, "b"), row(5, 200, "b")])
    windows.closing_rows(spark, folder("end"), spark.read.parquet(folder("in")).schema, "ts")
    stream = sources.stream_file_ingest(spark, folder("in"), SCHEMA).unionByName(sources.stream_file_ingest(spark, folder("end"), SCHEMA))
    sources.append_table(windows.stream_sessions(stream, "ts", "k", "30 minutes", "1 hour"), folder("out"), folder("ckpt"))
    got = sorted((r["k"], r["turns"]) for r in spark.read.parquet(folder("out")).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]


def test_dedup_over_batches(spark, folder):
    for run in (1, 2):
        add(spark, folder("in"), [row(run, run, "a"), row(run + 10, run, "b" * run)])
        stream = windows.stream_dedup(sources.stream_file_ingest(spark, folder("in"), SCHEMA), "ts", ["k"], "1 day")
        sources.append_table(stream, folder("out"), folder("ckpt"))
    assert sorted(r["k"] for r in spark.read.parquet(folder("out")).collect()) == ["a", "b", "bb"]


def test_late_rows_batch_and_stream(spark, folder):
    data = [row(1, 0), row(2, 600), row(3, 100), row(4, 590), row(5, 2000)]
    on_time, late = windows.late_rows(spark.createDataFrame(data, SCHEMA), [F.col("id")], "ts", "1 HOUR")
    assert sorted(r["id"] for r in late.collect()) == [3] and on_time.count() == 4
    for run, rows in enumerate(([data[0], data[1]], [data[2], data[3]], [data[4]])):
        add(spark, folder("in"), rows)
        windows.stream_late_rows(sources.stream_file_ingest(spark, folder("in"), SCHEMA), "ts", "1 HOUR", folder("out"), folder("ckpt"))
    assert [r["id"] for r in spark.read.parquet(folder("out") + "/late").collect()] == [3]
    assert sorted(r["id"] for r in spark.read.parquet(folder("out") + "/on_time").collect()) == [1, 2, 4, 5]


def test_streak_over_batches_in_any_order(spark, folder):
    states = {"up": "ACTIVE", "down": "DOWN"}
    feed = [[(3, "a", "up"), (1, "a", "down"), (1, "b", "up")], [(2, "a", "up"), (2, "b", "up"), (3, "b", "up")], [(4, "a", "down"), (4, "b", "up")]]
    seen = []
    for rows in feed:
        add(spark, folder("in"), [row(i, 0, k=f"{k}:{states[s]}") for i, k, s in rows])
        stream = sources.stream_file_ingest(spark, folder("in"), SCHEMA).select(
            "id", F.split("k", ":")[0].alias("k"), F.split("k", ":")[1].alias("state"))
        out = state.stream_latest_state(stream, "k", "state", "id", 3)
        with state.rocksdb(spark):
            sources.run_available(out, folder("ckpt"), "update", lambda df, n: seen.append(
                {r["k"]: (r["streak"], r["ready"]) for r in df.collect()}))
    assert [s for s in seen if s] == [{"a": (1, False), "b": (1, False)}, {"a": (2, False), "b": (3, True)}, {"a": (0, False), "b": (3, True)}]


def test_sliding_windows_count_each_row_per_slide(spark, folder):
    add(spark, folder("in"), [row(1, 5, x=10.0), row(2, 15, x=20.0)])
    rolling = windows.stream_sliding_latency(sources.stream_file_ingest(spark, folder("in"), SCHEMA), "ts", "1 hour", "10 minutes", "1 day", "x")
    sources.replace_table(rolling, folder("out"), folder("ckpt"))
    rows = spark.read.parquet(folder("out")).collect()
    assert sum(r["rows"] for r in rows) == 12 and {r["p95"] for r in rows} == {10.0, 20.0}
