"""The logged index: replay, deletes, merges, and what a batch writes."""

import os
import random

import pytest

from tessera.streaming import log, sources

SCHEMA = "id bigint, seq int, gone boolean, x string"


def batch(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def read(spark, path):
    return {r["id"]: r["x"] for r in log.read_log(spark, path, "id", ["seq"], "gone").collect()}


def newest(batches):
    out = {}
    for n, rows in enumerate(batches):
        for i, seq, gone, x in rows:
            if i not in out or (seq, n) >= out[i][:2]:
                out[i] = (seq, n, gone, x)
    return {i: x for i, (_, _, gone, x) in out.items() if not gone}


@pytest.mark.parametrize("fanout", [2, 3, 100])
def test_any_order_of_changes_with_merges(spark, folder, fanout):
    rng, path, batches = random.Random(fanout), folder("log"), []
    for n in range(7):
        rows = [(i, rng.randrange(100), rng.random() < 0.3, f"{n}-{i}") for i in rng.sample(range(25), 9)]
        batches.append(rows)
        log.append_batch(spark, path, batch(spark, rows), n, "id", ["seq"])
        if n % 2:
            log.merge_segments(spark, path, "id", ["seq"], fanout=fanout)
        assert read(spark, path) == newest(batches)
    _, known = log._manifest(spark, path)
    levels = [s["level"] for s in log._segments(known)]
    assert all(levels.count(n) < fanout + 2 for n in levels)


def test_replay_and_lost_batches_change_nothing(spark, folder):
    path = folder("log")
    first, second = [(1, 1, False, "a"), (2, 1, False, "b"), (1, 3, False, "c")], [(2, 2, True, "d"), (3, 1, False, "e")]
    log.append_batch(spark, path, batch(spark, first), 0, "id", ["seq"], "r")
    # a batch that died after its rows and before its manifest
    log._write_segment(batch(spark, [(9, 9, False, "z")]), path, "r-1", "id", 1)
    assert read(spark, path) == {1: "c", 2: "b"}
    for _ in range(2):
        log.append_batch(spark, path, batch(spark, second), 1, "id", ["seq"], "r")
        assert read(spark, path) == {1: "c", 3: "e"}
    log.merge_segments(spark, path, "id", ["seq"], fanout=2)
    log.append_batch(spark, path, batch(spark, [(3, 9, False, "again")]), 1, "id", ["seq"], "r")
    assert read(spark, path) == {1: "c", 3: "e"}
    log.append_batch(spark, path, batch(spark, [(3, 9, False, "other run")]), 0, "id", ["seq"], "s")
    log.append_batch(spark, path, batch(spark, []), 1, "id", ["seq"], "s")
    assert read(spark, path) == {1: "c", 3: "other run"}


def test_marks_stay_until_they_may_go(spark, folder):
    path = folder("log")
    log.append_batch(spark, path, batch(spark, [(1, 5, False, "a"), (2, 5, False, "b")]), 0, "id", ["seq"])
    log.append_batch(spark, path, batch(spark, [(1, 6, True, "gone")]), 1, "id", ["seq"])
    log.merge_segments(spark, path, "id", ["seq"], fanout=2)
    log.append_batch(spark, path, batch(spark, [(1, 4, False, "older")]), 2, "id", ["seq"])
    assert read(spark, path) == {2: "b"}
    log.append_batch(spark, path, batch(spark, [(7, 1, False, "c")]), 3, "id", ["seq"])
    log.merge_segments(spark, path, "id", ["seq"], "gone", fanout=2)
    assert read(spark, path) == {2: "b", 7: "c"}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_its_own_rows_only(spark, folder, tmp_path):
    path = folder("log")
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcdefghij") for _ in range(200))
    log.append_batch(spark, path, batch(spark, [(i, 0, False, text()) for i in range(5000)]), 0, "id", ["seq"])
    base = size(tmp_path / "log")
    grown = []
    for n in range(1, 5):
        log.append_batch(spark, path, batch(spark, [(rng.randrange(5000), n, False, text()) for _ in range(20)]), n, "id", ["seq"])
        grown.append(size(tmp_path / "log"))
    steps = [b - a for a, b in zip([base, *grown], grown)]
    assert max(steps) < base / 20 and max(steps) < 2 * min(steps)
    before = read(spark, path)
    log.merge_segments(spark, path, "id", ["seq"], fanout=5)
    assert log.expire_segments(spark, path) > 5 and read(spark, path) == before and size(tmp_path / "log") < 1.2 * base


def test_large_base_is_not_shuffled(spark, folder):
    path = folder("log")
    log.append_batch(spark, path, spark.range(20_000).selectExpr("id", "0 as seq", "false as gone", "cast(id as string) as x"), 0, "id", ["seq"])
    log.append_batch(spark, path, batch(spark, [(3, 1, False, "new"), (30_000, 1, False, "more")]), 1, "id", ["seq"])
    frame = log.read_log(spark, path, "id", ["seq"], "gone")
    got = {r["id"]: r["x"] for r in frame.collect()}
    assert len(got) == 20_001 and got[3] == "new" and got[30_000] == "more" and got[4] == "4"
    assert "SortMergeJoin" not in frame._jdf.queryExecution().executedPlan().toString()


def test_columns_that_came_later(spark, folder):
    path = folder("log")
    log.append_batch(spark, path, batch(spark, [(1, 1), (2, 1)], "id bigint, seq int"), 0, "id", ["seq"])
    log.append_batch(spark, path, batch(spark, [(2, 2, "b")], "id bigint, seq int, x string"), 1, "id", ["seq"])
    assert {r["id"]: r["x"] for r in log.read_log(spark, path, "id", ["seq"]).collect()} == {1: None, 2: "b"}


def test_stream_runs_again_and_under_a_new_checkpoint(spark, folder):
    for n, checkpoint in enumerate(("a", "a", "b")):
        batch(spark, [(7, n, False, f"x{n}"), (n, 0, False, "y")]).coalesce(1).write.mode("append").parquet(folder("in"))
        stream = sources.stream_file_ingest(spark, folder("in"), SCHEMA, files_per_batch=1)
        log.stream_log_sync(stream, "id", ["seq"], folder("log"), folder(checkpoint), fanout=2)
        assert read(spark, folder("log")) == {7: f"x{n}", **{i: "y" for i in range(n + 1)}}


def test_no_index(spark, folder):
    with pytest.raises(ValueError):
        log.read_log(spark, folder("none"), "id", ["seq"])
