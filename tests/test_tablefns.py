import datetime as dt
import random

import pytest

from tessera.functions.chunks import recursive_split
from tessera.functions.tablefns import register_gap_sessions, register_split_table

DAY = dt.datetime(2024, 1, 1)


def test_columns_follow_the_table(spark):
    rows = [(i, "p one.\n\np two " * i, [i, None], f"k{i}") for i in range(6)] + [(9, None, None, None)]
    docs = spark.createDataFrame(rows, "id int, body string, xs array<int>, name string")
    register_split_table(spark, "split_them", docs.schema, "body")
    out = spark.sql("SELECT * FROM split_them(TABLE({d}), 20, 0)", d=docs)
    assert out.columns == ["id", "xs", "name", "chunk_no", "chunk"]
    got = [(r["id"], r["xs"], r["name"], r["chunk_no"], r["chunk"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((i, xs, name, n, c) for i, t, xs, name in rows for n, c in enumerate(recursive_split(t or "", 20, 0))), key=repr)
    with pytest.raises(ValueError, match="no column"):
        register_split_table(spark, "split_them", docs.schema, "nope")


def test_sessions_per_partition_over_many_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), DAY + dt.timedelta(seconds=rng.randrange(200_000))) for _ in range(3000)]
    events = spark.createDataFrame(rows, "k string, ts timestamp").repartition(4)
    register_gap_sessions(spark, "sessions_of", events.schema, "k", "ts")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = spark.sql("SELECT * FROM sessions_of(TABLE({e}) PARTITION BY k ORDER BY (ts), 60.0)", e=events).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for k in {r[0] for r in rows}:
        for t in sorted(r[1] for r in rows if r[0] == k):
            if want and want[-1][0] == k and t - want[-1][2] < dt.timedelta(seconds=60):
                want[-1][2:] = [t, want[-1][3] + 1]
            else:
                want.append([k, t, t, 1])
    assert sorted((tuple(r) for r in got), key=repr) == sorted(map(tuple, want), key=repr)


def test_plan_has_no_row_calls(spark):
    docs = spark.createDataFrame([(1, "text")], "id int, body string")
    register_split_table(spark, "split_them", docs.schema, "body")
    plan = spark.sql("SELECT * FROM split_them(TABLE({d}), 20, 0)", d=docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan
