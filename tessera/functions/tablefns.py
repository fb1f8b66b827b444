"""Table functions over a TABLE argument: made for the columns of a table, and called on Arrow batches.

    register_split_table(spark, "split_docs", docs.schema, "text")
    spark.sql("SELECT * FROM split_docs(TABLE({docs}), 500, 0)", docs=docs)
    register_gap_sessions(spark, "user_sessions", events.schema, "user_id", "ts")
    spark.sql("SELECT * FROM user_sessions(TABLE({events}) PARTITION BY user_id ORDER BY (ts), 1800.0)", events=events)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf

from tessera.functions.chunks import recursive_split


def _constant(argument: pa.Array):
    return argument[0].as_py()


def _field(schema: T.StructType, name: str) -> T.StructField:
    if name not in schema.names:
        raise ValueError(f"the table has no column {name}")
    return schema[name]


def register_split_table(spark: SparkSession, name: str, schema: T.StructType, text: str) -> None:
    """``name(TABLE(t), size, overlap)``: all columns of the table but the text, with ``chunk_no`` and ``chunk``, the text cut in pieces of bounded size."""
    _field(schema, text)
    kept = [f for f in schema if f.name != text]
    returns = T.StructType([*kept, T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())])

    class SplitTable:
        def eval(self, rows: pa.RecordBatch, size: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
            if not rows.num_rows:
                return
            lists = [recursive_split(t or "", _constant(size), _constant(overlap)) for t in rows.column(text).to_pylist()]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            at = pa.array(np.repeat(np.arange(len(lists)), counts))
            numbers = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.table({**{f.name: rows.column(f.name).take(at) for f in kept}, "chunk_no": pa.array(numbers.astype(np.int32)),
                            "chunk": pa.array([c for own in lists for c in own], pa.string())})

    spark.udtf.register(name, arrow_udtf(SplitTable, returnType=returns))


def register_gap_sessions(spark: SparkSession, name: str, schema: T.StructType, key: str, ts: str) -> None:
    """``name(TABLE(t) PARTITION BY key ORDER BY (ts), gap)``: (key, first, last, turns) of rows that follow each other within ``gap`` seconds.

    A partition comes in batches; the open session goes from one to the next.
    """
    of, at = _field(schema, key), _field(schema, ts)
    returns = T.StructType([of, T.StructField("first", at.dataType), T.StructField("last", at.dataType), T.StructField("turns", T.LongType())])

    class GapSessions:
        def __init__(self) -> None:
            self.open = None

        def _table(self, sessions: list[tuple]) -> pa.Table:
            first, last, turns = zip(*sessions)
            value, kind, stamp = self.about
            return pa.table({key: pa.array([value] * len(sessions), kind), "first": pa.array(first, pa.int64()).cast(stamp),
                             "last": pa.array(last, pa.int64()).cast(stamp), "turns": pa.array(turns, pa.int64())})

        def eval(self, rows: pa.RecordBatch, gap: pa.Array) -> Iterator[pa.Table]:
            if not rows.num_rows:
                return
            keys, stamps = rows.column(key), rows.column(ts)
            self.about = keys[0].as_py(), keys.type, stamps.type
            times, width = stamps.cast(pa.int64()).to_numpy(), int(float(_constant(gap)) * 1_000_000)
            cuts = np.flatnonzero(np.diff(times) >= width) + 1
            spans = [(int(times[i]), int(times[j - 1]), int(j - i)) for i, j in zip([0, *cuts], [*cuts, len(times)])]
            if self.open and spans[0][0] - self.open[1] < width:
                spans[0] = self.open[0], spans[0][1], self.open[2] + spans[0][2]
            elif self.open:
                spans.insert(0, self.open)
            self.open = spans.pop()
            if spans:
                yield self._table(spans)

        def terminate(self) -> Iterator[pa.Table]:
            if self.open:
                yield self._table([self.open])

    spark.udtf.register(name, arrow_udtf(GapSessions, returnType=returns))
