"""Custom state: consecutive readings of a state per key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which custom state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _summary(good: list[int], bad: int, n: int) -> tuple[list[int], int]:
    """The n newest good readings and the newest bad one: all that the streak rule needs, in any order of arrival."""
    return sorted((g for g in good if g > bad), reverse=True)[:n], bad


class Streak(StatefulProcessor):
    """Keeps the n newest good positions and the newest bad position of a key."""

    def __init__(self, key: str, n: int) -> None:
        self.key, self.n = key, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "good array<bigint>, bad bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        good, bad = [], -1
        if self.state.exists():
            stored = self.state.get()
            good, bad = list(stored[0]), stored[1]
        for frame in rows:
            bad = max([bad, *frame.loc[~frame["active"], "pos"].tolist()])
            good, bad = _summary(good + frame.loc[frame["active"], "pos"].tolist(), bad, self.n)
        self.state.update((good, bad))
        yield pd.DataFrame({self.key: [key[0]], "streak": [len(good)], "ready": [len(good) >= self.n]})

    def close(self) -> None:
        pass


def stream_latest_state(stream: DataFrame, key: str, state: str, pos: str, n: int, active: str = "ACTIVE") -> DataFrame:
    """(key, streak up to n, ready): ready after n ``active`` readings in a row, by position.

    Rows are reduced to at most n + 1 per key within each Arrow batch before they are shuffled, so
    a key with very many readings sends little.
    """
    key_type = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key), F.col(pos).cast("bigint").alias("pos"), (F.col(state) == active).alias("active"))

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            newest = frame.sort_values("pos", ascending=False)
            good = newest[newest["active"]].groupby(key, sort=False).head(n)
            bad = newest[~newest["active"]].groupby(key, sort=False).head(1)
            yield pd.concat([good, bad])

    small = rows.mapInPandas(combine, f"{key} {key_type}, pos bigint, active boolean")
    return small.groupBy(key).transformWithStateInPandas(
        Streak(key, n), f"{key} {key_type}, streak int, ready boolean", "Update", "None")
