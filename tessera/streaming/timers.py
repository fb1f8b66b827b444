"""Sessions kept by event-time timers, with late rows set aside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OPEN = "first array<bigint>, last array<bigint>, turns array<bigint>"


def merged_sessions(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (first, last, rows) in order of time; those that begin within ``gap`` of the end of the one before are one."""
    out: list[tuple[int, int, int]] = []
    for first, last, turns in sorted(sessions):
        if out and first - out[-1][1] < gap:
            out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] + turns
        else:
            out.append((first, last, turns))
    return out


class SessionTimers(StatefulProcessor):
    """Open sessions of a key, in order of time; one timer at the end of the first hands out all that the watermark has passed, and forgets them."""

    def __init__(self, key: str, gap: int) -> None:
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def _load(self) -> list[tuple[int, int, int]]:
        return list(zip(*self.open.get())) if self.open.exists() else []

    def _store(self, sessions: list[tuple[int, int, int]]) -> None:
        if sessions:
            self.open.update(tuple(map(list, zip(*sessions))))
        else:
            self.open.clear()

    def _due(self, session: tuple[int, int, int]) -> int:
        """Milliseconds at which no row on time can still belong to the session."""
        return -(-(session[1] + self.gap) // 1000)

    def _rows(self, key, kind: str, rows: list[tuple[int, int, int]]) -> pd.DataFrame:
        first, last, turns = (list(c) for c in zip(*rows))
        return pd.DataFrame({self.key: [key[0]] * len(rows), "kind": [kind] * len(rows), "first": first, "last": last, "turns": turns})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        # turns of a time stand for equal rows
        at, n = np.unique(np.concatenate([np.asarray(times, np.int64) for frame in rows for times in frame["times"]]), return_counts=True)
        every = list(zip(at.tolist(), at.tolist(), n.tolist()))
        behind = int(np.searchsorted(at, edge))
        before, late = self._load(), every[:behind]
        after = merged_sessions([*before, *every[behind:]], self.gap)
        # sessions are apart by the gap, so the first is due first
        old, new = ({self._due(s) for s in sessions[:1]} for sessions in (before, after))
        for due in old - new:
            self.handle.deleteTimer(due)
        for due in new - old:
            self.handle.registerTimer(due)
        if after != before:
            self._store(after)
        if late:
            yield self._rows(key, "late", late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        sessions = self._load()
        done = [s for s in sessions if self._due(s) <= now]
        self._store(sessions[len(done):])
        if len(done) < len(sessions):
            self.handle.registerTimer(self._due(sessions[len(done)]))
        if done:
            yield self._rows(key, "session", done)

    def close(self) -> None:
        pass


def stream_session_timers(stream: DataFrame, ts: str, key: str, gap_minutes: float, watermark: str) -> DataFrame:
    """(key, kind, first, last, turns): each session once when the watermark has passed its end, and late rows at once.

    Rows of a key that follow each other within the gap are a session. A row older than the watermark is ``late``: it belongs to no session and comes
    out as a row of its own (equal ones of a batch as one, with their number). State of a key goes when its last session has come out. Times of a key are put
    together within each Arrow batch, so a key with a third of all rows sends few rows. Rows without a key only move the watermark.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, watermark).select(F.col(key), F.col(ts), F.unix_micros(ts).alias("_t"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            narrow = pa.Table.from_batches([batch]).select([key, "_t"]).drop_null()
            if narrow.num_rows:
                times = narrow.group_by(key, use_threads=False).aggregate([("_t", "list")]).rename_columns({"_t_list": "times"})
                yield from times.select([key, "times"]).combine_chunks().to_batches()

    # the event time itself ends here, so that rows behind the watermark are not dropped before they are seen
    small = rows.mapInArrow(gather, f"{key} {kind}, times array<bigint>")
    found = small.groupBy(key).transformWithStateInPandas(
        SessionTimers(key, int(gap_minutes * 60_000_000)), f"{key} {kind}, kind string, first bigint, last bigint, turns bigint", "Append", "EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})
