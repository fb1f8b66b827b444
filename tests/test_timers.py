"""Sessions by timers over several runs: each once, late rows aside, nothing left in state."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.streaming import sources, state, timers, windows

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp"


def sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] < gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_merging_of_sessions():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randrange(200) for _ in range(rng.randrange(30))]
        assert timers.merged_sessions([(t, t, 1) for t in times], 7) == sessions(times, 7)
        part = sessions(times[:9], 7) + sessions(times[9:], 7)
        assert timers.merged_sessions(part, 7) == sessions(times, 7)


def test_each_session_once_and_late_rows_aside(spark, folder):
    rng = random.Random(2)
    batches = [[(rng.choice("aaab"), base + rng.randrange(600)) for _ in range(40)] for base in (0, 900, 500, 2400)]
    batches[2] += [("b", 1), ("b", 1), (None, 3)]
    newest, want, late = None, {}, []
    for rows in batches:
        for k, m in rows:
            if k is None:
                continue
            if newest is not None and m < newest - 60:
                late.append((k, m))
            else:
                want.setdefault(k, []).append(m)
        newest = max([m for _, m in rows] + ([newest] if newest else []))
    assert late and len(late) < 60
    ending = folder("end")
    at = lambda m: DAY + dt.timedelta(minutes=m)
    spark.createDataFrame([], SCHEMA).write.parquet(folder("in"))
    windows.closing_rows(spark, ending, spark.read.parquet(folder("in")).schema, "ts")
    for rows in [*batches, None]:
        frame = spark.read.parquet(ending) if rows is None else spark.createDataFrame([(k, at(m)) for k, m in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(folder("in"))
        stream = sources.stream_file_ingest(spark, folder("in"), SCHEMA)
        with state.rocksdb(spark):
            sources.append_table(timers.stream_session_timers(stream, "ts", "k", 30, "60 minutes"), folder("out"), folder("ckpt"))
    minutes = lambda c: ((F.unix_micros(c) - F.unix_micros(F.lit(DAY))) / 60_000_000).cast("int")
    got = spark.read.parquet(folder("out")).select("k", "kind", minutes("first"), minutes("last"), "turns").collect()
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got if r[1] == "session") == sorted((k, *s) for k, ms in want.items() for s in sessions(ms, 30))
    assert sorted((r[0], r[2]) for r in got if r[1] == "late" for _ in range(r[4])) == sorted(late)
    held = spark.read.format("statestore").option("path", folder("ckpt")).option("stateVarName", "open").load()
    assert held.count() == 0


class Held:
    """Stands for the state of one key: a value, the timers set, and the calls made."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def clear(self):
        self.value, self.calls = None, self.calls + 1

    def registerTimer(self, due):
        self.timers.add(due)
        self.calls += 1

    def deleteTimer(self, due):
        self.timers.discard(due)
        self.calls += 1


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_calls_do_not_grow_with_the_sessions():
    import pandas as pd

    held, rule = Held(), timers.SessionTimers("k", 1000)
    rule.init(held)
    times = [i * 5000 for i in range(2000)]
    assert list(rule.handleInputRows(("a",), iter([pd.DataFrame({"times": [times[:900], times[900:]]})]), Clock(0))) == []
    assert len(held.timers) == 1 and held.calls <= 2
    fired = held.timers.pop()
    done = [r for f in rule.handleExpiredTimer(("a",), Clock(5000), Clock(fired)) for r in f.itertuples(index=False)]
    assert len(done) == 1000 and len(held.timers) == 1 and min(held.timers) > 5000 and held.calls <= 4
    held.timers.clear()
    done += [r for f in rule.handleExpiredTimer(("a",), Clock(10 ** 6), Clock(5001)) for r in f.itertuples(index=False)]
    assert [r.first for r in done] == times and held.value is None and not held.timers
