import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import sketches

DAY = dt.datetime(2024, 1, 1)


def events(spark, n=20_000):
    rng = random.Random(1)
    rows = [(DAY + dt.timedelta(minutes=rng.randrange(3000)), "a" if rng.random() < 0.8 else "b", rng.gauss(0, 1) if rng.random() > 0.01 else None, rng.randrange(3000)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "ts timestamp, k string, x double, u bigint")


def test_answers_of_merged_sketches_are_within_their_bounds(spark):
    rows, frame = events(spark)
    fine = sketches.sketch_windows(frame.repartition(5), "ts", "30 minutes", ["k"], "x", "u")
    for r in sketches.quantiles_of(sketches.roll_up(fine, ["k"]), [0.1, 0.5, 0.99]).collect():
        own = [row for row in rows if row[1] == r["k"]]
        values = sorted(row[2] for row in own if row[2] is not None)
        assert r["rows"] == len(own) and abs(r["distinct"] - len({row[3] for row in own})) <= 1 + sketches.DISTINCT_ERROR * 3000
        for p in (0.1, 0.5, 0.99):
            rank = sum(v <= r[f"p{p * 100:g}"] for v in values) / len(values)
            assert abs(rank - p) <= sketches.RANK_ERROR


def test_small_windows_are_exact_and_slide(spark):
    rows = [(DAY + dt.timedelta(minutes=m), float(m), m % 3) for m in range(0, 180, 10)]
    frame = spark.createDataFrame(rows, "ts timestamp, x double, u bigint")
    fine = sketches.sketch_windows(frame, "ts", "30 minutes", [], "x", "u")
    got = sketches.quantiles_of(sketches.roll_up(fine, [], "1 hour", "30 minutes"), [0.0, 0.5, 1.0]).orderBy("start").collect()
    assert [r["rows"] for r in got] == [3, 6, 6, 6, 6, 6, 3]
    assert [(r["p0"], r["p100"]) for r in got][1] == (0.0, 50.0) and {r["distinct"] for r in got} == {3}
    whole = sketches.quantiles_of(sketches.roll_up(fine, []), [0.5]).first()
    assert whole["rows"] == 18 and whole["p50"] in (80.0, 90.0)


def test_roll_ups_read_no_rows(spark, folder):
    _, frame = events(spark, 500)
    sketches.sketch_windows(frame, "ts", "1 hour", ["k"], "x", "u").write.parquet(folder("s"))
    stored = spark.read.parquet(folder("s"))
    twice = sketches.roll_up(sketches.roll_up(stored, ["k"], "6 hours"), [], "1 day")
    assert twice.agg(F.sum("rows")).first()[0] == 500
    assert sketches.quantiles_of(sketches.roll_up(stored.limit(0), []), [0.5]).first()["rows"] is None


def test_windows_without_values(spark):
    frame = spark.createDataFrame([(DAY, None, None), (DAY + dt.timedelta(hours=2), 1.0, 5)], "ts timestamp, x double, u bigint")
    got = sketches.quantiles_of(sketches.sketch_windows(frame, "ts", "1 hour", [], "x", "u"), [0.5]).orderBy("start").collect()
    assert [(r["rows"], r["p50"], r["distinct"]) for r in got] == [(1, None, 0), (1, 1.0, 1)]
