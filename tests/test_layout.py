"""What lookups and early stops read."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.sources import layout


def groups_with(folder, column, value):
    """(row groups whose range holds the value, all row groups)."""
    hit = total = 0
    for f in sorted(folder.glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            at = [meta.row_group(g).column(i).path_in_schema for i in range(meta.num_columns)].index(column)
            s = meta.row_group(g).column(at).statistics
            total += 1
            hit += s.has_min_max and s.min <= value <= s.max
    return hit, total


def test_both_columns_skip_most_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(100_000) if rng.random() < 0.7 else 5, int(rng.expovariate(1 / 500)), f"u{rng.randrange(300)}", i) for i in range(30_000)] + [(None, None, None, -1)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint, c string, id bigint")
    layout.save_clustered(frame, str(tmp_path / "z"), ["a", "b"], 64, bloom=["a", "b"])
    for column, value in (("a", 61_803), ("a", 20_000), ("b", 77), ("b", 1200)):
        hit, total = groups_with(tmp_path / "z", column, value)
        assert total == 64 and hit <= 20
    stored = spark.read.parquet(str(tmp_path / "z"))
    assert sorted((tuple(r) for r in stored.collect()), key=repr) == sorted(rows, key=repr)
    meta = pq.ParquetFile(next((tmp_path / "z").glob("*.parquet"))).metadata
    assert meta.num_columns == 4
    with open(next((tmp_path / "z").glob("*.parquet")), "rb") as f:
        assert len(f.read()) > sum(meta.row_group(0).column(i).total_compressed_size for i in range(4)) + 1000


def test_place_on_the_curve_orders_each_column(spark):
    rows = [(x, y) for x in range(16) for y in range(16)]
    frame = spark.createDataFrame(rows, "x int, y int")
    got = {(r["x"], r["y"]): r["p"] for r in frame.select("x", "y", layout.curve_place(frame, ["x", "y"], 2).alias("p")).collect()}
    # with two bits a column has four ranks; places of one column alone rise with it
    assert all(got[x, 0] <= got[x + 1, 0] for x in range(15)) and all(got[0, y] <= got[0, y + 1] for y in range(15))
    assert len(set(got.values())) == 16
    empty = frame.limit(0)
    assert empty.select(layout.curve_place(empty, ["x"])).count() == 0


@pytest.mark.parametrize("n", [1, 7, 40, 10_000])
def test_early_stop_gives_the_plain_result(spark, folder, n):
    rng = random.Random(n)
    rows = [(rng.randrange(4000), rng.choice("ab"), i) for i in range(5000)] + [(None, "a", 9000), (None, "b", 9001)]
    frame = spark.createDataFrame(rows, "key int, k string, id int")
    for name, kept in (("sorted", frame.repartitionByRange(25, "key")), ("mixed", frame.repartition(6))):
        kept.write.parquet(folder(name))
        got = [tuple(r) for r in layout.take_matching_early(spark, folder(name), F.col("k") == "a", n, "key").collect()]
        want = sorted((r for r in rows if r[1] == "a"), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))[:n]
        assert got == want


def test_early_stop_reads_a_part(spark, folder):
    spark.range(10_000).withColumn("k", F.col("id") % 2).repartitionByRange(50, "id").write.parquet(folder("t"))
    ranges = layout.file_ranges(spark, folder("t"), "id")
    assert len(ranges) == 50 and ranges == sorted(ranges, key=lambda r: r[1])
    found = layout.take_matching_early(spark, folder("t"), F.col("k") == 1, 60, "id", ranges)
    assert [r["id"] for r in found.collect()] == list(range(1, 121, 2))
    # 120 rows lie in the first file; the wave that makes it certain is the first
    assert len(found.inputFiles()) == 1
    assert len(layout.take_matching_early(spark, folder("t"), F.col("k") == 1, 500, "id", ranges).inputFiles()) <= 15
    assert layout.take_matching_early(spark, folder("t"), F.col("k") == 5, 3, "id", ranges).count() == 0


def test_waves_double():
    ranges = [(f"f{i}", i, i) for i in range(10)]
    assert [(len(f), nxt) for f, nxt in layout.waves(ranges)] == [(1, 1), (2, 3), (4, 7), (3, None)]
    assert list(layout.waves([])) == []
