"""File layouts that let a reader skip: rows clustered by several columns, and tables read file by file in the order of a key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.core import let

#: Bits that each column gives to the place on the curve.
CURVE_BITS = 8


def _rank(value: Column, edges: list[float]) -> Column:
    """How many of the sorted edges are at or below the value, by bisection."""
    if not edges:
        return F.lit(0)
    at = F.array(*map(F.lit, edges))

    def go(low: Column, bit: int) -> Column:
        if bit < 0:
            return low
        ahead = low + (1 << bit)
        return let(F.when((ahead <= len(edges)) & (F.get(at, ahead - 1) <= value), ahead).otherwise(low), lambda x: go(x, bit - 1))

    return go(F.lit(0), len(edges).bit_length() - 1)


def curve_place(df: DataFrame, columns: list[str], bits: int = CURVE_BITS) -> Column:
    """Place of a row on a Z-order curve over the columns, a number of ``bits`` bits per column.

    Each column counts by its rank among about 2 ** ``bits`` quantiles, so skewed columns use the whole curve; text counts by a hash, which serves
    lookups of single values. A null takes the lowest place. The quantiles come from one pass with mergeable sketches.
    """
    plain = {c: df.schema[c].dataType.simpleString() in ("string", "binary", "boolean") for c in columns}
    value = {c: F.pmod(F.xxhash64(c), F.lit(1 << 52)).cast("double") if plain[c] else F.expr(f"cast(`{c}` as double)") for c in columns}
    ps = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(value[c], ps, 100 << bits).alias(c) for c in columns]).first()
    places = []
    for c in columns:
        places.append(F.when(F.col(c).isNull(), 0).otherwise(_rank(value[c], sorted(set(found[c] or [])))).cast("bigint"))
    out = F.lit(0).cast("bigint")
    for b in range(bits + 1):
        for i, p in enumerate(places):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(p, b).bitwiseAND(F.lit(1).cast("bigint")), b * len(places) + i))
    return out


def save_clustered(df: DataFrame, path: str, columns: list[str], files: int | None = None, row_group_bytes: int = 16 << 20, bloom: list[str] | None = None) -> None:
    """Writes ``df`` so that a lookup by any of ``columns`` skips most files and row groups.

    Rows go to files by ranges of their place on the curve, so each file and row group spans a narrow range of every column. ``bloom`` columns
    also get Bloom filters, which rule out row groups whose range holds a value that is not there.
    """
    placed = df.withColumn("_place", curve_place(df, columns))
    ranged = placed.repartitionByRange(files, "_place") if files else placed.repartitionByRange("_place")
    writer = ranged.sortWithinPartitions("_place").drop("_place").write.mode("overwrite").option("parquet.block.size", str(row_group_bytes))
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


# ---------------------------------------------------------------- the first matches by a key


def file_ranges(spark: SparkSession, path: str, key: str) -> list[tuple[str, object, object]]:
    """(file, least key, greatest key) of each file of a table in the order of the least key; one pass over the key column, one row per file."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col(key).alias("k")).where("k is not null")
    found = rows.groupBy("f").agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("low", "f")
    return [tuple(r) for r in found.toLocalIterator()]


def waves(ranges: list[tuple[str, object, object]], first: int = 1, grow: int = 2) -> Iterator[tuple[list[str], object]]:
    """(files, least key of the files that follow or None) of growing stretches of the files."""
    at, size = 0, first
    while at < len(ranges):
        part = ranges[at:at + size]
        at, size = at + size, size * grow
        yield [r[0] for r in part], ranges[at][1] if at < len(ranges) else None


def take_matching_early(spark: SparkSession, path: str, condition: Column, n: int, key: str, ranges: list[tuple[str, object, object]] | None = None) -> DataFrame:
    """The ``n`` first rows by ``key`` that meet ``condition``; reading stops as soon as they are certain.

    Files are read in the order of their least key, in stretches that double. Once ``n`` matches lie below the least key of all files that
    follow, no other file can change the result. So the rows read are bounded by the place of the n-th match (times two, and the files that
    overlap it); a table in no order of the key is read whole. ``ranges`` (``file_ranges``) may be kept with the table. Rows without a key come last
    and are looked at only if matches are missing. Equal keys go by the whole row.
    """
    schema = spark.read.parquet(path).schema
    known = ranges if ranges is not None else file_ranges(spark, path, key)
    order = [F.col(key), *[F.col(f"`{f.name}`") for f in schema if f.name != key and f.dataType.typeName() not in ("map", "variant")]]
    files: list[str] = []
    for more, following in waves(known):
        files += more
        found = spark.read.schema(schema).parquet(*files).where(condition & F.col(key).isNotNull())
        sure = found if following is None else found.where(F.col(key) < F.lit(following))
        # n keys at most are counted
        if sure.select(key).limit(n).count() >= n:
            return sure.orderBy(*order).limit(n)
    rows = spark.read.schema(schema).parquet(path).where(condition)
    return rows.orderBy(F.col(key).asc_nulls_last(), *order[1:]).limit(n)
