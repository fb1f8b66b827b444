"""Writers, idempotent rebuild and checks after a load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, binary columns left out: what a flat file can hold."""
    out = []
    for field in df.schema:
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out.append(F.to_json(F.col(f"`{field.name}`")).alias(field.name))
        elif not isinstance(field.dataType, T.BinaryType):
            out.append(F.col(f"`{field.name}`"))
    return df.select(*out)


def save_csv(df: DataFrame, path: str) -> None:
    flat_columns(df).write.mode("overwrite").csv(path, header=True, escape='"')


def load_check(df: DataFrame, expected_rows: int | None = None, vector: str | None = None,
               dim: int | None = None) -> DataFrame:
    """(rows, min_dim, max_dim, ok) in one pass over the table."""
    size = F.size(vector) if vector else F.lit(None).cast("int")
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))
    ok: Column = F.lit(True)
    if expected_rows is not None:
        ok = ok & (F.col("rows") == expected_rows)
    if vector and dim is not None:
        ok = ok & F.coalesce((F.col("min_dim") == dim) & (F.col("max_dim") == dim), F.lit(False))
    return found.withColumn("ok", ok)


def require_load(df: DataFrame, expected_rows: int | None = None, vector: str | None = None,
                 dim: int | None = None) -> None:
    found = load_check(df, expected_rows, vector, dim).first()
    if not found["ok"]:
        raise ValueError(f"load check failed: {found.asDict()}")


def materialize_if_stale(spark: SparkSession, path: str, build: Callable[[], DataFrame], expected_rows: int,
                         vector: str | None = None, dim: int | None = None) -> str:
    """Rebuild the table at ``path`` only if it is missing or fails the load check."""
    try:
        present = spark.read.parquet(path)
        if load_check(present, expected_rows, vector, dim).first()["ok"]:
            return "kept"
        action = "rebuilt"
    except AnalysisException:
        action = "created"
    save_table(build(), path)
    return action
