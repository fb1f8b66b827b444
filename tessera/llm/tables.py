"""Small parameter tables as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def parameter_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table of parameters from a literal; its size is that of the parameter."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")).alias("r")).select("r.*")
