"""Filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.responses import is_json

def param_filter(spark: SparkSession, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    """SQL text with ``:name`` parameters over the given tables."""
    return spark.sql(sql, args=args, **tables)


def exact_lookup(df: DataFrame, column: str, value, columns: list[str]) -> DataFrame:
    return df.where(F.col(column) == value).select(*columns)


def null_or_error_split(df: DataFrame, status: str, good: str = "SUCCESS") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, error rows, counts); a null status is an error."""
    ok = F.coalesce(F.col(status) == good, F.lit(False))
    counts = df.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"))
    return df.where(ok), df.where(~ok), counts


def nested_field_filter(df: DataFrame, path: str, value) -> DataFrame:
    """Rows whose struct field (``a.b``) or JSON path (``col:$.a.b``) equals a value."""
    column, colon, json_path = path.partition(":")
    found = F.get_json_object(F.col(column), json_path) if colon else F.col(path)
    return df.where(found == F.lit(value))


def trace_search(traces: DataFrame, key: str, value: str, n: int, ts: str = "ts", id_col: str = "trace_id") -> DataFrame:
    return traces.where(F.col("metadata")[key] == value).orderBy(F.col(ts).desc(), F.col(id_col)).limit(n)


def drop_wide_columns(df: DataFrame) -> DataFrame:
    wide = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return df.select(*[f.name for f in df.schema if not isinstance(f.dataType, wide)])


def compare_outer(a: DataFrame, b: DataFrame, key: str, columns: list[str], suffixes: tuple[str, str],
                  delta_of: str, digits: int = 3) -> DataFrame:
    """Full outer join of two result sets on a key, with the rounded difference of one column."""
    left = a.select(key, *[F.col(c).alias(c + suffixes[0]) for c in columns])
    right = b.select(key, *[F.col(c).alias(c + suffixes[1]) for c in columns])
    both = left.join(right, key, "full")
    gap = F.col(delta_of + suffixes[1]) - F.col(delta_of + suffixes[0])
    return both.withColumn("delta", F.round(gap, digits))


def usage_semi_join(usage: DataFrame, entities: DataFrame, usage_key: str, entity_key: str, condition: Column) -> DataFrame:
    wanted = entities.where(condition).select(F.col(entity_key).alias(usage_key))
    return usage.join(wanted, usage_key, "left_semi")


def golden_inner_join(extractions: DataFrame, golden: DataFrame, key: str, response: str = "extracted") -> DataFrame:
    """Extractions with a golden row and a readable JSON answer; the rest is skipped."""
    usable = extractions.where(is_json(F.col(response)))
    return usable.join(golden, key)


def golden_missing(golden: DataFrame, extractions: DataFrame, key: str, response: str = "extracted") -> DataFrame:
    usable = extractions.where(is_json(F.col(response)))
    return golden.join(usable.select(key), key, "left_anti")


def model_matrix(df: DataFrame, models: list[str], name: str = "model_id") -> DataFrame:
    """Every row with every model: the list is expanded inside the row, no join is needed."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(m) for m in models])))


def replicate_rows(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def export_partitions(df: DataFrame, id_col: str, n: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.col(id_col), F.lit(n)).cast("int"))


def alias_join(versions: DataFrame, aliases: DataFrame, alias: str) -> DataFrame:
    chosen = aliases.where(F.col("alias") == alias).select("prompt_name", "version")
    return versions.join(chosen, ["prompt_name", "version"]).select("prompt_name", "version", "prompt_text")


def union_versions(frames: dict[str, DataFrame], label: str = "version") -> DataFrame:
    parts = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def set_minus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def label_set_check(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Labels of the test set that the train set lacks; no rows means the check passes."""
    return test.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")
