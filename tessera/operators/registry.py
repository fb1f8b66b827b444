"""Prompt versions, aliases and sessions as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import topk_per_group


def register_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append for ``new`` (prompt_name, prompt_text, ...): the next version number of each name."""
    last = versions.groupBy("prompt_name").agg(F.max("version").alias("_last"))
    numbered = new.join(last, "prompt_name", "left")
    return numbered.withColumn("version", F.coalesce(F.col("_last"), F.lit(0)) + 1).drop("_last")


def alias_change(spark, prompt_name: str, alias: str, version: int, at: Column, seq: int = 0) -> DataFrame:
    """One row to append to the alias log; promotion and roll-back are such rows too."""
    return spark.range(1).select(
        F.lit(prompt_name).alias("prompt_name"), F.lit(alias).alias("alias"), F.lit(version).cast("bigint").alias("version"),
        at.cast("timestamp").alias("ts"), F.lit(seq).cast("bigint").alias("seq"))


def current_aliases(alias_log: DataFrame) -> DataFrame:
    """(prompt_name, alias, version, rollback_version): the last entry of each alias by (ts, seq), and the one before.

    ``rollback_version`` is where a roll-back leads; null if the alias never moved. Only two log rows
    per alias and task are shuffled.
    """
    keys = ["prompt_name", "alias"]
    newest = topk_per_group(alias_log, keys, [F.col("ts").desc(), F.col("seq").desc()], 2, "_n")
    at = lambda n: F.max(F.when(F.col("_n") == n, F.col("version")))
    return newest.groupBy(*keys).agg(at(1).alias("version"), at(2).alias("rollback_version"))


def current_prompts(versions: DataFrame, alias_log: DataFrame) -> DataFrame:
    return current_aliases(alias_log).join(versions, ["prompt_name", "version"])


def active_prompts(versions: DataFrame) -> DataFrame:
    """Newest active version of each prompt."""
    active = versions.where(F.col("is_active"))
    newest = active.groupBy("prompt_name").agg(F.max("version").alias("version"))
    return active.join(newest, ["prompt_name", "version"], "left_semi")


def session_rollup(turns: DataFrame, session: str, order: str, user: Column | None = None) -> DataFrame:
    """(session, turns, first, last, user) per session."""
    extra = [F.min_by(user, F.col(order)).alias("user")] if user is not None else []
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.min(order).alias("first"),
                                      F.max(order).alias("last"), *extra)
