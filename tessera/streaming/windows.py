"""Windows, sessions, deduplication and late rows over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranking import global_running
from tessera.streaming.sources import run_available


def stream_tumbling_usage(stream: DataFrame, ts: str, width: str, watermark: str, keys: list[str],
                          quantity: str) -> DataFrame:
    return (stream.withWatermark(ts, watermark).groupBy(F.window(ts, width), *keys)
            .agg(F.sum(quantity).alias("total"), F.count(F.lit(1)).alias("rows"))
            .select(F.col("window.start").alias("start"), *keys, "total", "rows"))


def stream_sliding_latency(stream: DataFrame, ts: str, width: str, slide: str, watermark: str, value: str,
                           ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Rolling percentiles from a mergeable sketch, so late rows and many tasks can add to a window."""
    sketched = (stream.withWatermark(ts, watermark).groupBy(F.window(ts, width, slide))
                .agg(F.percentile_approx(value, list(ps), 10_000).alias("_p"), F.count(F.lit(1)).alias("rows")))
    return sketched.select(F.col("window.start").alias("start"), "rows",
                           *[F.col("_p")[i].alias(f"p{p * 100:g}") for i, p in enumerate(ps)])


def stream_sessions(stream: DataFrame, ts: str, key: str, gap: str, watermark: str) -> DataFrame:
    """Rows of a key that follow each other within ``gap``, as sessions.

    Sessions are merged within each task before the shuffle, so a key with very many rows sends little.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("_s"), key)
            .agg(F.count(F.lit(1)).alias("turns"), F.max(ts).alias("last"))
            .select(key, F.col("_s.start").alias("first"), "last", "turns"))


def closing_rows(spark: SparkSession, path: str, schema, ts: str) -> None:
    """Writes one row far in the future, which closes all open windows of a bounded run.

    Its other columns are null and its own window never closes, so it adds nothing to the result.
    """
    far = F.to_timestamp(F.lit("2200-01-01 00:00:00"))
    row = [far.cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name)
           for f in schema]
    spark.range(1).select(*row).write.mode("overwrite").parquet(path)


def stream_dedup(stream: DataFrame, ts: str, keys: list[str], watermark: str, combine: bool = True) -> DataFrame:
    """First row of each key; the same key within the watermark is dropped and its state forgotten after it.

    With ``combine``, copies inside one Arrow batch go before the shuffle: a key with very many copies
    sends one row per batch. Select the needed columns first, they pass through Python.
    """
    def first_of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop_duplicates(keys)

    rows = stream.mapInPandas(first_of_batch, stream.schema) if combine else stream
    return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def late_rows(df: DataFrame, arrival: list[Column], ts: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(on time, late): a row is late if it is older than the newest row seen so far less ``delay``."""
    seen = global_running(df, arrival, maxes={"_newest": F.col(ts)})
    late = F.col(ts) < F.col("_newest") - F.expr(f"INTERVAL {delay}")
    return seen.where(~late).drop("_newest"), seen.where(late).drop("_newest")


def stream_late_rows(stream: DataFrame, ts: str, delay: str, path: str, checkpoint: str) -> None:
    """The same rule over batches: rows older than the newest row of all earlier batches go to ``late``.

    Writes ``on_time``, ``late`` and ``newest`` below ``path``, one folder per batch, so a batch that
    runs again replaces its own output.
    """
    spark = stream.sparkSession

    def split(rows: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id > 0:
            known = spark.read.schema("newest timestamp").parquet(f"{path}/newest/batch={batch_id - 1}")
            newest = known.agg(F.max("newest")).first()[0]
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts) < limit, F.lit(False))
        for name, part in (("on_time", rows.where(~late)), ("late", rows.where(late))):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        rows.agg(F.greatest(F.max(ts), F.lit(newest).cast("timestamp")).alias("newest")).write.mode(
            "overwrite").parquet(f"{path}/newest/batch={batch_id}")

    run_available(stream, checkpoint, "append", split)
