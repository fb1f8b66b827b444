"""File streams and bounded runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_file_ingest(spark: SparkSession, path: str, schema: StructType | str, glob: str | None = None,
                       files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as a stream. With a checkpoint, a later run reads only files it has not seen."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_table(spark: SparkSession, directory: str, name: str, schema: StructType | str) -> DataFrame:
    """A Parquet table of a directory as a stream, whether it is one file or a folder of files."""
    # A pattern stands for both; a plain path to one file is refused.
    return stream_file_ingest(spark, f"{directory.rstrip('/')}/{{{name}.parquet}}", schema)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp with time zone: watermarks reject the type without."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_available(df: DataFrame, checkpoint: str, mode: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Works off all input that is there, batch by batch, and stops."""
    query: StreamingQuery = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                             .trigger(availableNow=True).foreachBatch(batch).start())
    query.awaitTermination()


def append_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream into a Parquet table with the exactly-once file sink."""
    query = (df.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def replace_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregation and keeps its complete result at ``path``."""
    run_available(df, checkpoint, "complete", lambda rows, _: rows.write.mode("overwrite").parquet(path))


def sampled(id_col: Column, rate: float) -> Column:
    """Whether a row is in a sample of the given rate: the same rows on every run and replay."""
    share = F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return share < rate
