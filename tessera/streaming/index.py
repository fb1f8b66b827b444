"""Upserts from a change stream, and scorers on new rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.evaluation import KIND_TYPES, Scorer
from tessera.operators.ranking import topk_per_group
from tessera.streaming.sources import run_available, sampled

BUCKETS = 64
#: Folders of one written batch: its place among all batches, and the run and number it came with.
STEP = ["version", "run", "batch"]


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _current(rows: DataFrame) -> DataFrame:
    """Rows of the newest version of each bucket."""
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    # At most one row per bucket, so the broadcast is bounded; it prunes the partitions that are read.
    return rows.join(F.broadcast(newest), ["bucket", "version"])


def read_index(spark: SparkSession, path: str, deleted: str | None = None) -> DataFrame:
    rows = _current(_versions(spark, path)).drop("bucket", *STEP)
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else rows


def upsert_batch(spark: SparkSession, path: str, rows: DataFrame, batch_id: int, pk: str, order: list[str],
                 buckets: int = BUCKETS, run: str = "direct") -> None:
    """Writes a new version of the key buckets that ``rows`` touches.

    Versions follow those already stored, so several runs, each with batches from 0, may write to one index in turn. The newest
    row of a key by ``order`` wins, whatever order batches bring them in. A batch of a run that comes again reads only earlier
    versions and replaces its own, so replay changes nothing. Deleted keys stay as rows with their flag.
    """
    fresh = rows.withColumn("bucket", F.pmod(F.xxhash64(pk), F.lit(buckets)).cast("int"))
    stored, version = _versions(spark, path), 0
    if stored is not None:
        # Folder names only: no data column is read.
        same = (F.col("run") == run) & (F.col("batch") == batch_id)
        own, last = stored.agg(F.max(F.when(same, F.col("version"))), F.max("version")).first()
        version = own if own is not None else 0 if last is None else last + 1
        before = _current(stored.where(F.col("version") < version)).drop(*STEP)
        touched = F.broadcast(fresh.select("bucket").distinct())
        fresh = fresh.unionByName(before.join(touched, "bucket", "left_semi"))
    kept = topk_per_group(fresh, ["bucket", pk], [F.col(c).desc() for c in order], 1, "_n").drop("_n")
    kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={version}/run={run}/batch={batch_id}")


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """Writes the current rows of an index as one version at ``target``; further syncs may go on from there."""
    current = _current(_versions(spark, path)).drop(*STEP)
    current.repartition("bucket").write.partitionBy("bucket").parquet(f"{target}/version=0/run=compact/batch=0")


def stream_index_sync(stream: DataFrame, pk: str, order: list[str], path: str, checkpoint: str,
                      buckets: int = BUCKETS) -> None:
    """Brings an index table up to date with a change stream and stops.

    One stream at a time writes to an index. A run is known by the id that Spark keeps in its checkpoint, so a new checkpoint
    adds to the index and a restarted one replays its own last batch.
    """
    spark = stream.sparkSession

    def upsert(rows: DataFrame, batch_id: int) -> None:
        # Read twice: for the buckets it touches and for its rows.
        rows.persist()
        run = "run-" + spark.read.json(f"{checkpoint}/metadata").first()["id"]
        upsert_batch(spark, path, rows, batch_id, pk, order, buckets, run)
        rows.unpersist()

    run_available(stream, checkpoint, "append", upsert)


def stream_monitor(stream: DataFrame, id_col: str, scorers: list[Scorer], rate: float) -> DataFrame:
    """Scorer columns for a fixed-rate sample of new rows."""
    picked = stream.where(sampled(F.col(id_col), rate))
    scores: list[Column] = [s.build().cast(KIND_TYPES[s.kind]).alias(s.name) for s in scorers]
    return picked.select(id_col, *scores)
