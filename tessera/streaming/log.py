"""An index table kept as a log: one small segment per batch, merged in tiers, newest row per key at read.

Below the index's path:

- ``segments/<name>``: rows of one batch, or of several merged ones, one row per key, sorted by a hash bucket whose number follows from the
  segment's size;
- ``manifest/v=<n>``: the live segments and the last batch of each run, as a few rows. The newest manifest is the index; a segment that no
  manifest names does not count, so a batch that died between the two writes leaves no trace.

A batch writes its own rows and a manifest, whatever the size of the index. ``merge_segments`` merges a level that has too many segments into
one of the next level, so a row is written again once per level. Deleted keys stay as rows with their mark, since an older change of the key may still
come; ``merge_segments`` can drop them from the oldest segment where changes come in order.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import pin
from tessera.streaming.sources import run_available

#: Rows of a bucket, about: the sort unit of a segment's files.
BUCKET_ROWS = 100_000
#: Segments of a level that are merged into one.
FANOUT = 4
MANIFEST = "kind string, name string, level int, step bigint, rows bigint, run string, batch bigint"


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """(version, rows) of the newest manifest; a few rows."""
    try:
        stored = spark.read.schema(f"{MANIFEST}, v bigint").parquet(f"{path}/manifest")
        # folder names only
        version = stored.agg(F.max("v")).first()[0]
    except AnalysisException:
        return -1, []
    if version is None:
        return -1, []
    return version, [r.asDict() for r in stored.where(F.col("v") == version).drop("v").collect()]


def _commit(spark: SparkSession, path: str, version: int, rows: list[dict]) -> None:
    spark.createDataFrame([tuple(r[c] for c in ("kind", "name", "level", "step", "rows", "run", "batch")) for r in rows], MANIFEST).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/manifest/v={version}")


def _segments(rows: list[dict]) -> list[dict]:
    return sorted((r for r in rows if r["kind"] == "segment"), key=lambda r: r["step"])


def _newest(rows: DataFrame, pk: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, then the one that came last. Combined before the shuffle."""
    key = F.struct(*[F.col(c) for c in order], F.col("_step"))
    best = rows.groupBy(pk).agg(F.max_by(F.struct(*columns, "_step"), key).alias("_r"))
    return best.select("_r.*")


def _write_segment(rows: DataFrame, path: str, name: str, pk: str, count: int) -> None:
    buckets = max(1, -(-count // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(pk), F.lit(buckets))
    files = rows.repartition(buckets, bucket) if buckets > 1 else rows.coalesce(1)
    files.sortWithinPartitions(pk).write.mode("overwrite").parquet(f"{path}/segments/{name}")


def _read(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    parts = [spark.read.parquet(f"{path}/segments/{s['name']}") for s in segments]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def append_batch(spark: SparkSession, path: str, rows: DataFrame, batch_id: int, pk: str, order: list[str], run: str = "direct") -> None:
    """Adds one batch. Of its rows the newest of each key by ``order`` stays; a batch that its run has already committed changes nothing."""
    version, known = _manifest(spark, path)
    last = {r["run"]: r["batch"] for r in known if r["kind"] == "run"}
    if batch_id <= last.get(run, -1):
        return
    step = 1 + max((r["step"] for r in known), default=-1)
    kept = pin(_newest(rows.withColumn("_step", F.lit(step).cast("bigint")), pk, order, rows.columns))
    count = kept.count()
    entries = [r for r in known if not (r["kind"] == "run" and r["run"] == run)]
    entries.append({"kind": "run", "name": "", "level": 0, "step": step, "rows": 0, "run": run, "batch": batch_id})
    if count:
        name = f"{run}-{batch_id}"
        _write_segment(kept, path, name, pk, count)
        entries.append({"kind": "segment", "name": name, "level": 0, "step": step, "rows": count, "run": run, "batch": batch_id})
    _commit(spark, path, version + 1, entries)


def merge_segments(spark: SparkSession, path: str, pk: str, order: list[str], deleted: str | None = None, fanout: int = FANOUT) -> int:
    """Merges every level with ``fanout`` or more segments into one segment of the next level; returns the number of merges.

    The merged segments follow each other in time, so nothing newer lies between them. With ``deleted`` given, keys that it marks are forgotten when the
    oldest segment is among the merged ones: only for feeds that bring no change older than one that they have brought.
    """
    merges = 0
    while True:
        version, known = _manifest(spark, path)
        segments = _segments(known)
        level = next((n for n in sorted({s["level"] for s in segments}) if sum(s["level"] == n for s in segments) >= fanout), None)
        if level is None:
            return merges
        own = [s for s in segments if s["level"] == level]
        rows = _read(spark, path, own)
        kept = _newest(rows, pk, order, [c for c in rows.columns if c != "_step"])
        if deleted and own[0] is segments[0]:
            kept = kept.where(~F.coalesce(F.col(deleted), F.lit(False)))
        kept = pin(kept)
        count = kept.count()
        entries = [r for r in known if r not in own]
        if count:
            name = f"merged-{uuid.uuid4().hex}"
            _write_segment(kept, path, name, pk, count)
            entries.append({"kind": "segment", "name": name, "level": level + 1, "step": own[-1]["step"], "rows": count, "run": "", "batch": -1})
        _commit(spark, path, version + 1, entries)
        merges += 1


def read_log(spark: SparkSession, path: str, pk: str, order: list[str], deleted: str | None = None) -> DataFrame:
    """The index's rows: the newest of each key, without deleted ones.

    The largest segment holds a key once. The others are reduced to one row per key and meet it by key: where they are small, they go to
    its tasks and it is not shuffled.
    """
    _, known = _manifest(spark, path)
    segments = _segments(known)
    if not segments:
        raise ValueError(f"no index at {path}")
    alive = (lambda df: df.where(~F.coalesce(F.col(deleted), F.lit(False)))) if deleted else (lambda df: df)
    base = max(segments, key=lambda s: s["rows"])
    rows = _read(spark, path, [base])
    rest = [s for s in segments if s is not base]
    if not rest:
        return alive(rows.drop("_step"))
    others = _read(spark, path, rest)
    columns = [c for c in others.columns if c != "_step"]
    # stored: the planner then knows how small they are
    newer = pin(_newest(others, pk, order, columns))
    whole = F.struct(*[F.col(f"b.{c}") for c in (*order, "_step")]), F.struct(*[F.col(f"n.{c}") for c in (*order, "_step")])
    pair = rows.alias("b").join(newer.alias("n"), F.col(f"b.{pk}") == F.col(f"n.{pk}"), "left")
    stays = F.col(f"n.{pk}").isNull() | (whole[0] > whole[1])
    # a column that one side lacks is null there, as the segments may have gained columns
    of = lambda side, df: F.struct(*[(F.col(f"{side}.{c}") if c in df.columns else F.lit(None).cast(others.schema[c].dataType)).alias(c) for c in columns])
    met = pair.select(F.when(stays, of("b", rows)).otherwise(of("n", newer)).alias("r")).select("r.*")
    found = rows.join(newer.select(pk), pk, "left_semi").select(pk)
    return alive(met.unionByName(newer.join(found, pk, "left_anti").drop("_step")))


def expire_segments(spark: SparkSession, path: str) -> int:
    """Removes segments that the newest manifest does not name, and older manifests; no reader may still use them. Returns their number."""
    version, known = _manifest(spark, path)
    live = {s["name"] for s in _segments(known)} | {f"v={version}"}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for folder in ("segments", "manifest"):
        at = spark._jvm.org.apache.hadoop.fs.Path(root, folder)
        for entry in fs.listStatus(at) if fs.exists(at) else []:
            if entry.getPath().getName() not in live:
                fs.delete(entry.getPath(), True)
                gone += 1
    return gone


def stream_log_sync(stream: DataFrame, pk: str, order: list[str], path: str, checkpoint: str, fanout: int = FANOUT) -> None:
    """Brings an index up to date with a change stream, merges full levels, and stops. One stream at a time writes to an index."""
    spark = stream.sparkSession

    def add(rows: DataFrame, batch_id: int) -> None:
        append_batch(spark, path, rows, batch_id, pk, order, "run-" + spark.read.json(f"{checkpoint}/metadata").first()["id"])

    run_available(stream, checkpoint, "append", add)
    merge_segments(spark, path, pk, order, fanout=fanout)
