"""Quantile and distinct-count sketches kept per fine window, and merged to coarser ones without the rows.

A window's row holds the number of rows, a KLL sketch of a value and an HLL sketch of an id, each of bounded size. Windows of any greater width, sliding
ones and totals come from these rows alone, so the events are read once and a stream can append closed windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch; the rank of an answer is within ``RANK_ERROR`` of the asked one, twice the spread that the sketch has in 99 of 100 cases.
KLL_K, RANK_ERROR = 200, 0.033
#: Logarithm of the size of a distinct-count sketch; its relative spread is 1.04 / sqrt(2 ** 12), and ``DISTINCT_ERROR`` is four times that.
HLL_K, DISTINCT_ERROR = 12, 0.065


def _sketches(value: str, distinct: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("quantiles"),
            F.hll_sketch_agg(F.col(distinct), F.lit(HLL_K)).alias("distincts")]


def sketch_windows(df: DataFrame, ts: str, width: str, keys: list[str], value: str, distinct: str) -> DataFrame:
    """(start, keys, rows, quantiles, distincts) per tumbling window; combined before the shuffle. Null values and ids do not count in the sketches."""
    made = df.groupBy(F.window(ts, width), *keys).agg(*_sketches(value, distinct))
    return made.select(F.col("window.start").alias("start"), *keys, "rows", "quantiles", "distincts")


def stream_sketch_windows(stream: DataFrame, ts: str, width: str, watermark: str, keys: list[str], value: str, distinct: str) -> DataFrame:
    """The same over a stream, for append mode: a window comes out once, when the watermark has passed it, and its state goes."""
    return sketch_windows(stream.withWatermark(ts, watermark), ts, width, keys, value, distinct)


def roll_up(windows: DataFrame, keys: list[str], width: str | None = None, slide: str | None = None) -> DataFrame:
    """Sketch rows merged by ``keys`` and, if given, by a window of ``width`` that moves by ``slide`` (a multiple of the fine windows)."""
    by = [F.window("start", width, slide)] if width and slide else [F.window("start", width)] if width else []
    merged = windows.groupBy(*by, *keys).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("quantiles", F.lit(KLL_K)).alias("quantiles"),
                                             F.hll_union_agg("distincts").alias("distincts"))
    return merged.select(*([F.col("window.start").alias("start")] if by else []), *keys, "rows", "quantiles", "distincts")


def quantiles_of(windows: DataFrame, ps: list[float]) -> DataFrame:
    """Sketch rows with a column ``p50``, ``p99`` and so on for each of ``ps``, and ``distinct``, instead of the sketches."""
    some = F.coalesce(F.col("rows") > 0, F.lit(False))
    # a sketch without values has no quantiles
    held = F.when(some, F.kll_sketch_get_n_double("quantiles") > 0)
    found = [F.when(held, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(f"p{p * 100:g}") for p in ps]
    plain = [c for c in windows.columns if c not in ("quantiles", "distincts")]
    return windows.select(*plain, *found, F.when(some, F.hll_sketch_estimate("distincts")).alias("distinct"))


def rank_holds(below: Column, upto: Column, n: Column, p: float, error: float = RANK_ERROR) -> Column:
    """Whether an answer has rank ``p`` within ``error``: ``below`` and ``upto`` count the rows less than it, and not greater than it."""
    return (below / n <= p + error) & (upto / n >= p - error)
