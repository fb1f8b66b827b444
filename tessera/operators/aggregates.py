"""Profiles and summaries. Every aggregate here has a map-side partial form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import global_running
from tessera.session import pin

PERCENTILE_ACCURACY = 10_000
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def daily_usage(df: DataFrame, ts: str, quantity: str, condition: Column | None = None) -> DataFrame:
    rows = df if condition is None else df.where(condition)
    return (rows.groupBy(F.to_date(ts).alias("day")).agg(F.sum(quantity).alias("total"))
            .orderBy(F.col("day").desc()))


def _positions(p: float, n: Column, kind: str) -> tuple[Column, Column, Column]:
    """Low and high zero-based positions and the weight of the high one."""
    at = F.lit(p) * (n - 1)
    if kind == "nearest":
        rank = F.least(F.greatest(F.bround(at), F.lit(0)), n - 1).cast("bigint")
        return rank, rank, F.lit(0.0)
    low = F.floor(at)
    return low, F.ceil(at), at - low


def exact_percentiles(df: DataFrame, keys: list[str], columns: list[str], ps: list[float],
                      kind: str = "linear", accuracy: int = PERCENTILE_ACCURACY) -> DataFrame:
    """Exact percentiles by group, one row per (keys, column, p): ``value``.

    A sketch first gives a narrow value band that must hold the wanted rank; then only the rows
    of that band are counted by value. No task ever holds a whole group, so a group with a third
    of all rows costs no more than its band: at most 8 / accuracy of its rows, by distinct value.
    ``linear`` interpolates; ``nearest`` takes the row at the half-even rounded rank.
    """
    spread = 3.0 / accuracy
    cells = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                   for c in columns])).alias("_cell"))
    cells = cells.select(*keys, "_cell.*").where(F.col("value").isNotNull())
    by = [*keys, "column"]
    edges = [max(p - spread, 0.0) for p in ps] + [min(p + spread, 1.0) for p in ps]
    stats = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("_min"), F.max("value").alias("_max"),
        F.percentile_approx("value", edges, accuracy).alias("_edges"))
    bands = []
    for i, p in enumerate(ps):
        low, high, weight = _positions(p, F.col("n"), kind)
        # A small group is its own band; in a large one the spread covers the sketch error and both neighbours.
        small = F.col("n") <= accuracy
        lo = F.col("_min") if p - spread <= 0 else F.when(small, F.col("_min")).otherwise(F.col("_edges")[i])
        hi = F.col("_max") if p + spread >= 1 else F.when(small, F.col("_max")).otherwise(F.col("_edges")[len(ps) + i])
        bands.append(F.struct(F.lit(p).alias("p"), lo.alias("lo"), hi.alias("hi"), low.alias("low"),
                              high.alias("high"), weight.cast("double").alias("weight")))
    # One row per group, stored: with few groups the planner sifts the rows where they are, without a shuffle.
    wanted = pin(stats.select(*by, F.array(*bands).alias("_bands")))
    banded = cells.join(wanted, by).withColumn("_band", F.explode("_bands"))
    band = F.struct(*[F.col(f"_band.{f}").alias(f) for f in ("p", "low", "high", "weight")]).alias("_at")
    # Everything below the band collapses to one counter per group; rows above it are left out.
    counted = (banded.where(F.col("value") <= F.col("_band.hi"))
               .select(*by, band, F.when(F.col("value") >= F.col("_band.lo"), F.col("value")).alias("value"))
               .groupBy(*by, "_at", "value").agg(F.count(F.lit(1)).alias("rows")))
    run = Window.partitionBy(*by, "_at").orderBy(F.col("value").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("rows").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("_upto") - F.col("rows")
    holds = lambda at: (first <= at) & (at < F.col("_upto"))
    picked = ranked.groupBy(*by, "_at").agg(
        F.max(F.when(holds(F.col("_at.low")), F.col("value"))).alias("_low"),
        F.max(F.when(holds(F.col("_at.high")), F.col("value"))).alias("_high"))
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_at.weight")
    return picked.select(*by, F.col("_at.p").alias("p"), value.alias("value"))


def percentile_name(column: str, p: float) -> str:
    return f"{column}_p{p * 100:g}".replace(".", "_")


def percentile_columns(df: DataFrame, keys: list[str], columns: list[str], ps: list[float],
                       kind: str = "linear") -> DataFrame:
    """``exact_percentiles`` with one column per (column, p)."""
    long = exact_percentiles(df, keys, columns, ps, kind)
    aggs = [F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("value"))).alias(percentile_name(c, p))
            for c in columns for p in ps]
    return long.groupBy(*keys).agg(*aggs)


def latency_percentiles(df: DataFrame, keys: list[str], columns: list[str], ps: list[float],
                        mean_of: str) -> DataFrame:
    means = df.groupBy(*keys).agg(F.avg(mean_of).alias(f"{mean_of}_mean"))
    return percentile_columns(df, keys, columns, ps).join(means, keys)


def approx_latency_percentiles(df: DataFrame, keys: list[str], columns: list[str], ps: list[float],
                               accuracy: int = PERCENTILE_ACCURACY) -> DataFrame:
    sketched = df.groupBy(*keys).agg(*[F.percentile_approx(c, ps, accuracy).alias(f"_{c}") for c in columns])
    return sketched.select(*keys, *[F.col(f"_{c}")[i].alias(percentile_name(c, p))
                                    for c in columns for i, p in enumerate(ps)])


def nearest_rank_percentile(df: DataFrame, keys: list[str], column: str, ps: list[float]) -> DataFrame:
    return percentile_columns(df, keys, [column], ps, "nearest")


def spill_flags(df: DataFrame, keys: list[str], hit: str, read: str, threshold: float = 1.0) -> DataFrame:
    """Means to two digits; the flag compares the rounded mean."""
    return df.groupBy(*keys).agg(
        F.round(F.avg(hit), 2).alias("mean_hit"), F.round(F.avg(read), 2).alias("mean_read"),
        F.round(F.max(read), 2).alias("max_read"), (F.round(F.avg(read), 2) > threshold).alias("spilled"))


def load_test_summary(df: DataFrame, ok: Column, elapsed: str, duration_s: Column) -> DataFrame:
    """One row: counts, success rate, requests per second and latency percentiles of the successes."""
    marked = df.withColumn("_ok", ok)
    counts = marked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("successes"),
        F.count_if(~F.col("_ok")).alias("failures"), F.max(F.when(F.col("_ok"), F.col(elapsed))).alias("max"),
        duration_s.alias("duration_s"))
    ps = exact_percentiles(marked.where("_ok"), [], [elapsed], [0.5, 0.9, 0.95, 0.99], "nearest")
    wide = ps.agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
                    for p, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))])
    point = wide.select(F.struct("*")).scalar()
    return counts.withColumn("_p", point).select(
        "total", "successes", "failures",
        F.try_divide(F.col("successes"), F.col("total")).alias("success_rate"),
        F.when(F.col("duration_s") > 0, F.col("total") / F.col("duration_s")).otherwise(F.lit(float("inf")))
        .alias("requests_per_s"), "_p.p50", "_p.p90", "_p.p95", "_p.p99", "max")


def corpus_profile(df: DataFrame, type_col: str, text: str, entity_count: Column) -> DataFrame:
    chars = F.char_length(text)
    return df.agg(
        F.count(F.lit(1)).alias("docs"), F.count_distinct(type_col).alias("types"), F.avg(chars).alias("mean_chars"),
        F.sum(entity_count).alias("entities"), F.avg(entity_count).alias("mean_entities"))


def approx_distinct_profile(df: DataFrame, columns: list[str], rsd: float = 0.01) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("docs"),
                  *[F.approx_count_distinct(c, rsd).alias(f"distinct_{c}") for c in columns])


def length_histogram(df: DataFrame, text: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the shortest and the longest text; the last bin is closed."""
    lengths = df.select(F.char_length(text).cast("double").alias("chars"))
    ends = lengths.agg(F.struct(F.min("chars").alias("lo"), F.max("chars").alias("hi"))).scalar()
    width = (F.col("_ends.hi") - F.col("_ends.lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("chars") - F.col("_ends.lo")) / width) + 1, F.lit(bins)))
    found = lengths.withColumn("_ends", ends).groupBy(F.coalesce(at, F.lit(1)).alias("bin"), "_ends").agg(
        F.count(F.lit(1)).alias("n"))
    return found.select("bin", (F.col("_ends.lo") + width * (F.col("bin") - 1)).alias("lo"),
                        (F.col("_ends.lo") + width * F.col("bin")).alias("hi"), "n")


def mean_summary(df: DataFrame, columns: list[str], wall_s: Column) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], F.count(F.lit(1)).alias("docs"),
                  wall_s.alias("wall_s")).withColumn("docs_per_s", F.try_divide(F.col("docs"), F.col("wall_s")))


def unpivot_fields(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return df.select(*ids, F.explode(pairs).alias("_p")).select(*ids, "_p.field", "_p.value")


def per_field_means(wide: DataFrame, fields: list[str], a: str, b: str) -> DataFrame:
    """Mean of ``<field><a>`` and ``<field><b>`` per field, with the difference, worst first."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f + a).alias("x"), F.col(f + b).alias("y"))
                      for f in fields])
    long = wide.select(F.explode(pairs).alias("_p")).select("_p.*")
    means = long.groupBy("field").agg(F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"))
    return means.withColumn("delta", F.col("mean_b") - F.col("mean_a")).orderBy("delta", "field")


def typed_agg(long: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """(name, bool_value, num_value, str_value) rows to one value per name.

    Booleans give the pass rate, numbers the mean, text that holds numbers the mean of those, other
    text its most frequent value (smallest of equals). The result is text in every case.
    """
    by = [*(by or []), "name"]
    number = F.coalesce(F.col("bool_value").cast("double"), F.col("num_value"),
                        F.when(F.col("str_value").rlike(NUMBER), F.expr("try_cast(str_value as double)")))
    # By value first: a frequent value is one row per task before the shuffle.
    values = long.groupBy(*by, "str_value").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(number).alias("_sum"), F.count(number).alias("_numbers"))
    commonest = F.min(F.when(F.col("str_value").isNotNull(), F.struct((-F.col("_n")).alias("n"), "str_value")))
    found = values.groupBy(*by).agg(F.try_divide(F.sum("_sum"), F.sum("_numbers")).alias("_mean"), commonest.alias("_mode"))
    rounded = F.format_string(f"%.{digits}f", F.round("_mean", digits))
    value = F.when(F.col("_mean").isNotNull(), rounded).otherwise(F.col("_mode.str_value"))
    return found.select(*by, value.alias("value")).where(F.col("value").isNotNull())


def version_compare(aggregates: DataFrame, versions: list[str], digits: int = 4) -> DataFrame:
    """One row per name, one column per version, and the last minus the first where both are numbers."""
    wide = aggregates.groupBy("name").agg(
        *[F.max(F.when(F.col("version") == v, F.col("value"))).alias(v) for v in versions])
    number = lambda v: F.expr(f"try_cast(`{v}` as double)")
    return wide.withColumn("delta", F.round(number(versions[-1]) - number(versions[0]), digits))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def micro_macro_prf(scores: DataFrame) -> DataFrame:
    """Pooled and document-averaged precision, recall and F1 from (tp, fp, fn, precision, recall, f1)."""
    return with_micro(scores.agg(*prf_sums()))


def prf_sums() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
            *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]]


def with_micro(sums: DataFrame) -> DataFrame:
    micro = sums.withColumn("micro_precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "micro_recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("micro_precision"), F.col("micro_recall")
    return micro.withColumn("micro_f1", ratio(2 * p * r, p + r))


def parse_sums() -> list[Column]:
    return [F.count_if("parse_ok").alias("ok"), F.count(F.lit(1)).alias("total"),
            F.count_if(~F.col("parse_ok")).alias("errors"), F.sum("num_entities").alias("detected"),
            F.sum("gt_count").alias("truth")]


def parse_success(results: DataFrame) -> DataFrame:
    return results.agg(*parse_sums())


def batch_profile(df: DataFrame, order: list[Column], size: int, tokens: Column, seconds: Column,
                  memory: Column) -> DataFrame:
    """Consecutive batches of ``size`` rows, numbered from 0, with their token, time and memory figures."""
    narrow = df.select(*order, tokens.alias("_tokens"), seconds.alias("_secs"), memory.alias("_mem"))
    numbered = global_running(narrow, order, row_number="_row")
    batches = numbered.groupBy(F.floor((F.col("_row") - 1) / size).alias("batch")).agg(
        F.count(F.lit(1)).alias("docs"), F.max("_row").alias("docs_cumulative"), F.sum("_tokens").alias("tokens"),
        F.sum("_secs").alias("wall_s"),
        F.min_by("_mem", "_row").alias("mem_start"), F.max_by("_mem", "_row").alias("mem_end"))
    return batches.withColumn("tokens_per_s", ratio(F.col("tokens"), F.col("wall_s"))).withColumn(
        "mem_delta", F.col("mem_end") - F.col("mem_start"))


def cumulative_docs(profiles: DataFrame) -> DataFrame:
    """Running documents and tokens over the batches, for any number of batches."""
    return global_running(profiles.select("batch", "docs", "tokens"), [F.col("batch")],
                          {"docs_running": F.col("docs"), "tokens_running": F.col("tokens")})


def drift_first_last(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        (F.max_by("mem_end", "batch") - F.min_by("mem_start", "batch")).alias("drift"),
        F.avg("mem_end").alias("mean_mem"), F.max("mem_end").alias("peak_mem"))


def agreement_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """Accuracy difference and throughput ratio of two summaries.

    A missing accuracy or upper throughput counts as 0, a missing lower throughput as 1.
    """
    pick = lambda df, c: df.select(c).scalar()
    sides = a.sparkSession.range(1).select(
        *[F.coalesce(pick(df, c), F.lit(0.0)).alias(f"{c}_{side}")
          for side, df in (("a", a), ("b", b)) for c in ("accuracy", "docs_per_s")])
    base = F.when(F.col("docs_per_s_a") == 0, F.lit(1.0)).otherwise(F.col("docs_per_s_a"))
    return sides.select((F.col("accuracy_b") - F.col("accuracy_a")).alias("accuracy_delta"),
                        (F.col("docs_per_s_b") / base).alias("throughput_ratio"))


def usage_cube(df: DataFrame, dims: list[str], quantity: str) -> DataFrame:
    return df.cube(*dims).agg(F.sum(quantity).alias("total"), F.count(F.lit(1)).alias("rows"),
                              F.grouping_id().cast("int").alias("grouping_id"))
