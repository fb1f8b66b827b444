"""Order, top-k, numbering and sampling.

Nothing here sorts a whole table in one task: top-k per group goes through Spark's window group
limit, and numbering over the whole table is split over range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import pin


def order_limit(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def take_matching(df: DataFrame, condition: Column, n: int, order_by: list[Column]) -> DataFrame:
    return order_limit(df.where(condition), order_by, n)


def topk_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group. ``order`` must end in a unique column."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return topk_per_group(df, [key], order, 1, "_newest").drop("_newest")


class _Running:
    """A running sum or maximum over Arrow batches; a null adds nothing."""

    def __init__(self, add: bool) -> None:
        self.add, self.last = add, None

    def push(self, column: pa.Array) -> pa.Array:
        kind, cells = column.type, column
        if pa.types.is_temporal(kind):
            cells = cells.cast(pa.int64() if kind.bit_width == 64 else pa.int32()).cast(pa.int64())
        if self.last is not None:
            cells = pa.concat_arrays([pa.array([self.last], cells.type), cells])
        if pa.types.is_integer(cells.type) or pa.types.is_floating(cells.type):
            run = (pc.cumulative_sum if self.add else pc.cumulative_max)(cells, skip_nulls=True)
            run = pc.fill_null_forward(run)
        else:
            def step(a, b):
                return a if b is None else b if a is None else a + b if self.add else max(a, b)
            run = pa.array(accumulate(cells.to_pylist(), step), cells.type)
        run = run.slice(1) if self.last is not None else run
        if len(run):
            self.last = run[-1].as_py()
        return run.cast(pa.int64() if kind.bit_width == 64 else pa.int32()).cast(kind) if pa.types.is_temporal(kind) else run


def global_running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None,
                   row_number: str | None = None, maxes: dict[str, Column] | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Row number, running sums and running maxima over the whole table in the given total order.

    One exchange: rows go to ranges of the order, are sorted there, get the running values of their range in one pass, and
    are written. Then the totals of the ranges (one row per range) are carried over. Ranges come from a sample, so a value that many rows
    share does not swell one as long as the order is total; without ``partitions`` their number follows the size of the rows. Pass narrow rows:
    they are written once. Sums of integers are bigint; nulls add nothing.
    """
    work = {name: (c, True) for name, c in (sums or {}).items()}
    work.update({name: (c, False) for name, c in (maxes or {}).items()})
    if row_number:
        work[row_number] = (F.lit(1).cast("bigint"), True)
    cells = df.select("*", *[c.alias(f"_in_{name}") for name, (c, _) in work.items()])
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = {name: kind if not add or kind not in {*whole, "float"} else "bigint" if kind in whole else "double"
             for name, (_, add) in work.items() for kind in [cells.schema[f"_in_{name}"].dataType.simpleString()]}
    cells = cells.select(*df.columns, *[F.col(f"_in_{name}").cast(kind).alias(f"_in_{name}") for name, kind in kinds.items()])
    ranged = (cells.repartitionByRange(partitions, *order) if partitions else cells.repartitionByRange(*order)).sortWithinPartitions(*order)
    adds = {name: add for name, (_, add) in work.items()}
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, at, part = {name: _Running(add) for name, add in adds.items()}, 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.num_rows
            values = [states[name].push(b.column(b.schema.get_field_index(f"_in_{name}"))) for name in adds]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *values, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
                                             names=[*keep, *[f"_run_{name}" for name in adds], "_range", "_at"])
            at += n

    fields = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"`_run_{name}` {kind}" for name, kind in kinds.items()], "_range int", "_at bigint"]
    done = pin(ranged.mapInArrow(run, ", ".join(fields)))
    totals = done.groupBy("_range").agg(*[F.max_by(f"_run_{name}", "_at").alias(f"_all_{name}") for name in adds])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[(F.sum if add else F.max)(f"_all_{name}").over(before).alias(f"_off_{name}") for name, add in adds.items()])
    # One row per range, so the size of the broadcast is the number of partitions.
    joined = done.join(F.broadcast(offsets), "_range")

    def carried(name: str, add: bool) -> Column:
        local, off = F.col(f"_run_{name}"), F.col(f"_off_{name}")
        return F.coalesce(local + F.coalesce(off, F.lit(0)), off) if add else F.greatest(local, off)

    return joined.select(*keep, *[carried(name, add).cast(kinds[name]).alias(name) for name, add in adds.items()])


def min_length_filter(df: DataFrame, text: str, n: int, id_col: str, header: str | None = None) -> DataFrame:
    """Passages longer than ``n`` characters, without the first of them, with a non-empty header."""
    long = df.where(F.char_length(text) > n)
    first = long.agg(F.min(id_col)).scalar()
    kept = long.where(F.col(id_col) > first)
    return kept.where(F.col(header) != "") if header else kept


def range_holdout(df: DataFrame, id_col: str, cutoff: Column | int, n: int) -> DataFrame:
    return df.where(F.col(id_col) >= cutoff).orderBy(id_col).limit(n)


def scale_subset(df: DataFrame, id_col: str, n: int) -> DataFrame:
    return df.orderBy(id_col).limit(n)


def scale_subsets(df: DataFrame, id_col: str, scales: list[int]) -> DataFrame:
    """(scale, columns): for each of ``scales`` the first so many rows by a unique id, for load tests at growing size.

    Rows are numbered over the whole table range by range, so a scale of millions is no single task's work; all scales come from one pass.
    """
    numbered = global_running(df, [F.col(id_col)], row_number="_n").where(F.col("_n") <= max(scales))
    fits = F.filter(F.array(*map(F.lit, scales)), lambda s: s >= F.col("_n"))
    return numbered.select(F.explode(fits).alias("scale"), *df.columns)


def train_test_cut(df: DataFrame, order_by: list[Column], limit: int, fraction: float) -> DataFrame:
    """First ``limit`` rows in order; the first ``int(fraction * rows)`` of them train, the rest test."""
    top = df.orderBy(*order_by).limit(limit)
    # At most ``limit`` rows reach this window.
    numbered = top.withColumn("pos", F.row_number().over(Window.orderBy(*order_by)))
    cut = F.floor(F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(fraction))
    return numbered.withColumn("split", F.when(F.col("pos") <= cut, F.lit("train")).otherwise(F.lit("test")))


def stratified_split(df: DataFrame, label: str, id_col: str, train: int, test: int, seed: int = 1, labels: list | None = None) -> DataFrame:
    """Rows with ``split``: ``train`` rows of each label to train and ``test`` others to test, in the order of a seeded hash of the id.

    A row is in one split only. Every label of the table, and of ``labels`` if given, must have enough rows; else the job stops with their names.
    """
    order = [F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"))), F.col(id_col)]
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    short = sorted(str(x) for x in {*counts, *(labels or [])} if counts.get(x, 0) < train + test)
    if short:
        raise ValueError(f"fewer than {train + test} rows of {', '.join(short)}")
    picked = topk_per_group(df.where(F.col(label).isNotNull()), [label], order, train + test, "_rank")
    return picked.withColumn("split", F.when(F.col("_rank") <= train, "train").otherwise("test")).drop("_rank")


def stratified_sample(df: DataFrame, label: str, id_col: str, n: int, seed: int = 1, check: bool = True) -> DataFrame:
    """Exactly ``n`` rows of each label, chosen by a seeded hash of the id."""
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")))
    picked = topk_per_group(df.withColumn("_draw", draw), [label], [F.col("_draw"), F.col(id_col)], n, "draw_no")
    if check:
        short = picked.groupBy(label).count().where(F.col("count") < n).limit(5).collect()
        if short:
            raise ValueError(f"labels with fewer than {n} rows: {[r[label] for r in short]}")
    return picked.drop("_draw")


def first_failures(results: DataFrame, passed: str, id_col: str, n: int = 5) -> DataFrame:
    return results.where(~F.col(passed)).orderBy(id_col).limit(n)


def sort_by_delta(df: DataFrame, delta: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(delta).asc_nulls_last(), F.col(tie))


def section_carry_forward(parts: DataFrame, doc: str, pos: str, header: str, out: str = "section",
                          block: int = 10_000) -> DataFrame:
    """Each row takes the last header at or above it in its document.

    A document is cut in blocks of ``block`` positions; the last header of each block is carried
    over block summaries, so one very long document does not become one task.
    """
    cut = parts.withColumn("_block", F.floor(F.col(pos) / block))
    inside = Window.partitionBy(doc, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.last(header, ignorenulls=True).over(inside))
    tails = cut.where(F.col(header).isNotNull()).groupBy(doc, "_block").agg(F.max_by(header, pos).alias("_tail"))
    blocks = cut.select(doc, "_block").distinct().join(tails, [doc, "_block"], "left")
    above = Window.partitionBy(doc).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(doc, "_block", F.last("_tail", ignorenulls=True).over(above).alias("_carried"))
    joined = local.join(carried, [doc, "_block"], "left")
    return joined.withColumn(out, F.coalesce("_local", "_carried")).drop("_block", "_local", "_carried")


def day_over_day_drop(df: DataFrame, ts: str, value: str, percent: float) -> DataFrame:
    """Days on which the daily total fell by more than ``percent`` against the day before in the series."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.sum(value).alias("value"))
    # One row per calendar day.
    series = days.withColumn("prev", F.lag("value").over(Window.orderBy("day")))
    change = (F.col("value") - F.col("prev")) / F.col("prev") * 100
    return series.withColumn("change_pct", change).where(F.col("change_pct") < -percent)
