"""Repeated runs of lines, by prefix doubling over line ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import pin


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once, with ``first``, the earliest position (id, row, line) that has the keys.

    This names the interval of the suffix array that shares the prefix; a prefix that occurs once needs no name, as nothing
    longer can repeat there. The names are written first, so that the join can split a line that a third of all rows have.
    """
    groups = (rows.groupBy(*keys).agg(F.min(F.struct("id", "row", "line")).alias("first"), F.count(F.lit(1)).alias("_n"))
              .where("_n > 1").drop("_n"))
    return rows.join(pin(groups), keys)


def _stretches(starts: DataFrame, width: int) -> DataFrame:
    """(row, line): the lines of the runs of ``width`` lines that begin at ``starts``; starts that follow each other are taken together first."""
    by_row = Window.partitionBy("row").orderBy("line")
    marked = starts.select("row", "line", (F.col("line") - F.row_number().over(by_row)).alias("_k"))
    spans = marked.groupBy("row", "_k").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    return spans.select("row", F.explode(F.sequence("a", F.col("b") + (width - 1))).alias("line"))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, row_col: str, min_lines: int = 2, long_line: int = 60, min_chars: int = 0) -> DataFrame:
    """(row, line): lines of later copies. ``row_col`` must tell rows apart; earlier is by (id, row, line), a null id first.

    A run of lines is looked at in stretches of ``min_lines``, twice, four times as many lines and so on. A stretch that also begins at an earlier position and has
    at least ``min_chars`` characters belongs to a later copy; so does a single line of at least ``long_line`` characters that occurs
    earlier. So a few short lines that many documents share stay, unless they are part of a repeated stretch with enough text.

    Doubling: the starts that share their next h lines form one interval of the suffix array, named by its earliest position. Pairs of names
    h lines apart name the intervals of the next depth. It goes on until no interval is left, or until all that are left have enough text, when
    longer ones would only join what is found. Counts are combined before each shuffle; only lines that repeat go on.
    """
    part = F.split(text_col, "\n", -1)
    cut = docs.select(F.col(id_col).alias("id"), F.col(row_col).alias("row"),
                      F.transform(part, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.length(x).cast("bigint").alias("n"))).alias("cut"))
    lines = pin(cut.select("id", "row", F.posexplode("cut").alias("line", "x")).select("id", "row", "line", "x.h", "x.g", "x.n"))
    ranks = pin(_named(lines, ["h", "g"]).select("id", "row", "line", "n", "first"))
    later = ~F.col("first").eqNullSafe(F.struct("id", "row", "line"))
    gone = [ranks.where(later & (F.col("n") >= long_line)).select("row", "line")]
    depth = 1

    def deeper(ranks: DataFrame, step: int) -> DataFrame:
        ahead = ranks.select("row", (F.col("line") - step).alias("line"), F.col("first").alias("second"), F.col("n").alias("_n2"))
        pairs = ranks.join(ahead, ["row", "line"])
        if depth + step < 2 * depth:
            # the two parts overlap: the text is that of the whole lines of both ends
            own = lines.select("row", "line", F.sum("n").over(Window.partitionBy("row").orderBy("line").rowsBetween(0, depth + step - 1)).alias("_n3"))
            pairs = pairs.join(own, ["row", "line"]).withColumn("_n", F.col("_n3"))
        else:
            pairs = pairs.withColumn("_n", F.col("n") + F.col("_n2"))
        pairs = pairs.select("id", "row", "line", F.col("first").alias("a"), F.col("second").alias("b"), F.col("_n").alias("n"))
        return pin(_named(pairs, ["a", "b"]).select("id", "row", "line", "n", "first"))

    while depth < min_lines:
        step = min(depth, min_lines - depth)
        ranks, depth = deeper(ranks, step), depth + step
    while True:
        gone.append(_stretches(ranks.where(later & (F.col("n") >= min_chars)), depth))
        if ranks.where(F.col("n") < min_chars).isEmpty():
            break
        ranks, depth = deeper(ranks, depth), 2 * depth
    return reduce(DataFrame.unionByName, gone).distinct()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, min_lines: int = 2,
                        long_line: int = 60, min_chars: int = 0) -> DataFrame:
    """(id, text, n_lines, n_removed, longest_run) per row: the text without the lines of later copies (``repeated_lines``).

    ``row_col`` names a column that tells rows apart; without one, the rows are numbered in a written copy. ``longest_run`` is the
    longest stretch of removed lines. Lines end at line feeds. A null text stays null with no lines; an empty one
    has one empty line. Of repeated rows the first keeps its lines. Other columns are ignored. Very long lines and texts with very many lines are
    taken whole: a row's lines meet in one task, a line that many rows share does not. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    if not row_col:
        rows = pin(rows)
    gone = (repeated_lines(rows, "id", "text", "row", min_lines, long_line, min_chars).groupBy("row")
            .agg(F.array_sort(F.collect_list("line")).alias("gone")))
    run = F.struct(F.lit(-2).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(state, line):
        n = F.when(line == state["at"] + 1, state["n"] + 1).otherwise(1)
        return F.struct(line.alias("at"), n.alias("n"), F.greatest(state["best"], n).alias("best"))

    joined = rows.join(gone, "row", "left").withColumn("parts", F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(F.col("parts"), i + 1)), "\n"))
    return joined.select(F.col("id").alias(id_col), text.alias(text_col), F.coalesce(F.when(F.col("text").isNotNull(), F.size("parts")), F.lit(0)).cast("bigint").alias("n_lines"),
                         F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("bigint").alias("n_removed"),
                         F.coalesce(F.aggregate("gone", run, step, lambda s: s["best"]), F.lit(0)).cast("bigint").alias("longest_run"))
