"""Connected components by repeated hooking and contraction, in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.session import pin


def _flatten(parents: DataFrame) -> DataFrame:
    """Pointer doubling until every node of (node, root) points at a root."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        parents = pin(parents.join(up, F.col("root") == F.col("_n"))
                      .select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("_moved")))
        if parents.where("_moved").isEmpty():
            return parents.drop("_moved")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node on an edge; ``root`` is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, flattens the pointers by doubling and replaces
    the edges by those between roots, so long chains take a logarithmic number of rounds. Minima are combined before
    the shuffle, so a node on a third of all edges is no special case. Rounds are written below ``spark.checkpoint.dir``.
    Edges with a null end and loops are ignored; without edges the result is empty.
    """
    left = pin(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = left.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first = True
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        parents = _flatten(pin(hooked))
        up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        if first:
            labels, first = parents, False
        else:
            labels = pin(labels.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))
        down = up.select(F.col("_n").alias("_m"), F.col("_r").alias("_s"))
        left = pin(left.join(up, F.col("a") == F.col("_n")).join(down, F.col("b") == F.col("_m"))
                   .select(F.col("_r").alias("a"), F.col("_s").alias("b")).where("a <> b").distinct())
    return labels
