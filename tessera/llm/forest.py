"""Approximate nearest neighbours: a forest of random-projection trees, one queue for all trees, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.session import pin

#: Rows and queries of one leaf that meet in one task.
LEAF_ROWS, LEAF_QUERIES = 8192, 4096


@dataclass
class Forest:
    """Complete binary trees; node n of tree t has the plane ``planes[t, n]`` and the offset ``cuts[t, n]``, leaves follow the last level."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """(row, tree) leaf numbers."""
        out = np.empty((len(rows), len(self.planes)), np.int32)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.einsum("ij,ij->i", rows, planes[node]) > cuts[node])
            out[:, t] = node - (1 << self.depth)
        return out

    def search(self, query: np.ndarray, sizes: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue for all trees, nearest planes first, until the leaves hold ``share`` of the rows.

        ``sizes`` is each leaf's share of the rows; trees count as independent for the share of their union.
        """
        margins = self.planes @ query - self.cuts
        first = 1 << self.depth
        queue, out, left = [(0.0, t, 1) for t in range(len(self.planes))], [], np.ones(len(self.planes))
        while queue and 1 - left.prod() < share:
            gap, t, n = heapq.heappop(queue)
            while n < first:
                m = margins[t, n]
                heapq.heappush(queue, (max(gap, abs(m)), t, 2 * n + (m <= 0)))
                n = 2 * n + (m > 0)
            out.append((t, n - first))
            left[t] = max(0.0, left[t] - sizes[t, n - first])
        return out


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 0) -> Forest:
    """Planes between two random points of a node's sample, cut at the median, so leaves hold even parts of the sample."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    planes, cuts = np.zeros((trees, 1 << depth, dim)), np.zeros((trees, 1 << depth))
    for t in range(trees):
        node = np.ones(len(sample), np.int64)
        for n in range(1, 1 << depth):
            own = np.flatnonzero(node == n)
            plane = np.zeros(dim)
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                plane = a - b
            if not np.linalg.norm(plane):
                plane = rng.standard_normal(dim)
            plane /= np.linalg.norm(plane)
            away = sample[own] @ plane
            planes[t, n], cuts[t, n] = plane, np.median(away) if len(own) else 0.0
            node[own] = 2 * n + (away > cuts[t, n])
    return Forest(planes, cuts, depth)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


def nearest_neighbours(table: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, trees: int = 16,
                       depth: int = 6, share: float = 0.6, sample_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` its ``k`` nearest other rows found, by inner product.

    Equal vectors are indexed once with their ``k + 1`` smallest ids, which are all that a result can name, so a vector that a third of all rows
    share is one entry. The trees are fitted on ``sample_rows`` rows at most (smallest id hashes); every row is indexed, once per tree.
    A query takes leaves from one priority queue over all trees until they hold about ``share`` of the rows; queries and rows
    of a leaf meet in blocks of bounded size, and only the ``k`` best per block go on, of all that are not below the block's ``k + 1``-th
    best product less its rounding, so ties are whole. Scores are exact products of the
    original vectors in double precision; ties go to the smaller id.

    Vectors that are null or zero or hold null or non-finite components take no part, nor do rows without an id. Vectors meet only vectors of their
    own length; each length has trees of its own. If an id repeats, each of its vectors counts and the best score stays. An empty table gives an
    empty result; with fewer than ``k`` candidates a query has fewer rows.
    """
    spark = table.sparkSession
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("ask"))
    rows = pin(rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists("vec", lambda x: x != 0)))
    # one number per different length
    found = [_of_length(rows.where(F.size("vec") == r["n"]), r["n"], k, trees, depth, share, sample_rows) for r in rows.select(F.size("vec").alias("n")).distinct().collect()]
    found = reduce(DataFrame.unionByName, found, spark.createDataFrame([], "query_id bigint, vec_id bigint, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, dim: int, k: int, trees: int, depth: int, share: float, sample_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best rows per query, leaf and block, among rows (id, vec, ask) whose vectors have ``dim`` components."""
    spark = rows.sparkSession
    got = rows.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample_rows)
    sample = np.array([r["vec"] for r in got.toLocalIterator()])
    forest = fit_forest(sample, trees, max(0, min(depth, int(np.log2(max(1, len(sample) / 8))))))
    sent, leaves = spark.sparkContext.broadcast(forest), 1 << forest.depth
    ranked = rows.select("id", "vec").distinct().withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = ranked.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = sent.value.leaves(_matrix(batch.column("vec"), dim))
                yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("vec"), _lists(places)], names=["ids", "vec", "leaves"])

    index = pin(classes.select("ids", "vec").mapInArrow(routed, "ids array<bigint>, vec array<double>, leaves array<int>"))
    placed = index.select("ids", "vec", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, leaves))
    for r in placed.groupBy("tree", "leaf").count().collect():
        sizes[r["tree"], r["leaf"]] = r["count"]
    blocks = np.ceil(sizes / LEAF_ROWS).astype(int).clip(1)
    asked = rows.where("ask").select("id", "vec").distinct()
    parts = max(1, -(-asked.count() // LEAF_QUERIES))
    stats = spark.sparkContext.broadcast((sizes / max(1, sizes[0].sum()), blocks))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, blocks = stats.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                out = []
                for i, vec in enumerate(_matrix(piece.column("vec"), dim)):
                    out += [(i, t, n, b) for t, n in sent.value.search(vec, sizes, share) for b in range(blocks[t, n])]
                if out:
                    at_row, tree, leaf, block = (pa.array(np.array(x, np.int32)) for x in zip(*out))
                    picked = piece.take(at_row)
                    yield pa.RecordBatch.from_arrays([picked.column("id"), picked.column("vec"), tree, leaf, block], names=["id", "vec", "tree", "leaf", "block"])

    kind = "id bigint, vec array<double>, tree int, leaf int, block int"
    questions = asked.mapInArrow(probes, kind).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    count = F.element_at(F.array(*[F.lit(int(x)) for x in blocks.ravel()]), F.col("tree") * leaves + F.col("leaf") + 1)
    stored = placed.withColumn("block", F.pmod(F.xxhash64("ids"), count).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["tree", "leaf", "block", "part"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ask, have = (_matrix(t.column("vec").combine_chunks(), dim) for t in (left, right))
            ids = left.column("id").to_pylist()
            most, flat = min(len(have), k + 1), right.column("ids").combine_chunks()
            named, first, longest = flat.flatten().to_numpy(), flat.value_lengths().to_numpy().cumsum(), np.linalg.norm(have, axis=1).max()
            first = np.concatenate([[0], first])
            for at in range(0, len(ask), 512):
                near = ask[at:at + 512] @ have.T
                least = np.partition(near, len(have) - most, axis=1)[:, len(have) - most]
                slack = 4 * dim * np.finfo(float).eps * longest * np.linalg.norm(ask[at:at + 512], axis=1)
                for i, row in enumerate(near):
                    own, chosen = ids[at + i], np.flatnonzero(row >= least[i] - slack[i])
                    scores = np.einsum("ij,j->i", have[chosen], ask[at + i])
                    sizes = first[chosen + 1] - first[chosen]
                    found = named[np.repeat(first[chosen + 1] - sizes.cumsum(), sizes) + np.arange(sizes.sum())]
                    scores = np.repeat(scores, sizes)
                    other = found != own
                    found, scores = found[other], scores[other]
                    order = np.lexsort((found, -scores))[:k]
                    out[0] += [own] * len(order)
                    out[1] += found[order].tolist()
                    out[2] += scores[order].tolist()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    return (questions.groupBy(*keys).cogroup(stored.groupBy(*keys))
            .applyInArrow(meet, "query_id bigint, vec_id bigint, score double"))
