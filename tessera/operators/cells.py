"""A stored vector index of cells with product-quantised residuals, and its search.

``build_cells`` trains a codebook over all rows and writes each row to the cell of its nearest centre, with the code of what the centre leaves
over and the error that the code makes. ``cells_topk`` reads only cells that matter: for a unit query q, a row x of a cell with centre c
scores at most q.c + |x - c|, and at most the score of its code plus the error of the code. So a search can stop when both bounds say that
the k best are known (``share`` None), or after a given share of the rows.

Scores are cosines; a null or zero vector scores 0 with everything. Keys may be of any type that can be sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import RANK_DIGITS, matrix, unit_rows
from tessera.operators.ranking import topk_per_group
from tessera.session import pin

#: Most cells: their centres are sent to every task.
MOST_CELLS = 4096
#: Rows and queries of a task that meets queries with a cell.
GROUP_ROWS, GROUP_QUERIES = 20_000, 2_000
#: Cells whose file reader gets a list.
LISTED_CELLS = 1000
#: Scores that a task has at once.
TILE = 1_000_000
#: Rounding of bounds.
SLACK = 1e-9

SUMS = "g int, n bigint, total array<double>"


def _mean_round(rows: DataFrame, vector: str, dim: int, assign: Callable[[np.ndarray], list[tuple[np.ndarray, np.ndarray]]], groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, mean) of each group of parts of vectors, in one pass; a task hands out one row per group that it has seen."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(groups, np.int64), np.zeros((groups, width))
        for batch in batches:
            if batch.num_rows:
                for group, part in assign(unit_rows(matrix(batch.column(vector), dim))):
                    n += np.bincount(group, minlength=groups)
                    np.add.at(total, group, part)
        seen = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(np.arange(0, len(seen) * width + 1, width, dtype=np.int32), pa.array(total[seen].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen]), lists], names=["g", "n", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = matrix(table.column("total")).sum(axis=0)
        return pa.table({"g": table.column("g").slice(0, 1), "n": [sum(table.column("n").to_pylist())], "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    # at most ``groups`` rows: the codebook, whose size is a parameter
    found = rows.select(vector).mapInArrow(work, SUMS).groupBy("g").applyInArrow(add, SUMS).toArrow()
    n, mean = np.zeros(groups, np.int64), np.zeros((groups, width))
    if found.num_rows:
        at = found.column("g").to_numpy()
        n[at] = found.column("n").to_numpy()
        mean[at] = np.round(matrix(found.column("total")) / n[at][:, None], 9)
    return n, mean


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, in tiles of about ``TILE`` scores: the number of centres grows with the table."""
    half, step = 0.5 * (centres * centres).sum(axis=1), max(1, TILE // max(1, len(centres)))
    return np.concatenate([np.argmax(rows[at:at + step] @ centres.T - half, axis=1) for at in range(0, max(len(rows), 1), step)])


@dataclass(frozen=True)
class CellIndex:
    """The stored tables: ``rows`` (cell, key, vector, codes, err), ``cells`` (cell, n, reach, centre), ``books`` (part, code, centre)."""

    spark: SparkSession
    path: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of each cell, greatest distance from its centre, centres); at most ``MOST_CELLS``."""
        t = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").toArrow()
        return t.column("n").to_numpy(), t.column("reach").to_numpy(), matrix(t.column("centre"))

    @cached_property
    def books(self) -> np.ndarray:
        """(parts, codes, width) of the residuals' codebooks."""
        t = self.spark.read.parquet(f"{self.path}/books").orderBy("part", "code").toArrow()
        parts = max(t.column("part").to_pylist(), default=-1) + 1
        return matrix(t.column("centre")).reshape(parts, -1 if parts else 0, len(t.column("centre")[0]) if parts else 0)


def build_cells(corpus: DataFrame, key: str, vector: str, path: str, cells: int | None = None, parts: int = 16, codes: int = 64, rounds: int = 5) -> CellIndex:
    """Trains the codebooks over all rows and writes the index below ``path``.

    About the square root of the number of rows makes the cells, ``MOST_CELLS`` at most. Vectors must have one length. The first centres are rows in
    the order of a hash of the key, so the same table gives the same index. ``parts`` is lowered to a divisor of the length.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    count, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dim = max(dim or 1, 1)
    size = max(1, min(cells or round(math.sqrt(count)), MOST_CELLS, max(count, 1)))
    first = rows.where(F.col("vector").isNotNull()).orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(max(size, codes)).select("vector").toArrow()
    seeds = unit_rows(matrix(first.column("vector"), dim)) if first.num_rows else np.zeros((1, dim))
    centres = seeds[:size]
    for _ in range(rounds):
        n, mean = _mean_round(rows, "vector", dim, lambda x, c=centres: [(_nearest(x, c), x)], len(centres), dim)
        centres = np.where(n[:, None] > 0, mean, centres)
    parts = next(p for p in range(min(parts, max(dim, 1)), 0, -1) if dim % p == 0)
    width = dim // parts
    left = seeds[:codes] - centres[_nearest(seeds[:codes], centres)]
    books = np.stack([left[:, p * width:(p + 1) * width] for p in range(parts)])

    def residuals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, c)
        return cell, x - c[cell]

    def encode(left: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(left[:, p * width:(p + 1) * width], b[p]) for p in range(parts)], axis=1)

    for _ in range(rounds):
        def assign(x: np.ndarray, c: np.ndarray = centres, b: np.ndarray = books) -> list[tuple[np.ndarray, np.ndarray]]:
            _, left = residuals(x, c)
            own = encode(left, b)
            return [(p * b.shape[1] + own[:, p], left[:, p * width:(p + 1) * width]) for p in range(parts)]

        n, mean = _mean_round(rows, "vector", dim, assign, parts * books.shape[1], width)
        books = np.where(n[:, None] > 0, mean, books.reshape(-1, width)).reshape(books.shape)

    sent = spark.sparkContext.broadcast((centres, books))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, b = sent.value
        for batch in batches:
            x = unit_rows(matrix(batch.column("vector"), dim))
            cell, left = residuals(x, c)
            own = encode(left, b)
            made = np.concatenate([b[p][own[:, p]] for p in range(parts)], axis=1)
            coded = pa.array([r.tobytes() for r in own.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("key"), batch.column("vector"), coded,
                                              pa.array(np.sqrt(((left - made) ** 2).sum(axis=1))), pa.array(np.sqrt((left ** 2).sum(axis=1)))],
                                             names=["cell", "key", "vector", "codes", "err", "reach"])

    placed = rows.mapInArrow(place, f"cell int, key {kinds['key']}, vector {kinds['vector']}, codes binary, err double, reach double")
    # a large cell goes to several tasks
    placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("cell").write.parquet(f"{path}/rows")
    seen = {r["cell"]: r for r in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()}
    spark.createDataFrame([(i, seen[i]["n"] if i in seen else 0, seen[i]["reach"] if i in seen else 0.0, c.tolist()) for i, c in enumerate(centres)],
                          "cell int, n bigint, reach double, centre array<double>").write.parquet(f"{path}/cells")
    spark.createDataFrame([(p, i, b.tolist()) for p, own in enumerate(books) for i, b in enumerate(own)],
                          "part int, code int, centre array<double>").write.parquet(f"{path}/books")
    return CellIndex(spark, path)


def _probe(index: CellIndex, queries: DataFrame, choose: Callable) -> DataFrame:
    """(query_id, vector, floor, cell): the cells that ``choose(scores, bounds, floors)`` marks for each query."""
    sent = index.spark.sparkContext.broadcast(index.cells)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, reach, centres = sent.value
        for batch in batches:
            step = max(1, min(256, TILE // max(1, 4 * len(centres))))
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                q = unit_rows(matrix(b.column("vector"), centres.shape[1]))
                scores = q @ centres.T
                bounds = scores + np.sqrt((q * q).sum(axis=1, keepdims=True)) * reach
                row, cell = np.nonzero(choose(scores, bounds, b.column("floor").to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(row)) for c in ("query_id", "vector", "floor")] + [pa.array(cell.astype(np.int32))],
                                                 names=["query_id", "vector", "floor", "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    return queries.select("query_id", "vector", "floor").mapInArrow(work, f"query_id {kinds['query_id']}, vector {kinds['vector']}, floor double, cell int")


def _meet(index: CellIndex, probes: DataFrame, kernel: Callable, ddl: str, columns: list[str]) -> DataFrame:
    """Cells and the queries that need them, group by group of bounded size; large cells and much-asked ones are many groups."""
    counts, _, _ = index.cells
    asked = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most one row per cell
    plan = F.broadcast(index.spark.createDataFrame([(c, max(1, -(-int(counts[c]) // GROUP_ROWS)), max(1, -(-n // GROUP_QUERIES))) for c, n in sorted(asked.items())],
                                                   "cell int, _parts int, _loads int"))
    part = lambda key, n: F.pmod(F.xxhash64(F.col(key).cast("string")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = ["cell", "_part", "_load"]
    left = probes.join(plan, "cell").withColumn("_load", part("query_id", "_loads")).withColumn("_part", every("_parts")).drop("_parts", "_loads")
    rows = index.rows.select("cell", "key", *columns)
    if len(asked) <= LISTED_CELLS:
        rows = rows.where(F.col("cell").isin(sorted(asked)))
    right = rows.join(plan, "cell").withColumn("_part", part("key", "_parts")).withColumn("_load", every("_loads")).drop("_parts", "_loads")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(kernel, ddl)


def _code_scores(q: np.ndarray, centre: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries x rows) scores of the rows' codes, from one table of products per query."""
    width = books.shape[2]
    out = np.repeat((q @ centre)[:, None], len(codes), axis=1)
    for p in range(books.shape[0]):
        out += (q[:, p * width:(p + 1) * width] @ books[p].T)[:, codes[:, p]]
    return out


def _tiles(left: pa.Table, right: pa.Table, dim: int, parts: int) -> Iterator[tuple]:
    """Queries of a group in tiles, with the codes and errors of its rows."""
    q = unit_rows(matrix(left.column("vector"), dim))
    codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
    err = right.column("err").to_numpy()
    step = max(1, TILE // max(1, len(codes)))
    for at in range(0, len(q), step):
        yield at, q[at:at + step], codes, err


def cells_topk(index: CellIndex, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", share: float | None = None, rerank: int = 16,
               exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank, compared): the k nearest rows of each query by cosine, ties by id.

    With ``share`` None the result is exact: codes of the nearest cells give a floor for the k-th best score, then only cells and rows whose
    bounds reach it are looked at, and the rows that are left are compared exactly. With a share, the nearest cells that hold that part of the
    rows are looked at, and in each the ``rerank`` * k best codes are compared exactly. ``compared`` is the number of exact comparisons. Query
    ids must be unique; ``exclude_self`` leaves out the row whose key is the query's id.
    """
    spark = index.spark
    counts, _, centres = index.cells
    books = spark.sparkContext.broadcast(index.books)
    sent = spark.sparkContext.broadcast(index.cells)
    asked = pin(queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector"), F.lit(-math.inf).alias("floor")))
    kind, key_kind = asked.schema["query_id"].dataType.simpleString(), index.rows.schema["key"].dataType.simpleString()
    dim, parts = centres.shape[1], index.books.shape[0]
    wanted = k + exclude_self
    total = int(counts.sum())
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, id {key_kind}, score double, rank int, compared bigint")

    def nearest(upto: int) -> Callable:
        def choose(scores: np.ndarray, bounds: np.ndarray, floors: np.ndarray) -> np.ndarray:
            order = np.argsort(-scores, axis=1, kind="stable")
            held = np.cumsum(counts[order], axis=1)
            marks = np.zeros(scores.shape, bool)
            np.put_along_axis(marks, order, held - counts[order] < upto, axis=1)
            return marks
        return choose

    if share is None:
        def floor_kernel(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, scores = [], []
            if left.num_rows and right.num_rows:
                centre = sent.value[2][left.column("cell")[0].as_py()]
                for at, q, codes, err in _tiles(left, right, dim, parts):
                    low = _code_scores(q, centre, books.value, codes) - err
                    best = -np.partition(-low, min(wanted, low.shape[1]) - 1, axis=1)[:, :wanted]
                    ids.append(np.repeat(np.arange(at, at + len(q)), best.shape[1]))
                    scores.append(best.ravel())
            picked = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))
            return pa.table({"query_id": left.column("query_id").take(picked), "low": np.concatenate(scores) if scores else np.zeros(0)})

        lows = _meet(index, pin(_probe(index, asked, nearest(4 * wanted))), floor_kernel, f"query_id {kind}, low double", ["codes", "err"])
        kth = topk_per_group(lows, ["query_id"], [F.col("low").desc()], wanted).where(F.col("rank") == wanted).select("query_id", F.col("low").alias("_low"))
        floors = asked.drop("floor").join(pin(kth), "query_id", "left").select("query_id", "vector", F.coalesce("_low", F.lit(-math.inf)).alias("floor"))
        probes = _probe(index, floors, lambda scores, bounds, low: bounds >= low[:, None] - SLACK)
    else:
        probes = _probe(index, asked, nearest(max(4 * wanted, math.ceil(share * total))))

    def exact_kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, found, compared = left.column("query_id"), [], []
        if left.num_rows and right.num_rows:
            centre = sent.value[2][left.column("cell")[0].as_py()]
            floors = left.column("floor").to_numpy()
            rows, keys = unit_rows(matrix(right.column("vector"), dim)), np.array(right.column("key").to_pylist(), dtype=object if key_kind == "string" else None)
            place = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
            for at, q, codes, err in _tiles(left, right, dim, parts):
                made = _code_scores(q, centre, books.value, codes)
                for i, own in enumerate(made):
                    if share is None:
                        near = np.flatnonzero(own + err >= floors[at + i] - SLACK)
                    else:
                        n = min(len(own), rerank * wanted)
                        near = np.argpartition(-own, n - 1)[:n]
                    compared.append(len(near))
                    if exclude_self:
                        near = near[keys[near] != query_ids[at + i].as_py()]
                    scores = np.round(rows[near] @ q[i], RANK_DIGITS) + 0.0
                    best = np.lexsort((place[near], -scores))[:k]
                    found.append([{"id": key, "score": s} for key, s in zip(keys[near[best]].tolist(), scores[best].tolist())])
        used = query_ids.slice(0, len(found))
        kinds = pa.list_(pa.struct([("id", right.schema.field("key").type), ("score", pa.float64())]))
        return pa.table({"query_id": used, "compared": pa.array(compared, pa.int64()), "found": pa.array(found, kinds)})

    met = pin(_meet(index, pin(probes), exact_kernel, f"query_id {kind}, compared bigint, found array<struct<id:{key_kind},score:double>>", ["codes", "err", "vector"]))
    sums = met.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    matches = met.select("query_id", F.explode("found").alias("f")).select("query_id", "f.id", "f.score")
    return topk_per_group(matches, ["query_id"], [F.col("score").desc(), F.col("id")], k).join(sums, "query_id").select("query_id", "id", "score", "rank", "compared")
