"""Exact, approximate, keyword and hybrid retrieval."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import rows_of
from tessera.functions.text import tokenize_words
from tessera.functions.vectors import RANK_DIGITS, BestMatches, cosine_to, matrix, norm, push_tiles, unit_rows
from tessera.inference.models import HashedEmbedder, ModelFactory
from tessera.inference.runner import ai_query
from tessera.operators.ranking import global_running, topk_per_group
from tessera.session import pin

# A side this small is sent to every task; its size is counted first. 64 MB as doubles.
BROADCAST_CELLS = 8_000_000
SHORTEST_VECTOR = 16
BLOCK_ROWS = 20_000
# Groups of a side of the blocked join, and the most numbers of a group: 32 MB as doubles.
SIDE_GROUPS, GROUP_CELLS = 12, 4_000_000
MATCH_DDL = "query_id bigint, id bigint, score double"
RRF_K = 60


def embed_text(df: DataFrame, text: str, model: ModelFactory | None = None, dim: int = 64,
               out: str = "embedding") -> DataFrame:
    """Text to a unit vector; the model is built once per task."""
    return ai_query(df, text, model or HashedEmbedder(dim), out, returns="array<float>", batch=256)


def with_score(corpus: DataFrame, vector: list[float], column: str = "embedding") -> DataFrame:
    return corpus.withColumn("score", cosine_to(vector)(F.col(column)))


def _best(scored: DataFrame, k: int, id_col: str, columns: list[str] | None) -> DataFrame:
    out = scored.select(id_col, *(columns or []), "score")
    return out.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def vector_topk(corpus: DataFrame, vector: list[float], k: int, id_col: str = "id", column: str = "embedding",
                columns: list[str] | None = None) -> DataFrame:
    """The k rows with the highest cosine; equal scores by id. A zero vector scores 0 everywhere."""
    return _best(with_score(corpus, vector, column), k, id_col, columns)


def vector_topk_prefilter(corpus: DataFrame, vector: list[float], k: int, condition: Column, **kw) -> DataFrame:
    """Every matching row is a candidate; the condition reaches the scan."""
    return vector_topk(corpus.where(condition), vector, k, **kw)


def vector_topk_postfilter(corpus: DataFrame, vector: list[float], k: int, condition: Column, **kw) -> DataFrame:
    """The condition sees the k best only, so fewer than k rows may remain."""
    return vector_topk(corpus, vector, k, **kw).where(condition)


def query_vector(text: str | None, model: ModelFactory | None) -> list[float]:
    if text is None:
        raise ValueError("a query text or a query vector is needed")
    if model is None:
        raise ValueError("a query text needs the embedder of the corpus")
    return model()([text])[0]


def text_topk(corpus: DataFrame, text: str | None, k: int, model: ModelFactory | None, condition: Column | None = None,
              **kw) -> DataFrame:
    rows = corpus if condition is None else corpus.where(condition)
    return vector_topk(rows, query_vector(text, model), k, **kw)


def scan_all(corpus: DataFrame, id_col: str = "id") -> DataFrame:
    """Every row of an index in id order, for an export."""
    return corpus.orderBy(id_col)


# ---------------------------------------------------------------- k nearest rows for a table of queries


def _fits(df: DataFrame) -> bool:
    """Whether a side of (id, vector) has at most BROADCAST_CELLS numbers; counting stops soon after that."""
    limit = BROADCAST_CELLS // SHORTEST_VECTOR
    sizes = df.select(F.size("vector").alias("n")).limit(limit + 1)
    rows, dim = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    return rows <= limit and rows * max(dim or 0, SHORTEST_VECTOR) <= BROADCAST_CELLS


def _dim(df: DataFrame, vector: str) -> int:
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return first[0] if first else 0


def _sides(queries: DataFrame, corpus: DataFrame, query_id: str, id_col: str, vector: str):
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).alias("vector"))
    c = corpus.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    return q, c


def _load(df: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """A side whose size was counted, as ids and unit vectors."""
    table = df.toArrow()
    return table.column(key).to_numpy().astype("int64"), unit_rows(matrix(table.column("vector")))


def _emit(best: BestMatches, query_ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[best.query]), pa.array(best.ids), pa.array(best.scores)], ["query_id", "id", "score"])


def _final(matches: DataFrame, k: int) -> DataFrame:
    return topk_per_group(matches, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def _against_small_queries(q: DataFrame, c: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Each task keeps its k best per query; the corpus is not shuffled."""
    shared = q.sparkSession.sparkContext.broadcast(_load(q, "query_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        best = BestMatches(len(query_ids), k)
        for b in batches:
            if b.num_rows:
                rows = unit_rows(matrix(b.column("vector"), vectors.shape[1]))
                push_tiles(best, vectors, query_ids, rows, b.column("id").to_numpy(), exclude_self)
        yield _emit(best, query_ids)

    return _final(c.mapInArrow(run, MATCH_DDL), k)


def _against_small_corpus(q: DataFrame, c: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Each query row meets the whole corpus in its own task, so nothing is left to merge."""
    shared = q.sparkSession.sparkContext.broadcast(_load(c, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value
        for b in batches:
            if b.num_rows:
                query_ids = b.column("query_id").to_numpy()
                best = BestMatches(len(query_ids), k)
                vectors = unit_rows(matrix(b.column("vector"), rows.shape[1]))
                push_tiles(best, vectors, query_ids, rows, ids, exclude_self)
                yield _emit(best, query_ids)

    return _final(q.mapInArrow(run, MATCH_DDL), k)


def _block_kernel(k: int, exclude_self: bool, tile_rows: int = BLOCK_ROWS):
    """Arrow function over a group of queries and a group of rows; ``tile_rows`` queries at a time are scored."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        dim = next((n for side in (left, right) for n in side.column("vector").combine_chunks().value_lengths().drop_null().slice(0, 1).to_pylist()), 0)
        rows, ids, found = unit_rows(matrix(right.column("vector"), dim)), right.column("id").to_numpy(), []
        for at in range(0, left.num_rows, tile_rows):
            tile = left.slice(at, tile_rows)
            query_ids = tile.column("query_id").to_numpy()
            best = BestMatches(len(query_ids), k)
            push_tiles(best, unit_rows(matrix(tile.column("vector"), dim)), query_ids, rows, ids, exclude_self)
            found.append(_emit(best, query_ids))
        return pa.Table.from_batches(found)

    return run


def _group_rows(count: int, dim: int, block_rows: int) -> int:
    """Rows of a side that go to a task together: a ``SIDE_GROUPS``-th of the side, at least a block and at most ``GROUP_CELLS`` numbers."""
    return max(block_rows, min(-(-count // SIDE_GROUPS), GROUP_CELLS // max(dim, SHORTEST_VECTOR)))


def knn_join_blocked(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id",
                     vector: str = "embedding", block_rows: int = BLOCK_ROWS, exclude_self: bool = False) -> DataFrame:
    """k nearest rows per query when both sides are large.

    Both sides are cut in even groups by a hash of the unique id. Each pair of groups is one task
    that scores ``block_rows`` queries at a time and keeps k rows per query, so neither a pair list nor a
    hot group can form. Then the k best of k per group are merged.

    A row is sent once per group of the other side. There are ``SIDE_GROUPS`` of them however many rows there are, until a
    group would hold more than ``GROUP_CELLS`` numbers: up to there the rows moved grow as the input, and a task's memory is bounded beyond.
    """
    q, c = _sides(queries, corpus, query_id, id_col, vector)
    sizes = [df.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first() for df in (q, c)]
    q_blocks, c_blocks = (max(1, -(-n // _group_rows(n, dim or 0, block_rows))) for n, dim in sizes)
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("_q", block("query_id", q_blocks)).withColumn("_c", every(c_blocks))
    right = c.withColumn("_c", block("id", c_blocks)).withColumn("_q", every(q_blocks))
    matches = (left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c"))
               .applyInArrow(_block_kernel(k, exclude_self, block_rows), MATCH_DDL))
    return _final(matches, k)


def _whole(df: DataFrame, key: str) -> bool:
    return df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _by_number(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, id_col: str, vector: str, exclude_self: bool) -> DataFrame:
    """``knn_join`` for keys of any type: numbers in the order of the keys keep the order of ties; the k rows of each query get their keys back."""
    def numbered(df: DataFrame, key: str) -> DataFrame:
        return pin(global_running(df.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).where(F.col(key).isNotNull()), [F.col("_key")], row_number="_no"))

    q, c = numbered(queries, query_id), numbered(corpus, id_col)
    wanted = k + exclude_self
    sides = [df.select(F.col("_no").alias(name), F.col("_v").alias("embedding")) for df, name in ((q, "query_id"), (c, "id"))]
    found = pin(knn_join(*sides, wanted).drop("rank"))
    named = (found.join(q.select(F.col("_no").alias("query_id"), F.col("_key").alias("_q")), "query_id")
             .join(c.select(F.col("_no").alias("id"), F.col("_key").alias("_c")), "id"))
    named = named.select(F.col("_q").alias("query_id"), F.col("_c").alias("id"), "score")
    if exclude_self:
        named = named.where(~F.col("query_id").eqNullSafe(F.col("id")))
    return _final(named, k)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id",
             vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k nearest corpus rows of each query by cosine, ties by id.

    A side that was counted and fits is sent to all tasks; two large sides go block by block. Keys that are no whole numbers are numbered in
    their order for the search.
    """
    if not (_whole(queries, query_id) and _whole(corpus, id_col)):
        return _by_number(queries, corpus, k, query_id, id_col, vector, exclude_self)
    q, c = _sides(queries, corpus, query_id, id_col, vector)
    if _fits(q):
        return _against_small_queries(q, c, k, exclude_self)
    if _fits(c):
        return _against_small_corpus(q, c, k, exclude_self)
    return knn_join_blocked(queries, corpus, k, query_id, id_col, vector, BLOCK_ROWS, exclude_self)


# ---------------------------------------------------------------- approximate search


def sign_planes(dim: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    """Directions of plus and minus ones, drawn from a hash of (seed, table, bit, position): dim x (tables * bits)."""
    def sign(table: int, bit: int, at: int) -> float:
        return 1.0 if hashlib.md5(f"{seed}-{table}-{bit}-{at}".encode()).hexdigest()[0] < "8" else -1.0

    return np.array([[sign(t, b, d) for t in range(tables) for b in range(bits)] for d in range(dim)])


def sign_buckets(dim: int, bits: int, tables: int, seed: int = 7):
    """Arrow function from a vector to one bucket number per table: the signs against fixed directions."""
    planes = sign_planes(dim, bits, tables, seed)
    weights = 1 << np.arange(bits)

    @F.arrow_udf("array<int>")
    def buckets(column: pa.Array) -> pa.Array:
        signs = (matrix(column, dim) @ planes > 0).reshape(-1, tables, bits)
        codes = (signs * weights).sum(axis=2).astype("int32")
        offsets = np.arange(0, codes.size + 1, tables, dtype="int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))

    return buckets


def ann_topk(queries: DataFrame, corpus: DataFrame, k: int, bits: int = 4, tables: int = 8, query_id: str = "query_id",
             id_col: str = "id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, seed: int = 7,
             exclude_self: bool = False) -> DataFrame:
    """Approximate k nearest rows: rows that share a sign bucket in any table are ranked exactly.

    Bucket sizes are counted first and a large bucket is split in even parts, so a bucket with a
    third of all rows becomes many tasks. ``candidates`` counts the rows a query was compared with.
    Queries whose buckets hold fewer than k rows are searched exactly, so none is incomplete.
    """
    q, c = _sides(queries, corpus, query_id, id_col, vector)
    sign = sign_buckets(_dim(c, "vector"), bits, tables, seed)
    spread = lambda df: rows_of(df, ["*"], sign("vector"), "_bucket", "_table")
    left, right = spread(q), spread(c)
    parts = F.ceil(F.col("_rows") / block_rows).cast("int")
    sizes = right.groupBy("_table", "_bucket").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_parts", parts)
    loads = left.groupBy("_table", "_bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_loads"))
    # At most tables * 2^bits rows, by construction.
    plan = F.broadcast(pin(sizes.join(loads, ["_table", "_bucket"])))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = left.join(plan, ["_table", "_bucket"])
    by = ["_table", "_bucket", "_part", "_load"]
    probes = probes.withColumn("_load", part("query_id", "_loads"))
    counts = probes.groupBy("query_id").agg(F.sum("_rows").alias("candidates"))
    probes = probes.withColumn("_part", every("_parts")).select("query_id", "vector", *by)
    rows = right.join(plan, ["_table", "_bucket"]).withColumn("_part", part("id", "_parts"))
    rows = rows.withColumn("_load", every("_loads")).select("id", "vector", *by)
    matches = probes.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_block_kernel(k, exclude_self), MATCH_DDL)
    # The same pair may come from several tables, always with the same score.
    once = matches.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    found = pin(_final(once, k).join(counts, "query_id"))
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select("query_id")
    short = pin(q.where(F.col("query_id").isNotNull()).join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return found
    exact = knn_join(short, c, k, vector="vector", exclude_self=exclude_self)
    return found.join(full, "query_id", "left_semi").unionByName(exact.withColumn("candidates", F.lit(c.count()).cast("bigint")))


def recall_at_k(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact k best that the approximate result holds, per query."""
    found = approximate.select("query_id", "id", F.lit(1).alias("_hit"))
    joined = exact.select("query_id", "id").join(found, ["query_id", "id"], "left")
    return joined.groupBy("query_id").agg((F.count("_hit") / F.lit(k)).alias("recall"))


# ---------------------------------------------------------------- keyword and hybrid search


def query_terms(text: str) -> list[str]:
    """Distinct words of a query, as ``tokenize_words`` sees them."""
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}_]+", text.lower())))


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def keyword_scores(corpus: DataFrame, text: str, keep: list[str | Column], column: str = "text", k1: float = 1.2,
                   b: float = 0.75) -> DataFrame:
    """(keep, score): BM25 of every row against a query; rows without a query word score null.

    The text is read once. Words are counted inside the row and only (keep, length, counts) is
    written; document frequencies and scores come from those narrow rows. No postings are shuffled.
    """
    terms = query_terms(text)
    tokens = corpus.select(*keep, tokenize_words(F.col(column)).alias("_tokens"))
    names = tokens.columns[:-1]
    hits = tokens.select(*names, F.size("_tokens").alias("_len"), F.filter(
        "_tokens", lambda t: t.isin(terms) if terms else F.lit(False)).alias("_hits"))
    counts = F.when(F.size("_hits") > 0, F.array(*[_count("_hits", t) for t in terms]).cast("array<int>"))
    counted = pin(hits.select(*names, "_len", counts.alias("_tf")))
    # One row: the number of rows, their mean length and a frequency per query word.
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg_len"), *[
        F.count_if(F.col("_tf")[i] > 0).alias(f"df_{i}") for i in range(len(terms))]).first()
    total = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = stats[f"df_{i}"], F.col("_tf")[i]
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.lit(stats["avg_len"])))
    return counted.select(*names, F.when(F.col("_tf").isNotNull(), F.round(total, RANK_DIGITS)).alias("score"))


def keyword_topk(corpus: DataFrame, text: str, k: int = 6, id_col: str = "id", column: str = "text",
                 columns: list[str] | None = None) -> DataFrame:
    """Best k rows by BM25 with the number of all matching rows in ``total``."""
    scored = keyword_scores(corpus, text, [id_col], column).where(F.col("score").isNotNull())
    total = scored.agg(F.count(F.lit(1))).scalar()
    best = _best(scored, k, id_col, None).withColumn("total", total)
    if not columns:
        return best
    # k rows, whatever the size of the corpus.
    return corpus.select(id_col, *columns).join(F.broadcast(best), id_col).orderBy(F.col("score").desc(), F.col(id_col))


def exact_ranks(scored: DataFrame, score: str, targets: list[tuple[int, float]], id_col: str) -> DataFrame:
    """(id, rank) of a few target rows among all rows by (score descending, id): one counting pass, no sort.

    Each task counts the rows better than each target and sends one number per target.
    """
    ids = np.array([t[0] for t in targets], dtype="int64")
    values = np.array([t[1] for t in targets], dtype="float64")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better = np.zeros(len(ids), dtype="int64")
        for b in batches:
            row_ids, row_scores = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((row_ids, row_scores))
            row_ids, row_scores = row_ids[order], row_scores[order]
            low, high = (np.searchsorted(row_scores, values, side) for side in ("left", "right"))
            tied = [np.searchsorted(row_ids[a:z], i) for a, z, i in zip(low, high, ids)]
            better += len(row_ids) - high + np.array(tied, dtype="int64")
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(better)], ["id", "better"])

    rows = scored.where(F.col(score).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(score).cast("double"))
    counts = rows.mapInArrow(count, "id bigint, better bigint")
    return counts.groupBy("id").agg((F.sum("better") + 1).alias("rank"))


def reciprocal_rank_fusion(scored: DataFrame, id_col: str, scores: list[str], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """The k rows with the highest sum of 1 / (rrf_k + rank) over several score columns; a null score adds 0.

    The k best rows of any one list reach at least 1 / (rrf_k + k). With n lists, a row outside the
    first n * (rrf_k + k) - rrf_k places of every list stays below that, so those places hold the
    whole answer. Only their rows need a rank, and the ranks are counted over all rows. ``scored``
    is read several times and should be stored.
    """
    depth = len(scores) * (rrf_k + k) - rrf_k
    columns = [F.col(id_col), *map(F.col, scores)]
    tops = [scored.select(*columns).where(F.col(s).isNotNull()).orderBy(F.col(s).desc(), F.col(id_col)).limit(depth)
            for s in scores]
    # At most ``depth`` rows per list.
    candidates = {r[0]: tuple(r[1:]) for top in tops for r in top.collect()}
    if not candidates:
        return scored.select(*columns).limit(0).withColumn("score", F.lit(0.0))
    fused = scored.sparkSession.createDataFrame(
        [(i, *values) for i, values in candidates.items()],
        f"{id_col} bigint, " + ", ".join(f"{s} double" for s in scores))
    total = F.lit(0.0)
    for n, s in enumerate(scores):
        targets = [(i, values[n]) for i, values in candidates.items() if values[n] is not None]
        if targets:
            ranks = exact_ranks(scored, s, targets, id_col).select(F.col("id").alias(id_col), F.col("rank").alias(f"_rank_{n}"))
            fused = fused.join(ranks, id_col, "left")
            total = total + F.coalesce(1.0 / (rrf_k + F.col(f"_rank_{n}")), F.lit(0.0))
    return fused.select(*columns, F.round(total, RANK_DIGITS).alias("score")).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def hybrid_topk(corpus: DataFrame, text: str, k: int, model: ModelFactory | None = None, condition: Column | None = None,
                id_col: str = "id", column: str = "text", vector: str = "embedding", rrf_k: int = RRF_K) -> DataFrame:
    """Semantic and keyword rank fused by reciprocal rank. Both ranks are exact over all rows."""
    rows = corpus if condition is None else corpus.where(condition)
    near = cosine_to(query_vector(text, model or HashedEmbedder()))(F.col(vector)).alias("vector_score")
    both = keyword_scores(rows, text, [id_col, near], column).withColumnRenamed("score", "keyword_score")
    return reciprocal_rank_fusion(both, id_col, ["vector_score", "keyword_score"], k, rrf_k)


# ---------------------------------------------------------------- index tables


def index_build(df: DataFrame, pk: str, vector: str, dim: int, path: str) -> None:
    """Writes (columns, norm) after checking that the key is unique and all vectors have ``dim`` numbers."""
    doubled = df.groupBy(pk).count().where("count > 1").limit(1).count()
    wrong = df.where(F.coalesce(F.size(vector) != dim, F.lit(True))).limit(1).count()
    if doubled or wrong:
        raise ValueError(f"index source has {'repeated keys' if doubled else 'vectors of another length'}")
    df.withColumn("norm", norm(F.col(vector))).write.mode("overwrite").parquet(path)


def index_freshness(source: DataFrame, index: DataFrame, pk: str) -> tuple[DataFrame, DataFrame]:
    """(counts with a ready flag, source keys that the index lacks)."""
    missing = source.select(pk).join(index.select(pk), pk, "left_anti")
    counts = index.agg(F.count(F.lit(1)).alias("indexed")).withColumn(
        "expected", source.agg(F.count(F.lit(1))).scalar())
    return counts.withColumn("ready", F.col("indexed") >= F.col("expected")), missing


def document_index_load(df: DataFrame, mapping: dict[str, str], text: str, path: str, model: ModelFactory | None = None,
                        key: str = "id") -> None:
    """Renamed fields with the key as text and a vector of the text, written as an index table."""
    named = embed_text(df, text, model, out="vector").select(
        *[F.col(src).cast("string").alias(dst) if dst == key else F.col(src).alias(dst) for dst, src in mapping.items()],
        "vector")
    named.write.mode("overwrite").parquet(path)
