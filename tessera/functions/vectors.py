"""Vector arithmetic: expressions for short vectors, Arrow blocks for long ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a score in a report.
SCORE_DIGITS = 6
#: Digits a ranking uses: all but the last, where the order of a sum makes equal vectors differ.
RANK_DIGITS = 12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles; vectors of another length are an error, null vectors are zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    known = sizes[sizes >= 0]
    dim = dim if dim is not None else (int(known[0]) if len(known) else 0)
    if (known != dim).any():
        raise ValueError(f"vectors of length {sorted(set(known.tolist()))}, expected {dim}")
    out = np.zeros((len(column), dim))
    if dim and len(known):
        out[sizes >= 0] = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)
    return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def cosine_to(vector: list[float]):
    """Arrow function that scores a vector column against one fixed vector."""
    target = unit_rows(np.asarray(vector, dtype="float64").reshape(1, -1))[0]

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(np.round(unit_rows(matrix(column, len(target))) @ target, RANK_DIGITS) + 0.0)

    return score


class BestMatches:
    """Running k best (score, id) per query; equal scores go to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.queries, self.k = queries, k
        self.query = np.empty(0, dtype="int64")
        self.ids = np.empty(0, dtype="int64")
        self.scores = np.empty(0)
        self.floor = np.full(queries, -np.inf)

    def push(self, scores: np.ndarray, ids: np.ndarray, hidden: np.ndarray | None = None) -> None:
        """``scores`` is queries x rows; pairs marked in ``hidden`` do not count.

        Only scores that reach a query's k-th best so far go further, and only queries that have such scores are sorted again.
        """
        if not scores.size:
            return
        if hidden is not None:
            scores[hidden] = -np.inf
        # scores are compared to RANK_DIGITS; until they are rounded, a little less counts as equal
        slack = 2 * 10.0 ** -RANK_DIGITS
        keep = (scores >= (self.floor - slack)[:, None]) & (scores > -np.inf)
        if scores.shape[1] > self.k and np.count_nonzero(keep) > 4 * self.k * self.queries:
            keep &= scores >= (np.partition(scores, -self.k, axis=1)[:, -self.k] - slack)[:, None]
        q, c = np.nonzero(keep)
        if not len(q):
            return
        touched = np.zeros(self.queries, bool)
        touched[q] = True
        old = touched[self.query]
        query = np.concatenate([self.query[old], q])
        found = np.concatenate([self.ids[old], ids[c]])
        value = np.concatenate([self.scores[old], np.round(scores[q, c], RANK_DIGITS) + 0.0])
        order = np.lexsort((found, -value, query))
        query, found, value = query[order], found[order], value[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        full = best & (place == self.k - 1)
        self.floor[query[full]] = value[full]
        self.query = np.concatenate([self.query[~old], query[best]])
        self.ids = np.concatenate([self.ids[~old], found[best]])
        self.scores = np.concatenate([self.scores[~old], value[best]])


def push_tiles(best: BestMatches, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray,
               exclude_self: bool, cells: int = 4_000_000) -> None:
    """Scores in tiles of about ``cells`` numbers, so memory stays flat for any block."""
    width = max(1, cells // max(1, len(queries)))
    for start in range(0, len(rows), width):
        part = slice(start, start + width)
        hidden = query_ids[:, None] == ids[part][None, :] if exclude_self else None
        best.push(queries @ rows[part].T, ids[part], hidden)
