"""Hard negatives by the threshold algorithm over per-dimension sorted lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ranking import topk_per_group
from tessera.session import pin, scratch_path

#: Rows whose lists are sorted together.
BLOCK = 4096
#: Anchors that a job sends to every task take at most this much as doubles.
ANCHOR_BYTES = 32 << 20
#: Sums below this are exact in double precision.
EXACT = 2.0**53


class SortedLists:
    """The per-dimension sorted lists of a block of rows: ids ascending, components as whole numbers in doubles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.lists = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.lists, 0)
        self.largest = float(np.abs(self.values).max(initial=0.0))
        n = len(ids)
        depths = []
        while not depths or depths[-1] < n:
            depths.append(min(n, max(8, 2 * depths[-1] if depths else 0)))
        self.depths = depths

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Random access: exact integer inner products; a sum beyond 2**53 goes through whole numbers of any size."""
        if self.largest * float(np.abs(anchor).max(initial=0.0)) * len(anchor) < EXACT:
            return (self.values[rows] @ anchor).astype(np.int64)
        whole = [int(x) for x in anchor]
        sums = [sum(int(x) * y for x, y in zip(row, whole)) for row in self.values[rows].tolist()]
        if any(abs(s) >= 2**63 for s in sums):
            raise OverflowError("a score does not fit in 64 bits")
        return np.array(sums, np.int64)

    def bounds(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors x depths): what a row that no list has shown down to a depth can score at most.

        Lists are read from their large end where the anchor's component is positive, from the small end where it is negative.
        """
        at = np.array(self.depths)
        high, low = self.sorted[len(self.ids) - at], self.sorted[at - 1]
        return np.maximum(anchors, 0) @ high.T + np.minimum(anchors, 0) @ low.T

    def search(self, anchor: np.ndarray, bound: np.ndarray, done: Callable[[np.ndarray, np.ndarray, float], bool]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows seen by sorted access until ``done(rows, scores, threshold)``; rows in order of id."""
        plus, minus = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(len(self.ids), bool)
        score = np.zeros(len(self.ids), np.int64)
        before, n = 0, len(self.ids)
        # rounding of the bound may only lengthen the search
        slack = 1e-9 * float(np.abs(anchor).sum()) * self.largest
        for depth, most in zip(self.depths, bound.tolist()):
            fresh = np.zeros(n, bool)
            fresh[self.lists[n - depth:n - before, plus]] = True
            fresh[self.lists[before:depth, minus]] = True
            if depth == n:
                fresh[:] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            score[new] = self.scores(new, anchor)
            seen |= fresh
            before = depth
            rows = np.flatnonzero(seen)
            if depth == n or done(rows, score[rows], most + slack):
                break
        return rows, score[rows]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by place (rows are in order of id)."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
    else:
        keep = np.arange(len(scores))
    return keep[np.argsort(-scores[keep], kind="stable")][:k]


def _window_floor(positive: int) -> int:
    """The smallest score of the window 80 * positive <= 100 * score."""
    return -((-80 * positive) // 100)


def usable_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, x): rows that take part, with changed labels and components floor(256 * x) as whole numbers in doubles.

    A null id, label or vector and a null or non-finite component keep a row out. Of rows with one id the smallest (label,
    components) takes part, so repeated rows count once.
    """
    def whole(v: Column) -> Column:
        y = F.lit(256.0) * v.cast("double")
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    x = F.transform(vector_col, whole)
    fine = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    ids, label = F.col(id_col).cast("bigint"), F.col(label_col).cast("bigint")
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(ids.alias("vec_id"), F.when(ids % relabel == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label).alias("label"), x.alias("x"))
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return least.select("vec_id", "r.label", "r.x")


def _anchor_groups(anchors: DataFrame) -> Iterator[dict[int, dict[str, np.ndarray]]]:
    """Anchors in groups of bounded size, by vector length: ids, labels, components and the windows' positive scores."""
    group: list = []
    held = 0

    def tables(rows: list) -> dict[int, dict[str, np.ndarray]]:
        out = {}
        for d in {len(r["x"]) for r in rows}:
            own = [r for r in rows if len(r["x"]) == d]
            out[d] = {"id": np.array([r["vec_id"] for r in own], np.int64), "label": np.array([r["label"] for r in own], np.int64),
                      "x": np.array([r["x"] for r in own], np.float64).reshape(len(own), d), "windows": [list(r["windows"]) for r in own]}
        return out

    for row in anchors.toLocalIterator():
        group.append(row)
        held += 8 * len(row["x"]) + 100
        if held >= ANCHOR_BYTES:
            yield tables(group)
            group, held = [], 0
    if group:
        yield tables(group)


def _run(rows: DataFrame, anchors: DataFrame, find: Callable, ddl: str, k: int) -> DataFrame:
    """Searches every block of ``rows`` for every anchor, one job for each group of anchors; the result of each is written.

    ``find(lists, anchors, best)`` updates ``best``, the findings of the task so far by anchor and window: a task hands out k rows for each at most.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], ddl).write.parquet(path)
    for group in _anchor_groups(anchors):
        sent = spark.sparkContext.broadcast(group)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict = {}
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    piece = batch.slice(at, BLOCK)
                    x = piece.column("x")
                    offsets = x.offsets.to_numpy()
                    sizes, flat = np.diff(offsets), x.values.to_numpy(zero_copy_only=False)
                    ids, labels = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                    for d, own in sent.value.items():
                        at_d = np.flatnonzero(sizes == d)
                        if len(at_d):
                            values = flat[(offsets[at_d][:, None] + np.arange(d)).astype(np.int64)] if d else np.zeros((len(at_d), 0))
                            find(SortedLists(ids[at_d], labels[at_d], values.astype(np.float64)), own, best)
            out = [(*key, int(s), int(i)) for key, (scores, found) in best.items() for s, i in zip(scores, found)]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "window", "score", "id"])

        rows.mapInArrow(work, ddl).write.mode("append").parquet(path)
        sent.unpersist()
    return topk_per_group(spark.read.schema(ddl).parquet(path), ["anchor_id", "window"], [F.col("score").desc(), F.col("id")], k, "rank")


def _merge(best: dict, key: tuple, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    old = best.get(key)
    if old is not None:
        scores, ids = np.concatenate([old[0], scores]), np.concatenate([old[1], ids])
        order = np.lexsort((ids, -scores))[:k]
        scores, ids = scores[order], ids[order]
    best[key] = scores, ids


FOUND = "anchor_id bigint, window bigint, score bigint, id bigint"


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", relabel: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its integer inner product with the anchor. An anchor's positives are the best ``positives`` other rows of its label;
    each has a window of scores from 80 % of its own up to its own, of which the best ``negatives`` rows of other labels are returned. Equal scores
    go by smaller id. ``is_anchor`` is a condition on ``vec_id``.

    Each block of rows keeps one sorted list per dimension. An anchor reads them in step, from the large end where its component is
    positive and from the small end where it is negative, scores every new row at once, and stops when the threshold (the best score an
    unread row could have) is strictly below the k-th score of each of its windows, or below the window itself. A task carries what it has found from
    block to block, so later blocks stop sooner. Two passes over the rows, one for positives and one for windows; a job takes as many anchors as fit
    in ``ANCHOR_BYTES``. Nothing is sampled or cut: where the bound does not bite, as with many dimensions and no structure, all rows are scored.

    Rows that take no part: see ``usable_rows``. Vectors meet only vectors of their own length. Without positives or matching negatives an anchor has no
    rows; an empty table gives an empty result. Scores must fit in 64 bits, else the job fails. Other columns are ignored.
    """
    rows = pin(usable_rows(df, id_col, vector_col, label_col, relabel, labels))
    anchors = rows.where(is_anchor)

    def positives_of(lists: SortedLists, own: dict, best: dict) -> None:
        bounds = lists.bounds(own["x"])
        for i, (anchor, label, x) in enumerate(zip(own["id"].tolist(), own["label"].tolist(), own["x"])):
            held = best.get((anchor, 0))
            kth = held[0][-1] if held is not None and len(held[0]) == positives else None

            def wanted(found: np.ndarray) -> np.ndarray:
                return (lists.labels[found] == label) & (lists.ids[found] != anchor)

            def done(found: np.ndarray, scores: np.ndarray, most: float) -> bool:
                if kth is not None and most < kth:
                    return True
                mine = scores[wanted(found)]
                return len(mine) >= positives and most < np.partition(mine, len(mine) - positives)[len(mine) - positives]

            found, scores = lists.search(x, bounds[i], done)
            keep = wanted(found)
            found, scores = found[keep], scores[keep]
            top = _best(scores, positives)
            if len(top):
                _merge(best, (anchor, 0), scores[top], lists.ids[found[top]], positives)

    def negatives_of(lists: SortedLists, own: dict, best: dict) -> None:
        bounds = lists.bounds(own["x"])
        for i, (anchor, label, x) in enumerate(zip(own["id"].tolist(), own["label"].tolist(), own["x"])):
            windows = own["windows"][i]
            least = {w: _window_floor(w) for w in windows}
            for w, low in least.items():
                held = best.get((anchor, w))
                if held is not None and len(held[0]) == negatives:
                    least[w] = max(low, int(held[0][-1]))

            def done(found: np.ndarray, scores: np.ndarray, most: float) -> bool:
                other = np.sort(scores[lists.labels[found] != label])
                for w, low in least.items():
                    if most < low:
                        continue
                    upto = int(np.searchsorted(other, w, "right"))
                    if upto < negatives or not most < other[upto - negatives]:
                        return False
                return True

            found, scores = lists.search(x, bounds[i], done)
            other = lists.labels[found] != label
            found, scores = found[other], scores[other]
            for w in windows:
                inside = np.flatnonzero((scores >= _window_floor(w)) & (scores <= w))
                top = inside[_best(scores[inside], negatives)]
                if len(top):
                    _merge(best, (anchor, w), scores[top], lists.ids[found[top]], negatives)

    first = pin(_run(rows, anchors.withColumn("windows", F.array().cast("array<bigint>")), positives_of, FOUND, positives))
    # a window that ends below zero holds no score, as 80 % of its end lie above it
    spans = first.where("score >= 0").groupBy("anchor_id").agg(F.collect_set("score").alias("windows"))
    aimed = pin(anchors.join(spans, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "x", "windows"))
    second = _run(rows, aimed, negatives_of, FOUND, negatives)
    pairs = first.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("window"))
    return pairs.join(second, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                                                              F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))
