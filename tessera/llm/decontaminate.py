"""Benchmark items in training passages: BM25 index of the items, block-max WAND, verified overlap."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import pin

WORD = re.compile(r"\w+")
#: Postings per block with one maximum.
BLOCK = 32


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Different runs of ``size`` words; a shorter text is one run."""
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class ItemIndex:
    """Postings of items by word with BM25 impacts and block maxima.

    ``need[i]`` is the least score that a passage with ``overlap`` of item i's shingles can have: each word that is missing costs at least one shingle,
    so at most that part of the words can be missing, at worst those of the greatest impact. So everything that passes
    the verification scores at least that.
    """

    def __init__(self, items: list[tuple[int, str, str | None]], size: int = 5, overlap: float = 0.8, k1: float = 1.2, b: float = 0.75,
                 every: tuple[int, float, dict[str, int], int] | None = None) -> None:
        """``every`` is (items with words, their mean length, items that have each word, most words of an item) where these items are a part of more."""
        self.size, self.overlap = size, overlap
        self.ids, self.words, self.answers = [], [], []
        for i, question, answer in sorted(items, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or "")):
            words, tail = words_of(question), words_of(answer)
            if words or tail:
                whole = words + tail
                self.ids.append(i)
                self.words.append(whole)
                self.answers.append(set(tail or whole[-max(1, len(whole) // 4):]))
        self.sets = [shingles(w, size) for w in self.words]
        n = len(self.ids)
        of, mean, seen, self.longest = every or (n, sum(map(len, self.words)) / max(1, n), Counter(w for ws in self.words for w in set(ws)), max(map(len, self.words), default=0))
        self.term = {w: j for j, w in enumerate(sorted(set().union(*self.words)))}
        posted: list[list[tuple[int, float]]] = [[] for _ in self.term]
        self.impacts: list[dict[int, float]] = []
        self.need = np.zeros(n)
        for i, ws in enumerate(self.words):
            own = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (of - seen[w] + 0.5) / (seen[w] + 0.5))
                own[self.term[w]] = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / mean))
            for t, x in own.items():
                posted[t].append((i, x))
            missing = int((1 - overlap) * max(1, len(ws) - size + 1) + 1e-9)
            self.need[i] = sum(sorted(own.values())[: len(own) - missing]) * (1 - 1e-9)
            self.impacts.append(own)
        self.items = [np.array([i for i, _ in p], np.int64) for p in posted]
        self.scores = [np.array([x for _, x in p]) for p in posted]
        self.tops = [[float(x[j:j + BLOCK].max()) for j in range(0, len(x), BLOCK)] for x in self.scores]
        self.top = [max(t) for t in self.tops]
        self.floor = float(self.need.min()) if n else 0.0
        # rare: words of at most ``most`` items; the others together must stay below every item's need
        most = 2
        while True:
            self.rare = np.array([len(x) <= most for x in self.items], bool)
            self.rest = np.array([sum(x for t, x in own.items() if not self.rare[t]) for own in self.impacts])
            if most >= n or (self.rest < 0.7 * self.need).all():
                break
            most *= 2
        counts = np.array([len(x) if r else 0 for x, r in zip(self.items, self.rare)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        chosen = [t for t in range(len(self.items)) if self.rare[t]]
        self.flat_items = np.concatenate([self.items[t] for t in chosen]) if chosen else np.zeros(0, np.int64)
        self.flat_scores = np.concatenate([self.scores[t] for t in chosen]) if chosen else np.zeros(0)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with a score of at least the item's need, for the different terms of a passage."""
        lists = [[0, t] for t in terms]
        out, end = [], len(self.ids)
        at = lambda x: int(self.items[x[1]][x[0]]) if x[0] < len(self.items[x[1]]) else end
        while True:
            lists = sorted((x for x in lists if x[0] < len(self.items[x[1]])), key=at)
            total, pivot = 0.0, None
            for n, x in enumerate(lists):
                total += self.top[x[1]]
                if total >= self.floor:
                    pivot = n
                    break
            if pivot is None:
                return out
            item = at(lists[pivot])
            while pivot + 1 < len(lists) and at(lists[pivot + 1]) == item:
                pivot += 1
            front = lists[: pivot + 1]
            for x in front:
                x[0] = int(np.searchsorted(self.items[x[1]], item)) if at(x) < item else x[0]
            live = [x for x in front if x[0] < len(self.items[x[1]])]
            bound = sum(self.tops[x[1]][x[0] // BLOCK] for x in live)
            if bound >= self.need[item]:
                here = [x for x in live if at(x) == item]
                score = sum(float(self.scores[x[1]][x[0]]) for x in here)
                if score >= self.need[item]:
                    out.append((item, score))
            for x in live:
                x[0] += at(x) == item
        return out

    def within_reach(self, windows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Windows in which some item can reach its need: rare words exactly, the others at their most. Pairs must be different."""
        keep = self.rare[terms]
        windows, terms = windows[keep], terms[keep]
        counts = self.first[terms + 1] - self.first[terms]
        starts = np.repeat(self.first[terms] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        keys, place = np.unique(np.repeat(windows, counts) * len(self.ids) + self.flat_items[starts], return_inverse=True)
        sums = np.bincount(place, self.flat_scores[starts], len(keys))
        items = keys % max(1, len(self.ids))
        return np.unique(keys[sums + self.rest[items] >= self.need[items]] // max(1, len(self.ids)))

    def matches(self, text: str | None) -> list[tuple[int, float, float]]:
        """(item id, best score, overlap) of the verified items of a whole text, in passages that overlap by the longest item."""
        words = words_of(text)
        ids = np.fromiter((self.term.get(w, -1) for w in words), np.int64, len(words))
        places = np.flatnonzero(ids >= 0)
        if not len(places) or not len(self.ids):
            return []
        step = max(64, self.longest)
        own = places // step
        both = np.concatenate([own * len(self.term) + ids[places], (own[own > 0] - 1) * len(self.term) + ids[places][own > 0]])
        pairs = np.unique(both)
        windows, terms = np.divmod(pairs, len(self.term))
        reach = self.within_reach(windows, terms)
        best: dict[int, tuple[float, float]] = {}
        for w in reach.tolist():
            for item, score in self.search(terms[np.searchsorted(windows, w):np.searchsorted(windows, w, "right")].tolist()):
                passage = words[w * step:w * step + 2 * step]
                inside = shingles(passage, min(self.size, len(self.words[item])))
                share = len(self.sets[item] & inside) / len(self.sets[item])
                answer = len(self.answers[item].intersection(passage)) / len(self.answers[item])
                if share >= self.overlap and answer >= 0.5:
                    best[item] = max(best.get(item, (0.0, 0.0)), (score, share))
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def _item_words(items: DataFrame) -> tuple[DataFrame, int, float, int]:
    """((i, w) once for each item row and word, items with words, mean length, greatest length) over all items."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str | None, int]] = []
            for r in batch.to_pylist():
                words = words_of(r["q"]) + words_of(r["a"])
                out += [(r["i"], w, 0) for w in set(words)] + [(r["i"], None, len(words))] * bool(words)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["i", "w", "n"])

    rows = pin(items.mapInArrow(work, "i bigint, w string, n bigint"))
    n, total, most = rows.where("w is null").agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    return rows.where("w is not null").select("i", "w"), n, (total or 0) / max(1, n), most or 0


def with_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None,
                 overlap: float = 0.8, items_per_index: int = 20_000, out: str = "matches") -> DataFrame:
    """``docs`` with ``out``, an array of (item_id, score, overlap): the benchmark items that stand in the text.

    The items are indexed in parts of about ``items_per_index`` with the statistics of all of them, and every passage of every text is searched in
    each part. With more than one part the rows are written after each, so a task holds one part at a time. A hit has at least ``overlap`` of the
    item's five-word shingles in one passage and half of the words of its answer; without
    an answer column the last quarter of the item's words is taken for it. ``score`` is BM25 of the best such passage.

    Items without words are not searched, null ids are allowed for texts but not for items. A null or empty text has no
    matches; a very long one is searched passage by passage. Without items no text has a match, an empty table gives an empty one. Items
    that share an id are searched each for itself and may both be named; equal hits of one passage do not compete, all are returned. Rows keep
    their columns, a column named like ``out`` is replaced; repeated rows are each searched.
    """
    spark = docs.sparkSession
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    listed = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(question_col).alias("q"), answer.alias("a")).where("i is not null")
    listed = listed.distinct()
    parts = max(1, -(-listed.count() // items_per_index))
    numbers = _item_words(listed) if parts > 1 else None
    kind = "array<struct<item_id:bigint,score:double,overlap:double>>"
    found = docs.drop(out).withColumn(out, F.expr("array()").cast(kind))
    entry = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())]))
    for part in range(parts):
        chosen = F.pmod(F.xxhash64("i"), F.lit(parts)) == part
        rows = listed.where(chosen).collect()
        every = None
        if numbers is not None:
            words, n, mean, longest = numbers
            own = words.where(chosen).select("w").distinct()
            seen = words.groupBy("w").count().join(own, "w").collect()
            every = n, mean, {r["w"]: r["count"] for r in seen}, longest
        sent = spark.sparkContext.broadcast(ItemIndex([(r["i"], r["q"] or "", r["a"]) for r in rows], overlap=overlap, every=every))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                texts, old = batch.column(batch.schema.get_field_index("_text")), batch.column(batch.schema.get_field_index("_found"))
                new = [[*(old[i].as_py() or ()), *({"item_id": a, "score": b, "overlap": c} for a, b, c in index.matches(texts[i].as_py()))] for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, entry)], names=batch.schema.names)

        names = [f"_c{i}" for i in range(len(docs.drop(out).columns))]
        plain = found.toDF(*names, "_found").select(*names, F.col(names[docs.drop(out).columns.index(text_col)]).alias("_text"), "_found")
        fields = plain.schema
        found = plain.mapInArrow(work, fields).drop("_text").toDF(*docs.drop(out).columns, out)
        found = pin(found) if parts > 1 else found
    return found
