"""Hidden Markov language model: Baum-Welch counts added up over partitions, exact likelihood by scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import pin

#: Words that one task counts before it hands them on.
FLUSH = 200_000
#: Steps of a training text between two stored states; texts and tokens that are worked on side by side (one text may have more).
WAVE, SIDE_ROWS, SIDE_TOKENS = 64, 4096, 2_000_000
#: Texts scored side by side.
ROWS = 256
#: Longest word, in bytes, that is sent to every task.
SENT_BYTES = 64


def words_of(raw: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (raw or b"").lower().split()


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def count_words(texts: DataFrame, classes: int) -> DataFrame:
    """(word, class, n) of a binary column ``raw``; counted within the task first, so a frequent word is no hot key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([word_class(w, classes) for w in words], pa.int32()),
                                               pa.array([counts[w] for w in words], pa.int64())], names=["word", "class", "n"])

        for batch in batches:
            for raw in batch.column(0):
                counts.update(words_of(raw.as_py()))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    return texts.select("raw").mapInArrow(work, "word binary, class int, n bigint").groupBy("word", "class").agg(F.sum("n").alias("n"))


class Lexicon:
    """What tasks know of the words: the most frequent ones in order, as (word, class, count), and the totals of the word classes.

    Symbols are the first ``own`` words, the classes of all other words, and the end.
    """

    def __init__(self, top: list[tuple[bytes, int, int]], own: int, log_class: np.ndarray, ends: int) -> None:
        self.numbers = {w: i for i, (w, _, _) in enumerate(top)}
        self.own, self.classes, self.ends, self.log_class = own, len(log_class), ends, log_class
        self.logs = np.log10(np.array([n for _, _, n in top], np.float64) + 1)
        kinds = np.array([c for _, c, _ in top], np.int32)
        first = np.arange(len(top)) < own
        self.symbol_of = np.where(first, np.arange(len(top)), own + kinds).astype(np.int32)
        self.inside_of = np.where(first, 0.0, self.logs - log_class[kinds])

    @property
    def symbols(self) -> int:
        return self.own + self.classes + 1

    def encode(self, raw: bytes | None) -> tuple[np.ndarray, int, float, float, Counter]:
        """(symbols with the end, known tokens, sum of log10 (count + 1), the same for class words less their class totals, other words)."""
        words = words_of(raw)
        found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        out = np.empty(len(words) + 1, np.int32)
        out[-1] = self.own + self.classes
        new = np.flatnonzero(found < 0)
        known = found[found >= 0]
        out[:-1][found >= 0] = self.symbol_of[known]
        others = Counter(words[i] for i in new)
        kinds = {w: word_class(w, self.classes) for w in others}
        out[new] = [self.own + kinds[words[i]] for i in new]
        inside = float(self.inside_of[known].sum()) - sum(n * float(self.log_class[kinds[w]]) for w, n in others.items())
        return out, len(known) + (self.ends > 0), float(self.logs[known].sum() + np.log10(self.ends + 1)), inside, others


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def random(states: int, unigram: np.ndarray, seed: int = 0) -> Hmm:
        """Start of the training: the symbol frequencies, disturbed for each state."""
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * rng.lognormal(0, 0.5, (len(unigram), states))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def counts(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch: expected starts, moves and emissions of whole texts, and their log10 likelihood.

        Texts stand in ``flat`` from ``begins`` on and go side by side, the longest first, so those that have a step are always the first rows. The
        forward sweep keeps the states before every ``WAVE``-th step; the backward sweep goes through the stretches from the last one on, makes their forward
        states again, and carries its own from stretch to stretch. So only a text's first token is a start, every move inside a text
        counts, and memory does not grow with the length of the texts.
        """
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        steps, width = int(sizes[0]) if len(sizes) else 0, len(self.start)
        live = np.searchsorted(-sizes, -np.arange(steps + 1) - 0.5)
        emits, moves, starts, log10 = np.zeros(self.emit.shape), np.zeros_like(self.move), np.zeros(width), 0.0

        def forward(before: np.ndarray | None, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = live[t]
            seen = self.emit[flat[begins[:n] + t]]
            now = (self.start * seen) if before is None else (before[:n] @ self.move) * seen
            scale = now.sum(axis=1)
            now /= scale[:, None]
            return now, scale, seen

        marks, now = [], None
        for t in range(steps):
            if t % WAVE == 0:
                marks.append(None if now is None else now[:live[t]].copy())
            now, scale, _ = forward(now, t)
            log10 += float(np.log10(scale).sum())
        back = np.ones((0, width))
        for wave in reversed(range(len(marks))):
            first, last = wave * WAVE, min(steps, (wave + 1) * WAVE)
            made = [marks[wave]]
            for t in range(first, last):
                made.append(forward(made[-1] if t == first else made[-1][0], t))
            masses = []
            for t in reversed(range(first, last)):
                ahead, scale, seen = made[t - first + 1]
                after = np.ones(ahead.shape)
                after[:len(back)] = back
                masses.append(ahead * after)
                if t:
                    seen *= after
                    seen /= scale[:, None]
                    before = made[0] if t == first else made[t - first][0]
                    moves += before[:live[t]].T @ seen
                    back = seen @ self.move.T
                else:
                    starts += masses[-1].sum(axis=0)
            places = np.concatenate([flat[begins[:live[t]] + t] for t in reversed(range(first, last))])
            mass = np.concatenate(masses)
            for k in range(width):
                emits[:, k] += np.bincount(places, mass[:, k], len(emits))
        return starts, moves * self.move, emits, log10

    def log10_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each whole symbol sequence, by the scaled forward recursion, longest first side by side."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        total = np.zeros(len(texts))
        if not len(texts) or not sizes[0]:
            return total
        live = np.searchsorted(-sizes, -np.arange(sizes[0]) - 0.5)
        now = np.tile(self.start, (live[0], 1))
        flat, at = np.concatenate([texts[i] for i in order]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for t in range(sizes[0]):
            n = live[t]
            now = now[:n] if t == 0 else now[:n] @ self.move
            now = now * self.emit[flat[at[:n] + t]]
            scale = now.sum(axis=1)
            total[:n] += np.log10(scale)
            now /= scale[:, None]
        out = np.empty(len(texts))
        out[order] = total
        return out


def _side_by_side(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, begins, sizes) of texts of like length, in groups of bounded size."""
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        held = np.cumsum(sizes[order[at:at + SIDE_ROWS]])
        upto = at + max(1, int(np.searchsorted(held, SIDE_TOKENS, "right")))
        yield flat, offsets[order[at:upto]], sizes[order[at:upto]]
        at = upto


def train(encoded: DataFrame, symbols: int, states: int, rounds: int) -> Hmm:
    """Baum-Welch over all rows of ``encoded`` (column ``symbols``), each a whole text.

    Every task adds up its expected counts; they are summed per symbol by the engine, so the driver gets one row per symbol and state
    whatever the number of texts.
    """
    spark = encoded.sparkSession
    sums = [F.sum(F.col("g")[k]).alias(f"g{k}") for k in range(states)]

    def added(model: Hmm | None) -> dict[int, list[float]]:
        sent = spark.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hmm = sent.value
            rows = np.zeros((symbols + 1 + states, states))
            for batch in batches:
                if hmm is None:
                    rows[:symbols] += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=symbols)[:, None]
                    continue
                for flat, begins, sizes in _side_by_side(batch.column(0)):
                    start, move, emit, _ = hmm.counts(flat, begins, sizes)
                    rows[:symbols] += emit
                    rows[symbols] += start
                    rows[symbols + 1:] += move
            some = np.flatnonzero(rows.any(axis=1))
            lists = pa.ListArray.from_arrays(np.arange(0, some.size * states + 1, states, dtype=np.int32), pa.array(rows[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], names=["i", "g"])

        rows = encoded.select("symbols").mapInArrow(work, "i int, g array<double>").groupBy("i").agg(*sums).collect()
        return {r["i"]: list(r)[1:] for r in rows}

    def table(found: dict[int, list[float]], at: int, size: int, least: float) -> np.ndarray:
        return np.array([found.get(i, [0.0] * states) for i in range(at, at + size)]) + least

    first = table(added(None), 0, symbols, 0.1)[:, 0]
    model = Hmm.random(states, first / first.sum())
    for _ in range(rounds):
        found = added(model)
        emit, start, move = table(found, 0, symbols, 0.01), table(found, symbols, 1, 0.1)[0], table(found, symbols + 1, states, 0.1)
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def score_texts(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 8, rounds: int = 4, own_words: int = 20_000,
                sent_words: int = 150_000, classes: int = 256) -> DataFrame:
    """(id, is_training, n_tokens, n_known, train_tokens, base_score, score) per row.

    Tokens are the words and one end. The HMM emits symbols: the ``own_words`` most frequent words, ``classes`` classes of all other words by their last letters,
    and the end; a word has (count + 1) / (words + different words + 1) of its class. ``score`` is the log10 probability of the whole
    token sequence, a proper distribution over texts; ``base_score`` the sum of log10 ((count + 1) / (N + V + 1)) of the unigram counts.

    All counts come from the rows with ``is_training`` (null counts as false). The most frequent words (of at most 64 bytes, in steps of equal log count, ``sent_words`` at most) go to every task; other
    words are joined with their counts by word, after they are summed per text. A null or empty text has the end only. Without training rows every token has count 0.
    Training takes whole texts, of any length. Words of equal count go by their bytes. Repeated rows stay and count each; other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(is_training, F.lit(False)).alias("train"),
                       F.col(text_col).cast("binary").alias("raw"))
    counts = pin(count_words(rows.where("train"), classes))
    ends = rows.where("train").count()
    per_class = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    short = counts.where(F.length("word") <= SENT_BYTES).withColumn("step", F.floor(F.log2("n") * 16))
    least, room = None, sent_words
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    listed = short.where(F.col("step") >= F.lit(least)).select("word", "class", "n").collect()
    top = sorted(((bytes(r["word"]), r["class"], r["n"]) for r in listed), key=lambda x: (-x[2], x[0]))
    for word, c, n in top[:own_words]:
        per_class[c] = (per_class[c][0] - n, per_class[c][1] - 1)
    tokens = sum(n for n, _ in per_class.values()) + sum(n for _, _, n in top[:own_words]) + ends
    distinct = sum(v for _, v in per_class.values()) + len(top[:own_words]) + (ends > 0)
    log_class = np.array([np.log10(sum(per_class.get(c, (0, 0))) + 1) for c in range(classes)])
    lexicon = Lexicon(top, min(own_words, len(top)), log_class, ends)
    sent = spark.sparkContext.broadcast(lexicon)
    entry = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                got = [words.encode(raw.as_py()) for raw in piece.column("raw")]
                sizes = np.array([len(g[0]) for g in got])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.concatenate([g[0] for g in got])))
                others = pa.array([[{"word": w, "times": n} for w, n in g[4].items()] for g in got], entry)
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(3)), pa.array(sizes), *(pa.array([g[i] for g in got]) for i in (1, 2, 3)), lists, others],
                                                 names=["row", "id", "train", "n_tokens", "known", "base", "inside", "symbols", "others"])

    kind = f"row bigint, id {rows.schema['id'].dataType.simpleString()}, train boolean, n_tokens bigint, known bigint, base double, inside double, symbols array<int>"
    encoded = pin(rows.mapInArrow(encode, kind + ", others array<struct<word:binary,times:int>>"))
    model = spark.sparkContext.broadcast(train(encoded.where("train"), lexicon.symbols, states, rounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = model.value
        for batch in batches:
            lists = batch.column("symbols")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sizes, out = np.diff(offsets), np.empty(batch.num_rows)
            order = np.argsort(-sizes, kind="stable")
            for at in range(0, len(order), ROWS):
                own = order[at:at + ROWS]
                out[own] = hmm.log10_likelihood([flat[offsets[i]:offsets[i + 1]] for i in own])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), pa.array(out)], names=[*batch.schema.names[:7], "hmm"])

    scored = encoded.select("row", "id", "train", "n_tokens", "known", "base", "inside", "symbols").mapInArrow(
        score, kind.replace("symbols array<int>", "hmm double"))
    other = encoded.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    found = (other.join(counts.select("word", "n"), "word").groupBy("row")
             .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs")))
    joined = scored.join(found, "row", "left")
    logs, per_token = F.coalesce("logs", F.lit(0.0)), float(np.log10(tokens + distinct + 1))
    return joined.select(F.col("id").alias(id_col), F.col("train").alias("is_training"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                         F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("base") + logs - F.col("n_tokens") * per_token).alias("base_score"),
                         (F.col("hmm") + F.col("inside") + logs).alias("score"))
