"""Language of a text by string kernels: n-gram presence, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.memory import give_back
from tessera.session import pin

#: A Unicode code point plus one takes this many bits in an n-gram key, so three fit in 63 bits without collisions.
BITS = 21
#: Rows of the sample are drawn evenly from this many hash classes per language, so no class gathers a language in one task.
CLASSES = 64
#: Numbers in one block of the presence matrix.
BLOCK = 1 << 21


#: A text resembles a language if it knows at least ``PART`` of the share of n-grams that all but ``LOW`` of the labelled texts of that
#: language reach. A language with fewer than ``LEAST_ROWS`` labelled rows is held against those of all languages.
PART, LOW, LEAST_ROWS = 0.6, 0.05, 10


def _runs(text: str, longest: int) -> list[np.ndarray]:
    """Keys of the n-grams of 1 to ``longest`` code points, as often as they occur."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    found, keys = [points], points
    for n in range(1, longest):
        if len(points) <= n:
            break
        keys = (keys[:-1] << BITS) | points[n:]
        found.append(keys)
    return found


def grams(text: str, longest: int = 3) -> np.ndarray:
    """Sorted keys of the different n-grams of 1 to ``longest`` (at most 3) code points of the lower-cased text."""
    return np.unique(np.concatenate(_runs(text, longest)))


@dataclass
class KernelModel:
    """Landmark n-grams, their incidence (n-gram x landmark, scaled to unit length) and the dual weights (landmark x language).

    ``owners`` has the language of every landmark, ``floors`` for every language the least share of known n-grams of a text that
    resembles it. Without them every text counts as resembling some language.
    """

    langs: list[str]
    vocabulary: np.ndarray
    incidence: np.ndarray
    weights: np.ndarray
    longest: int
    owners: np.ndarray | None = None
    floors: np.ndarray | None = None

    def known(self, text: str, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """(share of the text's longest n-grams, by occurrence, and number of all its n-grams that the landmarks of each language have, occurrences).

        N-grams with ASCII digits or signs tell no language and are left out; shares of occurrences do not hang on the length of
        the text as those of different n-grams do. ``without`` leaves out one landmark.
        """
        runs, size = _runs(text, self.longest), np.zeros(len(self.langs), np.int64)
        points = runs[0] - 1
        plain = (points >= 128) | ((points >= 97) & (points <= 122)) | (points == 32) | (points == 10)
        runs = [keys[np.logical_and.reduce([plain[i:len(keys) + i] for i in range(n + 1)])] for n, keys in enumerate(runs)]
        if "members" not in self.__dict__:
            self.members = np.stack([(self.incidence[:, self.owners == i] > 0).sum(axis=1, dtype=np.int32) for i in range(len(self.langs))], axis=1)
        hits = []
        for keys in (runs[-1], np.concatenate(runs[:-1])) if len(runs) > 1 else (runs[-1], runs[-1][:0]):
            places = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
            places, times = np.unique(places[self.vocabulary[places] == keys] if len(self.vocabulary) else places[:0], return_counts=True)
            have = self.members[places]
            if without >= 0:
                have = have - (self.incidence[places, without, None] > 0) * (np.arange(len(self.langs)) == self.owners[without])
            hits.append(times @ (have > 0) if len(places) else size)
        return hits[0] / max(1, len(runs[-1])), hits[0] + hits[1], len(runs[-1])

    def resembles(self, text: str) -> bool:
        """Whether the text reaches the floor of a language; the fewer n-grams it has, the more may be unknown, but not all."""
        shares, some, n = self.known(text)
        return bool(((some > 0) & (shares >= self.floors - 1 / np.sqrt(max(1, n)))).any())

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised presence kernel of every text with every landmark, as products of presence blocks and the incidence."""
        out = np.zeros((len(texts), self.incidence.shape[1]), np.float32)
        width = max(1, len(self.vocabulary))
        step = max(1, BLOCK // width)
        for at in range(0, len(texts), step):
            block = texts[at:at + step]
            seen, norms = np.zeros((len(block), width), np.float32), np.ones(len(block), np.float32)
            for i, text in enumerate(block):
                keys = grams(text, self.longest)
                if len(self.vocabulary):
                    places = np.minimum(np.searchsorted(self.vocabulary, keys), width - 1)
                    seen[i, places[self.vocabulary[places] == keys]] = 1
                norms[i] = np.sqrt(max(1, len(keys)))
            out[at:at + step] = seen @ self.incidence / norms[:, None]
        return out

    def outputs(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest outputs. Those of a row always add up to two less the languages, so the best alone rejects no text: where a text
        resembles no language, all are moved down until the best is -1."""
        out = self.kernel(texts) @ self.weights[:-1] + self.weights[-1]
        if self.floors is not None and len(self.langs):
            alien = [i for i, text in enumerate(texts) if not self.resembles(text)]
            out[alien] -= out[alien].max(axis=1, keepdims=True)
            out[alien] -= 1
        return out


def _landmarks(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    sets = [grams(t, longest) for t in texts]
    vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
    incidence = np.zeros((max(1, len(vocabulary)), len(sets)), np.float32)
    for j, keys in enumerate(sets):
        incidence[np.searchsorted(vocabulary, keys), j] = 1 / np.sqrt(max(1, len(keys)))
    return vocabulary, incidence


def fit_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                       sample_per_label: int = 512, landmarks: int = 96, landmark_chars: int = 4_000, ridge: float = 1e-2,
                       longest: int = 3) -> KernelModel:
    """Fits on a bounded sample: about ``sample_per_label`` rows per label, ``landmarks`` of them as landmarks.

    The sample is the rows with the smallest id hashes, drawn evenly from hash classes, so it is the same in every run.
    Landmarks are rows of at most ``landmark_chars``; a label with too few of these has the middles of longer rows too, so every
    label has landmarks (their table is kept by every task; the fit itself is on whole texts). Rows with a letter come first. Rows
    without text or label are left out; rows that repeat an id come together. Every task adds up its part of the normal equations; only these
    matrices (landmarks x landmarks) reach the driver, and one share of known n-grams per sampled row, for the floors of the languages;
    a landmark is held against the others. Without labelled rows the model knows no language.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null and label is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    ids = rows.select("id", "label", "h").distinct()
    ranked = ids.selectExpr("id", "label", "h", f"pmod(h, {CLASSES}) class").selectExpr(
        "id", "label", "row_number() over (partition by label, class order by h, id) n")
    chosen = ranked.where(F.col("n") <= -(-sample_per_label // CLASSES)).select("id", "label")
    sample = pin(rows.join(F.broadcast(pin(chosen)), ["id", "label"], "left_semi"))
    langs = [r[0] for r in sample.select("label").distinct().orderBy("label").collect()]
    each = max(1, landmarks // max(1, len(langs)))
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - landmark_chars) / 2) + 1).cast("int"), F.lit(landmark_chars))
    parts = sample.select("label", "h", "id", middle.alias("text"), (F.length("text") > landmark_chars).alias("cut"))
    ordered = parts.selectExpr("label", "text", r"row_number() over (partition by label order by not text rlike '\\p{L}', cut, h, id, text) n")
    listed = ordered.where(F.col("n") <= each).orderBy("label", "n").collect()
    marks, owners = [r["text"] for r in listed], np.array([langs.index(r["label"]) for r in listed], np.int64)
    vocabulary, incidence = _landmarks(marks, longest)
    if not langs:
        return KernelModel([], vocabulary, incidence, np.zeros((len(marks) + 1, 0), np.float32), longest)
    gram = incidence.T.astype(np.float64) @ incidence
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-8 * values[-1]
    features = vectors[:, kept] / np.sqrt(values[kept])
    model = spark.sparkContext.broadcast((KernelModel(langs, vocabulary, incidence, np.zeros((0, 0)), longest, owners), features, marks))
    size = features.shape[1] + 1

    def cut(text: str) -> str:
        return text[(len(text) - landmark_chars) // 2:][:landmark_chars] if len(text) > landmark_chars else text

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, nystrom, marks = model.value
        place = {v: i for i, v in enumerate(known.langs)}
        left, right = np.zeros((size, size)), np.zeros((size, len(place)))
        own, shares = [], []
        mark = {(known.owners[j], text): j for j, text in enumerate(marks)}
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            phi = np.hstack([known.kernel(texts) @ nystrom, np.ones((len(texts), 1))])
            want = -np.ones((len(texts), len(place)))
            want[np.arange(len(texts)), [place[v] for v in labels]] = 1
            left += phi.T @ phi
            right += phi.T @ want
            for text, label in zip(texts, labels):
                if any(c.isalpha() for c in text):
                    at = place[label]
                    own.append(at)
                    shares.append(known.known(text, mark.get((at, cut(text)), -1))[0][at])
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()]), pa.array([own], pa.list_(pa.int32())), pa.array([shares], pa.list_(pa.float64()))],
                                         names=["left", "right", "own", "shares"])

    left, right = np.zeros((size, size)), np.zeros((size, len(langs)))
    few = sample.select("label", "text").repartition(min(8, max(1, len(langs))), F.xxhash64("text"))
    own, shares = [], []
    for row in few.mapInArrow(sums, "left binary, right binary, own array<int>, shares array<double>").toLocalIterator():
        own += row["own"]
        shares += row["shares"]
        left += np.frombuffer(row["left"]).reshape(size, size)
        right += np.frombuffer(row["right"]).reshape(size, len(langs))
    penalty = ridge * np.eye(size)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(left + penalty, right)
    weights = np.vstack([features @ solved[:-1], solved[-1:]]).astype(np.float32)
    own, shares = np.array(own, np.int64), np.array(shares)
    per_lang = [shares[own == i] if (own == i).sum() >= LEAST_ROWS else shares for i in range(len(langs))]
    floors = np.array([PART * np.quantile(x, LOW) if len(x) else 0.0 for x in per_lang])
    return KernelModel(langs, vocabulary, incidence, weights, longest, owners, floors)


def predict_language(docs: DataFrame, model: KernelModel, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with ``lang_pred`` and ``score`` (the best one-versus-rest output, from -1..1 to 0..1) of every whole text.

    A null text, a text without any letter and every text under a model without languages give ``und`` and 0. A text that resembles
    no language has score 0 with the label of the best output. Ties go to the first label in sorted order. Rows stay as they are, repeated ones too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_k{i}" for i in range(len(id_cols))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(id_cols, names)],
                       F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = batch.column(len(names))
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            at = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            for part in np.array_split(at, -(-len(at) // 256)) if len(at) and known.langs else []:
                out = known.outputs([texts[int(i)].as_py() for i in part])
                best = out.argmax(axis=1)
                pred[part] = [known.langs[i] for i in best]
                score[part] = np.clip((out[np.arange(len(part)), best] + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])
        give_back()

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(work, ", ".join([kinds, "lang_pred string, score double"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(id_cols, names)], "lang_pred", "score")
