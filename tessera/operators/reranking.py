"""Found passages ranked again by their sentences, and cut by a strictness level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import rows_of
from tessera.functions.text import tokenize_words
from tessera.functions.vectors import RANK_DIGITS, matrix, unit_rows
from tessera.inference.models import ModelFactory
from tessera.operators.ranking import topk_per_group
from tessera.operators.retrieval import embed_text
from tessera.session import pin

#: Ends of sentences.
SENTENCE_END = r"[.!?]+[ \n]+|\n+"
#: Least score of a passage that stays, by level: 1 keeps every passage, 5 only those whose sentences fit the question closely.
STRICTNESS = {1: 0.0, 2: 0.1, 3: 0.2, 4: 0.3, 5: 0.4}


def sentences(text: Column) -> Column:
    """The sentences of a text; parts without a word are left out."""
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: F.size(tokenize_words(s)) > 0)


def _late_interaction(words: str, parts: str) -> Column:
    """Mean over the words of the best cosine that any part has with the word; 0 without words or parts."""
    @F.arrow_udf("double")
    def score(w: pa.Array, p: pa.Array) -> pa.Array:
        out = []
        for own, other in zip(w, p):
            a, b = (unit_rows(matrix(x.values)) if x.is_valid and len(x.values) else None for x in (own, other))
            out.append(0.0 if a is None or b is None else float(np.round((a @ b.T).max(axis=1).mean(), RANK_DIGITS)) + 0.0)
        return pa.array(out, pa.float64())

    return score(words, parts)


def semantic_rerank(found: DataFrame, passages: DataFrame, questions: DataFrame, model: ModelFactory, strictness: int = 3, id_col: str = "id", text: str = "text",
                    query_id: str = "query_id", question: str = "question") -> DataFrame:
    """(query_id, id, score, rank): the found (query_id, id) in the order of how well single sentences of the passage fit single words of the question.

    Each word of the question looks for its nearest sentence; the score is the mean of these cosines, 0 to 1 for vectors of counts. Rows below the level's
    least score go. Equal scores go by id. Only found passages are read and embedded, each once however many questions found it; sentence and word
    vectors stay with their passage and question, so no list of pairs of them is made.
    """
    if strictness not in STRICTNESS:
        raise ValueError(f"strictness is one of {sorted(STRICTNESS)}")
    pairs = pin(found.select("query_id", F.col("id")))
    # as many rows as were found, stored: the planner knows their size
    wanted = pairs.select("id").distinct()
    texts = passages.select(F.col(id_col).alias("id"), F.col(text).alias("_text")).join(wanted, "id", "left_semi")
    parts = rows_of(texts, ["id"], sentences(F.col("_text")), "_part", "_at")
    parts = embed_text(parts, "_part", model, out="_v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_s"))
    words = rows_of(questions.select(F.col(query_id).alias("query_id"), F.col(question).alias("_q")), ["query_id"], F.array_distinct(tokenize_words(F.col("_q"))), "_word", "_at")
    words = embed_text(words, "_word", model, out="_v").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_w"))
    met = pairs.join(parts.select("id", F.col("_s._v").alias("_s")), "id", "left").join(words.select("query_id", F.col("_w._v").alias("_w")), "query_id", "left")
    scored = met.select("query_id", "id", _late_interaction("_w", "_s").alias("score")).where(F.col("score") >= STRICTNESS[strictness])
    return topk_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("id")], 1 << 30)
