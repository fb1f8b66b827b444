import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.inference.models import HashedEmbedder
from tessera.operators import reranking

MODEL = HashedEmbedder(64)
PASSAGES = [(1, "Red tower. The lake is deep and cold!\nNobody swims"), (2, "A tower by the lake"), (3, ""), (4, None), (5, "... !"), (6, "tower tower tower tower lake")]
QUESTIONS = [(10, "tower lake"), (11, "deep lake deep"), (12, ""), (13, None)]


def slow(question, text):
    embed = MODEL()
    import re
    parts = [p for p in re.split(r"[.!?]+[ \n]+|\n+", text or "") if re.search(r"\w", p)]
    words = list(dict.fromkeys(re.findall(r"\w+", (question or "").lower())))
    if not parts or not words:
        return 0.0
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    a, b = (unit(np.array(embed(x), dtype="float64")) for x in (words, parts))
    return float(np.round((a @ b.T).max(axis=1).mean(), 9))


def test_scores_ranks_and_levels(spark):
    passages, questions = spark.createDataFrame(PASSAGES, "id bigint, text string"), spark.createDataFrame(QUESTIONS, "query_id bigint, question string")
    pairs = [(q, p) for q, _ in QUESTIONS for p, _ in PASSAGES if (q, p) != (10, 2)] + [(10, 99)]
    found = spark.createDataFrame(pairs, "query_id bigint, id bigint")
    texts, asked = dict(PASSAGES), dict(QUESTIONS)
    for level, least in reranking.STRICTNESS.items():
        want = {}
        for q, p in pairs:
            s = slow(asked[q], texts.get(p))
            if s >= least:
                want.setdefault(q, []).append((-s, p))
        got = {}
        for r in reranking.semantic_rerank(found, passages.withColumn("_s", F.lit(1)), questions, MODEL, level).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["id"]))
        assert got == {q: sorted(v) for q, v in want.items()}
    with pytest.raises(ValueError):
        reranking.semantic_rerank(found, passages, questions, MODEL, 6)
    assert reranking.semantic_rerank(found.limit(0), passages, questions, MODEL, 1).count() == 0
