"""Answers from retrieved rows: labels by examples, and questions answered from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import compose_prompt
from tessera.inference.models import ModelFactory
from tessera.inference.runner import ai_query
from tessera.operators.documents import context_pack
from tessera.operators.ranking import topk_per_group
from tessera.operators.retrieval import embed_text, knn_join
from tessera.session import pin


def label_by_examples(rows: DataFrame, examples: DataFrame, k: int, id_col: str = "id", label: str = "label",
                      vector: str = "embedding") -> DataFrame:
    """(id, label, votes): the majority label of the k nearest examples; equal votes go to the smaller label."""
    queries = rows.select(F.col(id_col).alias("query_id"), F.col(vector).alias("embedding"))
    # Stored, so the sample is drawn once and the planner knows how small it is.
    known = pin(examples.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding")))
    near = knn_join(queries, known, k, exclude_self=True)
    votes = near.join(known.select("id", "label"), "id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = topk_per_group(votes, ["query_id"], [F.col("votes").desc(), F.col("label")], 1)
    return best.select(F.col("query_id").alias(id_col), "label", "votes")


def rag_answer(questions: DataFrame, corpus: DataFrame, k: int, template: str, embedder: ModelFactory, model: ModelFactory,
               question_id: str = "item_id", doc_id: str = "doc_id", near: DataFrame | None = None) -> DataFrame:
    """Questions to k nearest documents, one context each, a prompt and the model's answer, as one job.

    Adds ``ids`` (documents in rank order), ``context``, ``prompt`` and ``answer``. A question without
    any document gets the marker for an empty context. ``near`` (query_id, id, rank) takes the place of the vector search.
    """
    asked = questions.withColumn("query_id", F.col(question_id))
    if near is None:
        # Stored, because the search counts and loads the questions: the embedder reads each of them once.
        asked = pin(embed_text(asked, "question", embedder))
        near = knn_join(asked, embed_text(corpus, "text", embedder).withColumn("id", F.col(doc_id)), k)
    # k rows per question, stored: the planner knows their size, and few rows spare the documents a shuffle.
    near = pin(near)
    ranked = corpus.join(near.withColumnRenamed("id", doc_id), doc_id)
    contexts = context_pack(ranked, "query_id", "rank", doc_id, "text", queries=asked, ids="ids")
    prompt = compose_prompt(template, context=F.col("context"), question=F.col("question"))
    return ai_query(asked.join(contexts, "query_id").withColumn("prompt", prompt), "prompt", model, "answer")
