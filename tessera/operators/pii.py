"""Personal data over tables of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import pii
from tessera.functions.core import rows_of
from tessera.functions.responses import is_json
from tessera.operators.aggregates import parse_sums, prf_sums, with_micro

OUTPUT_DDL = ("has_pii boolean, entities array<struct<entity_type string, original_value string, salt_id string>>")


def pii_detect(df: DataFrame, text: str, detectors: tuple[pii.Detector, ...] = pii.DETECTORS,
               out: str = "entities") -> DataFrame:
    return df.withColumn(out, pii.detect(F.col(text), detectors))


def pii_salt(df: DataFrame, entities: str = "entities") -> DataFrame:
    return df.withColumn(entities, pii.with_salt_ids(F.col(entities)))


def entity_numbering(entities: DataFrame, doc: str, kind: str, value: str, pos: str) -> DataFrame:
    """Adds ``salt_id`` to entity rows: numbered by first position within (document, type)."""
    first = entities.groupBy(doc, kind, value).agg(F.min(pos).alias("_first"))
    rank = F.dense_rank().over(Window.partitionBy(doc, kind).orderBy("_first", value))
    ids = first.select(doc, kind, value, F.format_string("%s_%03d", F.col(kind), rank).alias("salt_id"))
    return entities.join(ids, [doc, kind, value])


def pii_result_table(df: DataFrame, id_col: str, doc_type: str, text: str, raw: str, truth: str, model_id: str,
                     tokens: Column | None = None) -> DataFrame:
    """Model output (JSON text in ``raw``) to one result row per document.

    An answer that is no JSON, or breaks its schema, leaves the text as it is and counts no entities.
    """
    parsed = df.withColumn("_out", F.from_json(raw, OUTPUT_DDL))
    entities = F.col("_out.entities")
    fits = is_json(F.col(raw)) & F.col("_out.has_pii").isNotNull() & F.coalesce(
        F.forall(entities, lambda e: e["entity_type"].isin(*pii.ENTITY_TYPES) & e["original_value"].isNotNull()
                 & e["salt_id"].isNotNull()), F.lit(False))
    ok = F.coalesce(fits, F.lit(False))
    marked = parsed.withColumn("_ok", ok)
    good = F.col("_ok")
    return marked.select(
        id_col, F.lit(model_id).alias("model_id"), F.col(doc_type).alias("document_type"), F.col(text).alias("input_text"),
        F.when(good, pii.mask(F.col(text), entities)).otherwise(F.col(text)).alias("masked_text"),
        (good & F.coalesce(F.col("_out.has_pii"), F.lit(False))).alias("has_pii"),
        F.when(good, F.size(entities)).otherwise(0).alias("num_entities"),
        F.when(good, F.to_json(entities)).otherwise(F.lit("[]")).alias("entities_json"),
        F.size(truth).alias("gt_count"),
        (tokens if tokens is not None else F.lit(None).cast("int")).alias("output_tokens"), good.alias("parse_ok"),
        F.when(good, entities).otherwise(F.from_json(F.lit("[]"), "array<struct<entity_type string, original_value string, salt_id string>>"))
        .alias("entities"), F.col(truth).alias("truth"))


def pii_doc_scores(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Adds tp, fp, fn, precision, recall and f1 per document."""
    matched = df.withColumn("_m", pii.match(F.col(predicted), F.col(truth))).select("*", "_m.tp", "_m.fp", "_m.fn").drop("_m")
    return matched.withColumns(pii.document_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def pii_report(doc_scores: DataFrame) -> DataFrame:
    """One row: pooled and averaged scores, parse counts and entity sums, in one pass.

    Needs (tp, fp, fn, precision, recall, f1, parse_ok, num_entities, gt_count).
    """
    return with_micro(doc_scores.agg(*prf_sums(), *parse_sums()))


def counts_by_type(results: DataFrame, entities: str = "entities") -> DataFrame:
    kinds = rows_of(results, [], F.col(f"{entities}.entity_type"), "entity_type")
    return kinds.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
