"""From raw documents to a mixed, encoded training set.

Stages: language ID, one document per SimHash group, benchmark decontamination, mixing by source, token files. Each takes the rows
that the stage before it kept, as a Parquet table, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, language, mixing, simhash, token_files
from tessera.llm.queries import REST, TARGETS
from tessera.session import pin, scratch_path
from tessera.sources.readers import load_table

#: A document stays if its best language output is at least this, or half of one over the number of languages: a text that resembles a language
#: has one over that number at least (the outputs always add up to the same), one that resembles none has 0 (``KernelModel.outputs``).
MIN_SCORE = 0.25
#: SQL cannot express the language model, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def plain_names(docs: DataFrame) -> tuple[list[str], dict[str, str]]:
    """Names that clash with none of an operator's own, and the name that stands for each column."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    return names, dict(zip(docs.columns, names))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter or resemble no language of the labelled rows.

    Rows without a label train nothing. Without any labelled row nothing is known to judge by, so all texts with a letter stay. Repeated
    rows are judged alike, other columns go along as they are.
    """
    model = language.fit_language_model(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names, own = plain_names(docs)
    judged = language.predict_language(docs.toDF(*names), model, names, own["text"])
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= min(MIN_SCORE, 0.5 / len(model.langs)))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of fingerprints within three bits: the one with the smallest id, of equal ids the first row.

    Null and empty texts have fingerprint zero, so one of them stays. A row without an id stays only if its group has no other.
    """
    names, own = plain_names(docs)
    rows = pin(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
    keyed = rows.select(F.struct(F.col(own["doc_id"]).isNull().alias("n"), F.col(own["doc_id"]).alias("doc_id"), "_row").alias("key"), F.col(own["text"]).alias("text"))
    groups = simhash.simhash_groups(keyed, "key", "text", shingle=3, max_bits=3)
    kept = groups.where(F.col("key._row") == F.col("component_id._row")).select("key._row")
    return rows.join(kept, "_row", "left_semi").select(*names).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item stands; null and empty texts stay."""
    names, own = plain_names(docs)
    found = decontaminate.with_matches(docs.toDF(*names), load_table(spark, sf_dir, "benchmark"), text_col=own["text"], out="_matches")
    return found.where(F.size("_matches") == 0).select(*names).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, sorted in the interleaved order of the sources; unknown and null sources share the rest. Other columns go along."""
    names, own = plain_names(docs)
    mixed = mixing.mix(docs.toDF(*names), TARGETS, REST, own["doc_id"], own["source"])
    return mixed.orderBy("mix_position").select(*names).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in the order of the rows of the table ``docs`` was read from, and returns their digests.

    A frame that was not read from files is encoded in the order of its ids. A null text has the end id only.
    """
    import public_tokenizers

    path, order = scratch_path(spark, "corpus-tokens"), None
    try:
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
        docs = docs.select("doc_id", "text", part.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
        order = ["_part", "_file", "_index"]
    except AnalysisException:
        pass
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), order_cols=order)
    return token_files.token_digest(spark, path)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing", mixture), ("token files", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written below the shared folder and read again."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
