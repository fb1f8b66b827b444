"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import vector_literal
from tessera.operators import ranking, relational
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import layout
from tessera.sources.readers import load_binary, load_csv, load_table, load_whole_text
from tessera.sources.writers import load_check, materialize_if_stale, save_csv, save_table


@query("load_table", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def q_load_table(spark, sf):
    return load_table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))


def text_files(spark, sf):
    """The documents as text files. The row limit bounds what one file, and so one row of a read, can hold."""
    path = scratch_path(spark, "documents-text")
    load_table(spark, sf, "documents").select("source", "text").write.option("maxRecordsPerFile", 10_000).partitionBy(
        "source").text(path)
    return path


@query("load_whole_text", """
SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars, true AS ids_unique FROM documents GROUP BY source""")
def q_load_whole_text(spark, sf):
    files = load_whole_text(spark, text_files(spark, sf), "*.txt")
    return files.select("unique_id", F.regexp_extract("file_name", r"source=([^/]+)", 1).alias("source"),
                        F.char_length("value").alias("chars")).groupBy("source").agg(
        F.sum("chars").alias("chars"), (F.count_distinct("unique_id") == F.count(F.lit(1))).alias("ids_unique"))


@query("load_whole_text_rows", """
SELECT source, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest, '.txt' AS ending, true AS id_fits FROM documents GROUP BY source""")
def q_load_whole_text_rows(spark, sf):
    """One file per source with its documents in order, read back as one row per file."""
    path = scratch_path(spark, "by-source")
    docs = load_table(spark, sf, "documents").select("source", "doc_id", "text").repartition("source").sortWithinPartitions("source", "doc_id")
    docs.select("source", "text").write.partitionBy("source").text(path)
    files = load_whole_text(spark, path, "*.txt")
    return files.select(F.regexp_extract("file_name", r"source=([^/]+)", 1).alias("source"), F.md5("value").alias("digest"),
                        F.regexp_extract("file_name", r"(\.[a-z]+)$", 1).alias("ending"), (F.col("unique_id") == F.md5("file_name")).alias("id_fits"))


@query("load_binary", """
SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS whole, true AS named FROM documents GROUP BY source""")
def q_load_binary(spark, sf):
    files = load_binary(spark, text_files(spark, sf), "*.txt")
    return files.groupBy(F.regexp_extract("path", r"source=([^/]+)", 1).alias("source")).agg(
        F.sum("length").alias("bytes"), F.bool_and(F.octet_length("content") == F.col("length")).alias("whole"),
        F.bool_and(F.col("filename").endswith(".txt")).alias("named"))


@query("load_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment
FROM customer""")
def q_load_csv(spark, sf):
    path = scratch_path(spark, "customer-csv")
    save_csv(load_table(spark, sf, "customer"), path)
    return load_csv(spark, path, drop=["c_acctbal"])


@query("take_matching", """
SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND length(text) < 3000 ORDER BY doc_id LIMIT 500""")
def q_take_matching(spark, sf):
    docs = load_table(spark, sf, "documents")
    short = (F.col("lang") == "en") & (F.char_length("text") < 3000)
    return ranking.take_matching(docs, short, 500, [F.col("doc_id")]).select("doc_id", "lang", "n_chars")


@query("take_matching_early", """
SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND length(text) < 3000 ORDER BY doc_id LIMIT 60""")
def q_take_matching_early(spark, sf):
    """The same over a table whose files follow the id: reading stops once the rows are certain."""
    path = scratch_path(spark, "by-id")
    load_table(spark, sf, "documents").repartitionByRange(32, "doc_id").write.parquet(path)
    short = (F.col("lang") == "en") & (F.char_length("text") < 3000)
    return layout.take_matching_early(spark, path, short, 60, "doc_id").select("doc_id", "lang", "n_chars")


@query("clustered_lookup", """
SELECT 'order' AS side, l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7
UNION ALL SELECT 'part', l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey = 42""")
def q_clustered_lookup(spark, sf):
    """One table clustered by two columns, looked up by either."""
    path = scratch_path(spark, "clustered")
    layout.save_clustered(load_table(spark, sf, "lineitem"), path, ["l_orderkey", "l_partkey"], 16, bloom=["l_orderkey", "l_partkey"])
    rows, columns = spark.read.parquet(path), ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    by = lambda c, v, name: relational.exact_lookup(rows, c, v, columns).select(F.lit(name).alias("side"), *columns)
    return by("l_orderkey", 7, "order").unionByName(by("l_partkey", 42, "part"))


@query("save_table", "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def q_save_table(spark, sf):
    path = scratch_path(spark, "documents")
    docs = load_table(spark, sf, "documents")
    english = F.col("lang") == "en"
    save_table(docs.where(english), path, "overwrite", ["lang"])
    save_table(docs.where(~english), path, "append", ["lang"])
    return spark.read.parquet(path).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query("save_csv", """
SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(label AS VARCHAR) AS label,
       CAST(len(embedding) AS INTEGER) AS dim FROM embeddings""")
def q_save_csv(spark, sf):
    path = scratch_path(spark, "embeddings-csv")
    save_csv(load_table(spark, sf, "embeddings"), path)
    back = load_csv(spark, path)
    return back.select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).alias("dim"))


@query("materialize_if_stale", """
SELECT 'created,kept,rebuilt' AS actions, count(*) AS rows, CAST(min(len(embedding)) AS INTEGER) AS dim
FROM embeddings""")
def q_materialize(spark, sf):
    path = scratch_path(spark, "embeddings")
    vectors = load_table(spark, sf, "embeddings")
    n = vectors.count()
    first = materialize_if_stale(spark, path, lambda: vectors, n, "embedding", 64)
    second = materialize_if_stale(spark, path, lambda: vectors, n, "embedding", 64)
    # A short table at the path must be noticed.
    short = scratch_path(spark, "embeddings-short")
    save_table(vectors.where("label <> 0"), short)
    third = materialize_if_stale(spark, short, lambda: vectors, n, "embedding", 64)
    return spark.read.parquet(short).agg(
        F.lit(",".join((first, second, third))).alias("actions"), F.count(F.lit(1)).alias("rows"),
        F.min(F.size("embedding")).alias("dim"))


SCALES = [10_000, 100_000, 1_000_000]


@query("scale_subset", " UNION ALL ".join(f"SELECT * FROM (SELECT CAST({n} AS INTEGER) AS scale, doc_id, lang FROM documents ORDER BY doc_id LIMIT {n})" for n in SCALES))
def q_scale_subset(spark, sf):
    return ranking.scale_subsets(load_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", SCALES)


@query("replicate_rows", """
SELECT copy_no, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents, (SELECT CAST(range AS INTEGER) AS copy_no FROM range(30)) GROUP BY copy_no""")
def q_replicate_rows(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "n_chars")
    return relational.replicate_rows(docs, 30).groupBy("copy_no").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


@query("export_partitions", """
SELECT CAST(doc_id % 8 AS INTEGER) AS part, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM documents GROUP BY 1""")
def q_export_partitions(spark, sf):
    path = scratch_path(spark, "export")
    parts = relational.export_partitions(load_table(spark, sf, "documents"), "doc_id", 8)
    save_table(parts, path, "overwrite", ["part"])
    return spark.read.parquet(path).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("vector_literal", """
SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',')
       || ']' AS literal FROM embeddings""")
def q_vector_literal(spark, sf):
    vectors = load_table(spark, sf, "embeddings")
    return vectors.select("vec_id", vector_literal(F.col("embedding").cast("array<double>")).alias("literal"))


@query("load_expected_rows_check", """
SELECT count(*) AS rows, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
       CAST(max(len(embedding)) AS INTEGER) AS max_dim, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS ok
FROM embeddings""")
def q_load_check(spark, sf):
    return load_check(load_table(spark, sf, "embeddings"), None, "embedding", 64)


@query("drop_wide_columns", "SELECT vec_id, label FROM embeddings")
def q_drop_wide(spark, sf):
    return relational.drop_wide_columns(load_table(spark, sf, "embeddings"))
