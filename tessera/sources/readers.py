"""Readers: named tables, whole text files, binary files and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import file_name
from tessera.session import spread


def load_table(spark: SparkSession, directory: str | None, name: str) -> DataFrame:
    """A Parquet table of a directory, or a table of the catalog if there is no directory."""
    if directory is None:
        return spark.table(name)
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def heavy_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table for work that is heavy per row: a file too small to split is spread over all cores."""
    return spread(load_table(spark, directory, name))


def load_whole_text(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file. The id is the md5 of the path, so a second read gives the same ids."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    source = F.col("_metadata.file_path")
    return reader.load(path).select(
        F.md5(source).alias("unique_id"), source.alias("file_name"), F.col("value"))


def load_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``path`` as rows; an empty match is an error, not an empty table."""
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))
    if files.select("path").isEmpty():
        raise ValueError(f"no file matches {glob} below {path}")
    return files.withColumn("filename", file_name(F.col("path"))).select(
        "path", "filename", "modificationTime", "length", "content")


def load_csv(spark: SparkSession, path: str, drop: list[str] | None = None, multi_line: bool | None = None) -> DataFrame:
    """CSV with header; unwanted columns dropped, everything read as text, column names kept.

    ``multi_line`` is for values that hold line feeds; a file then goes to one task, whatever its size. If it is not given, the lines are
    looked through first: files are split only if no line leaves a quote open.
    """
    if multi_line is None:
        plain = F.regexp_replace(F.regexp_replace("value", '""', ""), '(^|,)"[^"]*+"(?=,|$)', "$1")
        multi_line = not spark.read.text(path).where(plain.contains('"')).isEmpty()
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    return rows.drop(*(drop or []))
