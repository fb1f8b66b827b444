"""Documents to sections, chunks, contexts and transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.chunks import recursive_split, word_windows
from tessera.functions.core import rows_of
from tessera.functions.markup import drop_hidden, section_pieces, sections_of, visible_text
from tessera.functions.text import content_id

NO_CONTEXT = "INSUFFICIENT_INFORMATION"
#: Documents whose chunks a worker hands on at once.
PIECE_ROWS = 64
STATUS_DDL = "doc_parsed_contents map<string,string>, parser_status string"


def html_header_sections(df: DataFrame, id_col: str, html: str, levels: tuple[str, ...] = ("h2", "h3", "h4")) -> DataFrame:
    # The pieces are a column of their own, so the markup is read once per row.
    pieces = df.select(id_col, section_pieces(F.col(html), levels).alias("_pieces"))
    return rows_of(pieces, [id_col], sections_of(F.col("_pieces"), levels), "_s").select(id_col, "_s.*")


def document_to_text(df: DataFrame, content: str, parser: Callable[[], Callable[[bytes], list[str]]] | None = None,
                     out: str = "parsing") -> DataFrame:
    """Adds (doc_parsed_contents, parser_status). A document that cannot be read never fails the job.

    Without ``parser`` the content is HTML and stays in the JVM. ``parser`` is a factory called
    once per task; what it returns turns the bytes of one document into its pages.
    """
    if parser is None:
        text = F.col(content).cast("string")
        parsed = F.struct(
            F.when(text.isNotNull(), F.create_map(
                F.lit("num_pages"), F.lit("1"), F.lit("parsed_content"), visible_text(drop_hidden(text))))
            .otherwise(F.create_map(F.lit("num_pages"), F.lit(""), F.lit("parsed_content"), F.lit("")))
            .alias("doc_parsed_contents"),
            F.when(text.isNotNull(), F.lit("SUCCESS")).otherwise(F.lit("ERROR: no content")).alias("parser_status"))
        return df.withColumn(out, parsed)

    @F.pandas_udf(STATUS_DDL)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        read = parser()
        for batch in batches:
            rows = []
            for raw in batch:
                try:
                    pages = read(bytes(raw))
                    rows.append(({"num_pages": str(len(pages)), "parsed_content": "\n".join(pages)}, "SUCCESS"))
                except Exception as e:  # noqa: BLE001
                    rows.append(({"num_pages": "", "parsed_content": ""}, f"ERROR: {e}"))
            yield pd.DataFrame(rows, columns=["doc_parsed_contents", "parser_status"])

    return df.withColumn(out, parse.asNondeterministic()(F.col(content).cast("binary")))


def with_recursive_chunks(df: DataFrame, text: str, size: int, overlap: int,
                          counter: Callable[[], Callable[[str], int]] | None = None, out: str = "chunked") -> DataFrame:
    """Adds (chunked_text array, chunker_status); ``counter`` makes the length measure, once per task."""

    @F.pandas_udf("chunked_text array<string>, chunker_status string")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        measure = counter() if counter else len
        for batch in batches:
            # chunks go on in pieces, so a worker never holds those of a whole Arrow batch
            for at in range(0, max(len(batch), 1), PIECE_ROWS):
                rows = []
                for value in batch.iloc[at:at + PIECE_ROWS]:
                    try:
                        rows.append((recursive_split(value, size, overlap, measure), "SUCCESS"))
                    except Exception as e:  # noqa: BLE001
                        rows.append(([], f"ERROR: {e}"))
                yield pd.DataFrame(rows, columns=["chunked_text", "chunker_status"])

    return df.withColumn(out, split.asNondeterministic()(F.col(text)))


def recursive_chunk(df: DataFrame, id_col: str, text: str, size: int, overlap: int,
                    counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    chunked = with_recursive_chunks(df.select(id_col, text), text, size, overlap, counter)
    good = chunked.where(F.col("chunked.chunker_status") == "SUCCESS")
    return rows_of(good, [id_col], F.col("chunked.chunked_text"), "chunk", "chunk_no")


def window_chunk(df: DataFrame, id_col: str, text: str, size: int, overlap: int) -> DataFrame:
    return rows_of(df, [id_col], word_windows(F.col(text), size, overlap), "chunk", "chunk_no")


def chunk_rows(df: DataFrame, id_col: str, chunks: str) -> DataFrame:
    """One row per chunk. Equal texts share the md5 id; (id, chunk_no) is the unique key."""
    rows = rows_of(df, [id_col], F.col(chunks), "chunk", "chunk_no")
    return rows.withColumn("chunk_id", content_id(F.col("chunk")))


def dedup_by_hash(df: DataFrame, text: str, order_by: list[str]) -> DataFrame:
    """First row per content. The row limit per group runs before the shuffle, so a text with very many
    copies sends at most one row per task."""
    window = Window.partitionBy("_hash").orderBy(*order_by)
    hashed = df.withColumn("_hash", content_id(F.col(text)))
    return hashed.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_hash", "_n")


def passage_line(style: str, rank: Column, id_col: Column, text: Column, header: Column | None = None) -> Column:
    if style == "numbered":
        return F.concat(F.lit("["), rank.cast("string"), F.lit("] Id: "), id_col.cast("string"), F.lit("\nContent: "),
                        text, F.lit("\n"))
    if style == "passage":
        return F.concat(F.lit("Passage: "), text, F.lit("\n"))
    if style == "headings":
        return F.concat(F.lit("Headings: "), F.coalesce(header, F.lit("")), F.lit(", Content: "), text)
    if style == "plain":
        return text
    raise ValueError(f"unknown style {style}")


JOINERS = {"numbered": "\n---\n", "passage": "", "headings": "\n\n", "plain": "\n\n"}


def context_pack(ranked: DataFrame, query: str, rank: str, id_col: str, text: str, style: str = "numbered",
                 header: str | None = None, queries: DataFrame | None = None, score: str | None = None,
                 ids: str | None = None) -> DataFrame:
    """One context per query from its ranked passages (k rows each). Queries without any get a marker.

    ``score`` adds the number of passages and the sum of their scores; ``ids`` names a column for the
    passage ids in rank order.
    """
    line = passage_line(style, F.col(rank), F.col(id_col), F.col(text), F.col(header) if header else None)
    value = F.col(score) if score else F.lit(0.0)
    passage = F.struct(F.col(rank).alias("rank"), line.alias("line"), F.col(id_col).cast("string").alias("id"))
    rows = ranked.select(query, passage.alias("_p"), value.alias("_score"))
    packed = rows.groupBy(query).agg(F.array_sort(F.collect_list("_p")).alias("_all"),
                                     F.count(F.lit(1)).alias("passages"), F.sum("_score").alias("score_sum"))
    out = packed.select(query, F.array_join(F.col("_all.line"), JOINERS[style]).alias("context"),
                        *(["passages", "score_sum"] if score else []),
                        *([F.array_join("_all.id", ",").alias(ids)] if ids else []))
    if queries is None:
        return out
    return queries.select(query).join(out, query, "left").withColumn(
        "context", F.coalesce("context", F.lit(NO_CONTEXT)))


def transcript(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               part_turns: int = 10_000) -> DataFrame:
    """``role: text`` lines in turn order; a conversation of more than ``part_turns`` comes in parts."""
    line = F.concat(F.col(role), F.lit(": "), F.col(text))
    rows = turns.select(conv, F.floor(F.col(turn) / part_turns).alias("part"),
                        F.struct(F.col(turn).alias("turn"), line.alias("line")).alias("_t"))
    packed = rows.groupBy(conv, "part").agg(F.array_sort(F.collect_list("_t")).alias("_all"))
    return packed.select(conv, "part", F.array_join(F.col("_all.line"), "\n").alias("transcript"))


def message_text(content: Column, parts: Column | None = None) -> Column:
    """Plain content, or the text parts of a typed content list joined by a space."""
    if parts is None:
        return content
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.coalesce(content, F.array_join(texts, " "))


def last_user_message(turns: DataFrame, role: str | None = "user", conv: str = "conv_id", turn: str = "turn",
                      text: str = "text") -> DataFrame:
    """Last message of a role per conversation; ``role=None`` takes the last of any role."""
    rows = turns.where(F.col("role") == role) if role else turns
    return rows.groupBy(conv).agg(F.max_by(text, turn).alias("text"))
