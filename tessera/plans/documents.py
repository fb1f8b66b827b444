"""Queries over document preparation and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.chunks import word_windows
from tessera.functions.core import rows_of
from tessera.functions.markup import BLOCK_TAGS, DROPPED, ENTITIES
from tessera.operators import documents, ranking, retrieval
from tessera.plans import sqltext
from tessera.plans.registry import query
from tessera.sources.readers import heavy_table, load_table

TERMS = "the reshen onthe und"


def visible_sql(expr: str) -> str:
    """The text rule of ``visible_text`` in SQL."""
    out = f"regexp_replace({expr}, '{BLOCK_TAGS}', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for name, char in ENTITIES.items():
        out = f"replace({out}, '&{name};', chr({ord(char)}))"
    out = f"regexp_replace({out}, '[ \\t\\r\\f]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return sqltext.strip(out)


def hidden_sql(expr: str) -> str:
    for pattern in DROPPED:
        expr = f"regexp_replace({expr}, '{pattern}', '', 'g')"
    return expr


@query("html_header_sections", f"""
WITH m AS (SELECT page_id, string_split(regexp_replace({hidden_sql('html')},
        '(?is)<h1(?: [^>]*)?>(.*?)</h1>', chr(1) || '0\\1' || chr(2), 'g'), chr(1)) AS p FROM pages),
 e AS (SELECT page_id, unnest(range(len(p))) AS i, p FROM m)
SELECT page_id, CAST(i AS INTEGER) AS sec_no,
       CASE WHEN i = 0 THEN '' ELSE {visible_sql("substr(string_split(p[i + 1], chr(2))[1], 2)")} END AS header_1,
       md5(CASE WHEN i = 0 THEN {visible_sql("p[1]")} ELSE {visible_sql("string_split(p[i + 1], chr(2))[2]")} END) AS digest
FROM e""")
def q_html_sections(spark, sf):
    out = documents.html_header_sections(heavy_table(spark, sf, "pages"), "page_id", "html", ("h1",))
    return out.select("page_id", "sec_no", "header_1", F.md5("content").alias("digest"))


@query("document_to_text", f"""
SELECT page_id, 'SUCCESS' AS status, '1' AS num_pages, md5({visible_sql(hidden_sql('html'))}) AS digest FROM pages""")
def q_document_to_text(spark, sf):
    raw = heavy_table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    out = documents.document_to_text(raw, "content")
    contents = F.col("parsing.doc_parsed_contents")
    return out.select("page_id", F.col("parsing.parser_status").alias("status"),
                      contents["num_pages"].alias("num_pages"), F.md5(contents["parsed_content"]).alias("digest"))


@query("recursive_chunk")
def q_recursive_chunk(spark, sf):
    docs = heavy_table(spark, sf, "documents")
    out = documents.recursive_chunk(docs, "doc_id", "text", 500, 50)
    return out.select("doc_id", "chunk_no", F.char_length("chunk").alias("chars"), F.md5("chunk").alias("chunk_id"))


COVER_SQL = """SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\r\\f]+', '', 'g')) AS digest, true AS fits FROM documents"""


def cover(chunks):
    """Per document: its chunks in order without white space, and whether each fits."""
    packed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("all"),
                                          (F.max(F.char_length("chunk")) <= 500).alias("fits"))
    joined = F.regexp_replace(F.array_join("all.chunk", ""), r"[ \t\n\r\f]+", "")
    return packed.select("doc_id", F.md5(joined).alias("digest"), "fits")


@query("recursive_chunk_cover", COVER_SQL)
def q_recursive_cover(spark, sf):
    """Without overlap the chunks hold every character of the text once, in order."""
    docs = heavy_table(spark, sf, "documents")
    return cover(documents.recursive_chunk(docs, "doc_id", "text", 500, 0))


@query("window_chunk", f"""
WITH {sqltext.chunks('c', 'documents', 'doc_id', 'text', 50, 10)}
SELECT key AS doc_id, chunk_no, md5(chunk) AS digest FROM c""")
def q_window_chunk(spark, sf):
    out = documents.window_chunk(heavy_table(spark, sf, "documents"), "doc_id", "text", 50, 10)
    return out.select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


@query("chunk_rows", f"""
WITH {sqltext.chunks('c', 'documents', 'doc_id', 'text', 200, 0)}
SELECT key AS doc_id, chunk_no, md5(chunk) AS chunk_id, length(chunk) AS chars FROM c""")
def q_chunk_rows(spark, sf):
    docs = heavy_table(spark, sf, "documents").select("doc_id", word_windows(F.col("text"), 200, 0).alias("chunks"))
    out = documents.chunk_rows(docs, "doc_id", "chunks")
    return out.select("doc_id", "chunk_no", "chunk_id", F.char_length("chunk").cast("bigint").alias("chars"))


@query("dedup_by_hash", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def q_dedup(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "text")
    return documents.dedup_by_hash(docs, "text", ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query("section_carry_forward", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
           FROM documents),
 h AS (SELECT doc_id, pos, CASE WHEN length(line) < 80 THEN md5(line) END AS header FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section
FROM h""")
def q_section_carry(spark, sf):
    lines = rows_of(heavy_table(spark, sf, "documents"), ["doc_id"], F.split("text", "\n"), "line", "pos")
    marked = lines.select("doc_id", "pos", F.when(F.char_length("line") < 80, F.md5("line")).alias("header"))
    return ranking.section_carry_forward(marked, "doc_id", "pos", "header", block=50).select("doc_id", "pos", "section")


@query("context_pack", """
WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
           FROM documents QUALIFY rank <= 6),
 q AS (SELECT DISTINCT url AS source FROM pages UNION SELECT DISTINCT source FROM documents)
SELECT q.source, md5(coalesce(string_agg('[' || rank || '] Id: ' || doc_id || chr(10) || 'Content: ' || text || chr(10),
       chr(10) || '---' || chr(10) ORDER BY rank), 'INSUFFICIENT_INFORMATION')) AS digest
FROM q LEFT JOIN r USING (source) GROUP BY 1""")
def q_context_pack(spark, sf):
    docs = load_table(spark, sf, "documents").select("source", "doc_id", "text", "n_chars")
    ranked = ranking.topk_per_group(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 6)
    # Page addresses have no documents, so they show the marker for an empty result.
    asked = load_table(spark, sf, "pages").select(F.col("url").alias("source")).unionByName(docs.select("source")).distinct()
    out = documents.context_pack(ranked, "source", "rank", "doc_id", "text", "numbered", queries=asked)
    return out.select("source", F.md5("context").alias("digest"))


@query("transcript", """
SELECT conv_id, CAST(0 AS BIGINT) AS part, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest
FROM conversations GROUP BY 1""")
def q_transcript(spark, sf):
    out = documents.transcript(load_table(spark, sf, "conversations"))
    return out.select("conv_id", "part", F.md5("transcript").alias("digest"))


@query("last_user_message", """
SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1""")
def q_last_user(spark, sf):
    return documents.last_user_message(load_table(spark, sf, "conversations"))


@query("last_message", "SELECT conv_id, max_by(text, turn) AS text FROM conversations GROUP BY 1")
def q_last_any(spark, sf):
    return documents.last_user_message(load_table(spark, sf, "conversations"), role=None)


@query("chunk_retrieval", f"""
WITH {sqltext.chunks('c', 'documents', 'doc_id', 'text', 50, 10)},
 keyed AS (SELECT key * 1000000 + chunk_no AS key, md5(chunk) AS chunk_id, chunk FROM c),
 {sqltext.bm25('b', 'keyed', 'key', 'chunk', TERMS.split())},
 r AS (SELECT key, score, chunk_id, chunk, row_number() OVER (ORDER BY score DESC, key) AS rank
       FROM b JOIN keyed USING (key) QUALIFY rank <= 10)
SELECT '{TERMS}' AS question, count(*) AS passages, round(sum(score), 6) AS score_sum,
       string_agg('[' || rank || '] Id: ' || chunk_id || chr(10) || 'Content: ' || chunk || chr(10),
                  chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r""")
def q_chunk_retrieval(spark, sf):
    """Documents to chunks, best chunks for a question, one context."""
    docs = heavy_table(spark, sf, "documents").select("doc_id", "text")

    def chunks(rows):
        cut = rows.select("doc_id", word_windows(F.col("text"), 50, 10).alias("chunks"))
        return documents.chunk_rows(cut, "doc_id", "chunks").withColumn(
            "key", F.col("doc_id") * 1_000_000 + F.col("chunk_no"))

    best = retrieval.keyword_topk(chunks(docs), TERMS, 10, "key", "chunk").drop("total")
    # Ten rows; only their documents are cut again.
    wanted = F.broadcast(best.withColumn("doc_id", F.floor(F.col("key") / 1_000_000)))
    found = chunks(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")).join(
        wanted.drop("doc_id"), "key")
    ranked = ranking.topk_per_group(found.withColumn("question", F.lit(TERMS)), ["question"],
                                    [F.col("score").desc(), F.col("key")], 10)
    contexts = documents.context_pack(ranked, "question", "rank", "chunk_id", "chunk", score="score")
    return contexts.withColumn("score_sum", F.round("score_sum", 6))
