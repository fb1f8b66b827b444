"""Registered queries of this subpackage with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, forest, hmm, infill, language, licenses, lines, mixing, negatives, pieces, simhash, token_files, urls
from tessera.session import scratch_path
from tessera.sources.readers import load_table


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_language_model(docs.where(_crc_mod(5) != 0))
    found = language.predict_language(docs, model, ["doc_id"])
    return found.select("doc_id", (_crc_mod(5) == 0).alias("held_out"), "lang_pred", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest_neighbours(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_digest(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_matches(docs, load_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.score", "m.overlap")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(load_table(spark, sf_dir, "documents"))


def op7_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    scored = hmm.score_texts(docs, F.coalesce(_crc_mod(7) != 2, F.lit(True)))
    return scored.select("doc_id", (~F.col("is_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row"))
    kept = lines.drop_repeated_lines(docs, row_col="row", min_chars=60)
    return kept.select("doc_id", "n_lines", "n_removed", "longest_run", F.md5("text").alias("kept_md5"))


OP8_SQL = """
with cut as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null),
whole as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
spans as (select doc_id, pos, h, array_to_string(ls[pos + 1:pos + h], chr(10)) as body, length(array_to_string(ls[pos + 1:pos + h], '')) as chars
  from (select doc_id, ls, unnest(range(len(ls))) as pos from whole) join (select 2 ** k as h from range(1, 16) t(k)) on pos + h <= len(ls)),
copies as (select doc_id, pos, h, chars, row_number() over (partition by h, body order by doc_id, pos) > 1 as later from spans),
covered as (select distinct doc_id, unnest(range(pos, (pos + h)::bigint)) as pos from copies where later and chars >= 60),
marked as (select *, row_number() over (partition by line order by doc_id, pos) > 1 and length(line) >= 60 as later1 from cut),
gone as (select m.*, later1 or c.pos is not null as gone_too from marked m left join covered c using (doc_id, pos)),
runs as (select *, pos - row_number() over (partition by doc_id, gone_too order by pos) as island from gone),
longest as (select doc_id, max(n) as n from (select doc_id, count(*) as n from runs where gone_too group by doc_id, island) group by doc_id),
docs as (select doc_id, count(*) as n_lines, count(*) filter (gone_too) as n_removed, string_agg(line, chr(10) order by pos) filter (not gone_too) as kept from gone group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(longest.n, 0)::bigint as longest_run,
  case when d.text is not null then md5(coalesce(kept, '')) end as kept_md5
from documents d left join docs using (doc_id) left join longest using (doc_id)
"""

#: Target shares of the sources; the rest is shared by all other sources and rows without one.
TARGETS = {"src0": 0.1} | {f"src{i}": 0.045 for i in range(1, 20)}
REST = 0.045


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, TARGETS, REST)


#: Verdict, host and path start.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(load_table(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = r"""
with recursive parts as (select page_id, url, html, position('://' in url) as cut from pages),
split as (select page_id, url, html, case when cut > 0 then substr(url, cut + 3) else '' end as tail, coalesce(cut, 0) > 0 as ok from parts),
page as (select page_id, url, html, ok, coalesce(translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') as path, case when ok then regexp_replace(regexp_replace(translate(regexp_extract(url, '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) end as node from split),
tag as (select node, url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical["'']?[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as t from page where ok
  union all select node, url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh["'']?[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) from page where ok),
target as (select node, replace(t, '&amp;', '&') as t, regexp_extract(url, '^[^/?#]*://[^/?#]*') as origin, regexp_extract(url, '^[^?#]*') as base, regexp_extract(url, '^[^/?#]*:') as scheme
  from tag where t <> '' and not starts_with(t, '#')),
whole as (select node, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then scheme || t
  when starts_with(t, '/') then origin || t when starts_with(t, '?') then base || t when base = origin then origin || '/' || t else regexp_extract(base, '^.*/') || t end as b from target),
edge as (select distinct node as a, regexp_replace(regexp_replace(translate(regexp_extract(b, '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || regexp_extract(b, '(?s)^.*?://[^/?#]*([^#]*)', 1) as b from whole),
pair as (select a, b from edge union select b, a from edge),
reach as (select a, b from pair union select reach.a, pair.b from reach join pair on reach.b = pair.a),
rules(verdict, site, begins) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
node_parts as (select distinct b as node, translate(regexp_extract(substr(b, position('://' in b) + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(b, position('://' in b) + 3), '^[^/?#]*([^?#]*)', 1) as path from reach where position('://' in b) > 0),
node_rule as (select node, arg_max(verdict, length(site) + length(begins)) as verdict from node_parts, rules
  where (host = site or ends_with(host, '.' || site)) and starts_with(path, begins) group by node),
alias as (select reach.a as node, bool_or(node_rule.verdict = 'allow') as allow from reach join node_rule on reach.b = node_rule.node group by reach.a),
page_rule as (select page_id, arg_max(site || begins, length(site) + length(begins)) as rule, arg_max(verdict, length(site) + length(begins)) as verdict from page, rules
  where (host = site or ends_with(host, '.' || site)) and starts_with(path, begins) group by page_id)
select page.page_id, page.host, page.path, page_rule.rule, coalesce(page_rule.verdict, case when alias.allow = false then 'block' else 'allow' end) as verdict
from page left join page_rule using (page_id) left join alias on alias.node = page.node
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
with fine as (select distinct vec_id, case when vec_id % 7 = 0 then ((label + 1) % 10 + 10) % 10 else label end as label,
    list_transform(embedding, lambda v: floor(256 * v::double)) as x from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
used as (select * from fine qualify row_number() over (partition by vec_id order by label, x) = 1),
scored as (select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, list_inner_product(a.x, r.x)::bigint as score
  from used a join used r on len(a.x) = len(r.x) and a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
positive as (select anchor_id, id, score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id)::int as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from positive p join scored n on p.anchor_id = n.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
"""


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode_pieces(load_table(spark, sf_dir, "documents").select("doc_id", "text"), model, packed=True)
    read = pieces.decode_pieces(coded.select("doc_id", "ids"), model)
    return read.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(load_table(spark, sf_dir, "documents"))
    text = infill.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
                       F.sha2(F.encode(text, "UTF-8"), 256).alias("restored_sha256"))


OP13_SQL = """
with hashed as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
cut as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as tokens, ('0x' || d[1:8])::bigint as h1,
  ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from hashed),
placed as (select *, len(tokens) as n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
    when h4 % 100 < 20 then 'spm' else 'psm' end as form from cut),
parts as (select *, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:], '') as suffix from placed)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from parts
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_nearest, op3_token_ids, op4_decontamination, op5_license_scan, op6_simhash, op7_hmm_score, op8_line_dedup, op9_mixing, op10_url_filter,
    op11_hard_negatives, op12_sentencepiece, op13_fill_in_middle)}
ORACLES = {"op8_line_dedup": OP8_SQL, "op10_url_filter": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
