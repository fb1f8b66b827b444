"""Block and allow rules for urls, carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.graph import components
from tessera.llm.tables import parameter_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical["']?[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(urls: DataFrame, url_col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``urls`` with ``_host``, ``_path`` and ``_rule``, the struct (size, allow, rule) of the longest fitting rule or null.

    Rules meet the different hosts by host suffix, so the work does not grow with rules times urls. At equal length allow wins,
    then the greater text.
    """
    spark = urls.sparkSession
    listed = parameter_table(spark, [{"verdict": v, "at": h.lower(), "start": p} for v, h, p in rules], "verdict string, at string, start string")
    split = urls.withColumn("_host", host_of(F.col(url_col))).withColumn("_path", path_of(F.col(url_col)))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = split.select(F.col("_host").alias("host")).distinct().select("host", F.explode(suffixes).alias("at"))
    named = F.struct((F.length("at") + F.length("start")).alias("size"), (F.col("verdict") == "allow").alias("allow"),
                     F.concat("at", "start").alias("rule"), F.col("start"))
    found = hosts.join(listed, "at").groupBy("host").agg(F.collect_list(named).alias("_rules"))
    joined = split.join(found, F.col("_host") == F.col("host"), "left").drop("host")
    fits = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["start"]))
    return joined.withColumn("_rule", F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["allow"], r["rule"])))).drop("_rules")


def page_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b) from a page's url to its canonical link and to the target of its refresh tag, resolved, without fragments."""
    url = F.col("_url")
    origin, base = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0), F.regexp_extract(url, r"^[^?#]*", 0)
    folder = F.when(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1) == "", F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(base, r"^.*/", 0))
    t = F.col("_t")
    whole = (F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(F.regexp_extract(url, r"^[^/?#]*:", 0), t))
             .when(t.startswith("/"), F.concat(origin, t)).when(t.startswith("?"), F.concat(base, t)).otherwise(F.concat(folder, t)))
    tags = F.array(F.regexp_extract(F.regexp_extract(html_col, LINK, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html_col, REFRESH, 0), TARGET, 1))
    linked = pages.where(F.contains(F.col(url_col), F.lit("://"))).select(F.col(url_col).alias("_url"), F.explode(tags).alias("_t"))
    linked = linked.where("_t <> '' and not startswith(_t, '#')").withColumn("_t", F.replace("_t", F.lit("&amp;"), F.lit("&")))
    return linked.select(node_of(url).alias("a"), node_of(whole).alias("b")).where("a <> b")


def node_of(url: Column) -> Column:
    """The url without its fragment, its scheme and host lower-cased (A-Z), without the usual port of http and https."""
    begin = F.translate(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0), UPPER, LOWER)
    begin = F.regexp_replace(F.regexp_replace(begin, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.concat(begin, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) per page. ``rules`` are (block or allow, host, path start).

    A rule fits its host and all subdomains if the url's path starts with its own; the longest one decides. Urls joined by
    canonical links, refresh redirects or rows (a, b) of ``links`` are aliases. A page without a rule takes the decision of its
    component: allow if an alias has an allow rule, else block if one has a block rule, else ``default``. So a block spreads to
    aliases, but never over an explicit allow. Aliases count even if they are no pages themselves.

    A null url, or one without ``://``, has an empty host and path and no alias. A null page has no links. Pages that share an
    url are judged alike; repeated rows stay. Other columns are ignored. Very long urls and pages are one row's work; an empty table gives an
    empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"))
    edges = page_links(pages, url_col, html_col)
    if links is not None:
        edges = edges.unionByName(links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    nodes = components(edges)
    judged = with_rules(nodes, "node", rules)
    decided = judged.groupBy("root").agg(F.bool_or(F.col("_rule.allow")).alias("_allow")).where("_allow is not null")
    known = nodes.join(decided, "root").select(F.col("node").alias("_node"), "_allow")
    ruled = with_rules(rows, "_url", rules).join(known, F.when(F.contains("_url", F.lit("://")), node_of(F.col("_url"))) == F.col("_node"), "left")
    allow = F.coalesce("_rule.allow", "_allow", F.lit(default == "allow"))
    return ruled.select(F.col("id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
                        F.when(allow, "allow").otherwise("block").alias("verdict"))
